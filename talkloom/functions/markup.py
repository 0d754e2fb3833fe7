"""One pass over HTML that keeps the path of open elements and the markup asked for.

Selectors follow the usual rule for class attributes: one token matches any element
carrying it, a selector of several tokens matches the whole attribute only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

# Elements that never have content.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)

Attributes = dict[str, str]
Test = Callable[[str, Attributes], bool]


class Part:
    """The wanted markup of a block: from ``begin`` in the buffer until its element closes."""

    __slots__ = ("begin", "depth", "markup", "href")

    def __init__(self, begin: int, depth: int):
        self.begin, self.depth = begin, depth
        self.markup: str | None = None
        self.href: str | None = None


class Block:
    """An element that matched; ``part`` is None until, or unless, its part is met."""

    __slots__ = ("depth", "part")

    def __init__(self, depth: int):
        self.depth = depth
        self.part: Part | None = None


class BlockReader(HTMLParser):
    """Finds blocks, and in each the first element inside it that is its part.

    No tree is kept. A block, a part without link and a part without end wait on three
    stacks, which an end tag cuts back to its depth. Markup is written to a buffer only
    while a part is open, once for all nested parts, and the buffer is emptied when the
    outermost one closes. So memory is the open path and the wanted markup, whatever
    the page holds besides. Without ``is_part`` a block is its own part.
    """

    def __init__(self, is_block: Test, is_part: Test | None):
        super().__init__(convert_charrefs=True)
        self.is_block, self.is_part = is_block, is_part
        self.blocks: list[Block] = []
        self._path: list[str] = []
        self._opened: Counter[str] = Counter()
        self._partless: list[Block] = []
        self._linkless: list[Part] = []
        self._unfinished: list[Part] = []
        self._buffer: list[str] = []

    def _open_part(self, depth: int) -> Part:
        part = Part(len(self._buffer), depth)
        self._unfinished.append(part)
        return part

    def _close_to(self, depth: int) -> None:
        """Close all open elements that lie ``depth`` or deeper."""
        while len(self._path) > depth:
            tag = self._path.pop()
            self._opened[tag] -= 1
            if not self._opened[tag]:
                del self._opened[tag]
            self._closed(tag, len(self._path))

    def _closed(self, tag: str, depth: int) -> None:
        if self._unfinished:
            self._buffer.append(f"</{tag}>")
        for waiting in (self._partless, self._linkless):
            while waiting and waiting[-1].depth >= depth:
                waiting.pop()
        while self._unfinished and self._unfinished[-1].depth >= depth:
            part = self._unfinished.pop()
            part.markup = "".join(self._buffer[part.begin :])
        if not self._unfinished:
            self._buffer.clear()

    def handle_starttag(self, tag, attrs):
        values = {name: value or "" for name, value in attrs}
        depth = len(self._path)
        if self._linkless and tag == "a" and "href" in values:
            for part in self._linkless:
                part.href = values["href"]
            self._linkless.clear()
        found = None
        if self._partless and self.is_part(tag, values):
            found = self._open_part(depth)
            for block in self._partless:
                block.part = found
            self._partless.clear()
        if self.is_block(tag, values):
            block = Block(depth)
            self.blocks.append(block)
            if self.is_part:
                self._partless.append(block)
            else:
                found = block.part = self._open_part(depth)
        if found:
            self._linkless.append(found)
        if self._unfinished:
            self._buffer.append(f"<{tag}>")
        if tag in VOID:
            self._closed(tag, depth)
        else:
            self._path.append(tag)
            self._opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._opened[tag]:
            depth = len(self._path) - 1
            while self._path[depth] != tag:
                depth -= 1
            self._close_to(depth)

    def handle_data(self, data):
        if self._unfinished:
            raw = self._path[-1] in ("script", "style")
            self._buffer.append(data if raw else escape(data, quote=False))

    def handle_comment(self, data):
        if self._unfinished:
            self._buffer.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        if self._unfinished:
            self._buffer.append(f"<!{decl}>")

    def read(self, html: str) -> list[Block]:
        """The blocks in the order of their start tags; what is open at the end closes there."""
        self.feed(html)
        self.close()
        self._close_to(0)
        return self.blocks


def has_class(selector: str) -> Test:
    def test(tag: str, attrs: Attributes) -> bool:
        tokens = attrs.get("class", "").split()
        return selector in tokens or bool(tokens) and " ".join(tokens) == selector

    return test


def result_links(html: str, block: str, heading: str) -> list[tuple[str | None, str | None]]:
    """``(heading markup, href)`` per block; None where the block lacks one."""
    blocks = BlockReader(has_class(block), lambda tag, _: tag == heading).read(html)
    return [(b.part.markup, b.part.href) if b.part else (None, None) for b in blocks]


def answer_blocks(html: str, block: str, inner: str | None) -> list[str]:
    """Markup of each block, or of its first ``inner`` element; blocks without one are left out."""
    blocks = BlockReader(has_class(block), has_class(inner) if inner else None).read(html)
    return [b.part.markup for b in blocks if b.part]
