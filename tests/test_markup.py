"""The one-pass block reader against a tree of the whole page."""

import tracemalloc
from html import escape
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.functions.markup import VOID, BlockReader, answer_blocks, has_class, result_links


class Tree(HTMLParser):
    """Nodes are [tag, attributes, children]; texts are strings, already escaped."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        tags = [node[0] for node in self.open]
        if tag in tags[1:]:
            last = len(tags) - 1 - tags[::-1].index(tag)
            self.open = self.open[:last]

    def handle_data(self, data):
        self.open[-1][2].append(data if self.open[-1][0] in ("script", "style") else escape(data, quote=False))

    def handle_comment(self, data):
        self.open[-1][2].append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.open[-1][2].append(f"<!{decl}>")


def inside(node):
    for child in node[2]:
        if not isinstance(child, str):
            yield child
            yield from inside(child)


def written(node):
    if isinstance(node, str):
        return node
    return f"<{node[0]}>{''.join(map(written, node[2]))}</{node[0]}>"


def slow_links(html, block, heading):
    found = []
    for item in inside(Tree(html).root):
        if has_class(block)(item[0], item[1]):
            title = next((n for n in inside(item) if n[0] == heading), None)
            link = title and next((n for n in inside(title) if n[0] == "a" and "href" in n[1]), None)
            found.append((title and written(title), link and link[1]["href"]))
    return found


def slow_answers(html, block, inner):
    found = []
    for item in inside(Tree(html).root):
        if has_class(block)(item[0], item[1]):
            part = item if not inner else next((n for n in inside(item) if has_class(inner)(n[0], n[1])), None)
            if part:
                found.append(written(part))
    return found


PIECES = st.sampled_from(
    [
        "<div>", "</div>", '<div class="b">', '<div class="x b">', '<p class="i j">', "</p>", '<p class="i">', "<p/>",
        "<h2>", "</h2>", '<h2 class="b">', '<a href="/1">', "<a>", "<a href>", '<a class="b" href="/2">', "</a>", "<br>", "</br>",
        '<img class="b">', '<img class="i j"/>', '<hr class="b i j">', "<script>", "</script>", "<style>a<b", "</style>",
        "text", "a &amp; b", "&lt;", "<", ">", "<!-- note -->", "<!doctype html>", "</none>", " ", '<i class="i  j">', "</i>", "<?pi?>",
        '<i class="&#98;">', "<H2>", '<title class="b">', "</title>",
    ]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_same_parts_as_a_tree(html):
    assert result_links(html, "b", "h2") == slow_links(html, "b", "h2")
    assert result_links(html, "b", "a") == slow_links(html, "b", "a")
    assert result_links(html, "b", "hr") == slow_links(html, "b", "hr")
    for inner in (None, "i", "i j", "b"):
        assert answer_blocks(html, "b", inner) == slow_answers(html, "b", inner)


@pytest.mark.parametrize("html", ["", "plain", "<div class='b", "</b></b>", '<div class="b">' * 3])
def test_pages_cut_short(html):
    assert result_links(html, "b", "h2") == slow_links(html, "b", "h2")
    assert answer_blocks(html, "b", None) == slow_answers(html, "b", None)


def test_memory_does_not_follow_the_page():
    """Beside the page itself: the same for a page of 20 times as many other elements."""

    def peak(times):
        other = '<div class="other"><p>some words &amp; more</p><h2><a href="/x">no</a></h2></div>' * times
        page = f'{other}<li class="b"><h2><a href="/1">yes</a></h2></li>{other}'
        tracemalloc.start()
        found = result_links(page, "b", "h2"), answer_blocks(page, "b", None)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        heading = "<h2><a>yes</a></h2>"
        assert found == ([(heading, "/1")], [f"<li>{heading}</li>"])
        return most

    small, large = peak(500), peak(10_000)
    assert large < small + 200_000


def test_deep_and_unclosed_elements_take_one_step_each():
    steep = "<b>" * 100_000 + "</i>" * 100_000
    reader = BlockReader(has_class("b"), None)
    assert reader.read(steep + '<u class="b">deep</u>')[0].part.markup == "<u>deep</u>"
