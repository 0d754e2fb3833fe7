"""Chat formatting: typed content parts become marked text, a loss mask and attachments.

A visitor walks the parts of a turn in order. Text is escaped and kept; an image, audio
or document part leaves a numbered placeholder, a reference to its attachment and the
number of tokens that it will expand to. A turn is formatted as::

    <turn>role
    text</turn>

``\\`` and the control strings are escaped by a backslash inside roles and texts, so
whatever a text holds can be read back. The formatted conversation is the formatted
turns in order, one row each: a conversation of any length stays in rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings, and the roles whose text is learnt.
START, END = "<turn>", "</turn>"
PLACEHOLDER = re.compile(r"<(image|audio|document):([0-9]+)>")
LEARNT = ("assistant",)

#: Tokens of an attachment: an image by patches of 14 x 14, audio by second, a document by page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 600

_ESCAPED = re.compile(r"\\|<turn>|</turn>|<(?=(?:image|audio|document):[0-9]+>)")
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FORMATTED = (
    "conv_id long, turn long, formatted string, mask array<struct<start:long,stop:long>>, "
    "attachments array<struct<number:int,type:string,ref:string,start:long,tokens:long>>, expanded_tokens long"
)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


class TurnVisitor:
    """Flattens the parts of one turn; a method per type of part."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown type of content part: {kind}")
        method(part)

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, part: dict) -> None:
        self.add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        patches = math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH)
        self.attach("image", part, patches)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments) + 1
        self.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "start": self.length, "tokens": tokens})
        self.add(f"<{kind}:{number}>")


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, list[dict], list[dict]]:
    """(formatted, spans under the loss mask, attachments); offsets count code points of the turn."""
    visitor = TurnVisitor()
    visitor.add(f"{START}{escape(role or '')}\n")
    begin = visitor.length
    for part in parts or []:
        visitor.visit(part or {})
    stop = visitor.length
    visitor.add(f"{END}\n")
    mask = [{"start": begin, "stop": stop}] if role in LEARNT and stop > begin else []
    return "".join(visitor.pieces), mask, visitor.attachments


def parse_turn(formatted: str) -> tuple[str, list[str | tuple[str, int]]]:
    """The role, and the parts in order: texts, and (type, number) for placeholders."""
    head = re.match(r"<turn>((?:[^\\\n]|\\.)*)\n", formatted, re.DOTALL)
    if head is None or not formatted.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    role, body = unescape(head[1]), formatted[head.end() : -len(END) - 1]
    return role, parse_parts(body)


def parse_parts(body: str) -> list[str | tuple[str, int]]:
    """Texts, unescaped, and placeholders of an escaped stretch."""
    parts: list[str | tuple[str, int]] = []
    at = begin = 0
    while at < len(body):
        at = body.find("<", at)
        if at < 0:
            break
        slashes = at - len(body[:at].rstrip("\\")) if at and body[at - 1] == "\\" else 0
        found = PLACEHOLDER.match(body, at)
        if found and slashes % 2 == 0:
            parts += [unescape(body[begin:at]), (found[1], int(found[2]))]
            at = begin = found.end()
        else:
            at += 1
    return [p for p in [*parts, unescape(body[begin:])] if p != ""]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    attached = pa.struct(
        [("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]
    )
    for batch in batches:
        rows = zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True)
        made = [format_turn(role, parts) for role, parts in rows]
        yield pa.record_batch(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] for m in made], pa.list_(span)),
                pa.array([m[2] for m in made], pa.list_(attached)),
                pa.array([sum(a["tokens"] for a in m[2]) for m in made], pa.int64()),
            ],
            ["conv_id", "turn", "formatted", "mask", "attachments", "expanded_tokens"],
        )


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """``FORMATTED`` rows, one per row of ``turns``; ``parts`` is an array of the type ``PARTS``.

    Null parts are an empty text, a null part or type is text, a null role is the empty
    role. Types other than text, image, audio and document are an error. Placeholders
    are numbered within their turn. Rows need no order; other columns are not read.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(parts).cast(PARTS).alias("parts"),
    )
    return rows.mapInArrow(_formatted, FORMATTED)


def text_parts(text: str) -> F.Column:
    """A text column as a list of one text part; null is the empty text."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()]
        )
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, mask: list[dict]) -> None:
        role, parts = parse_turn(formatted)
        text = "".join(p if isinstance(p, str) else f"<{p[0]}:{p[1]}>" for p in parts)
        self.turns += 1
        self.formatted_chars += len(formatted)
        self.turns_sha.update(f"{role}\n{text}\n".encode())
        for span in mask:
            learnt = unescape(formatted[span["start"] : span["stop"]])
            self.loss_chars += len(learnt)
            self.loss_sha.update(learnt.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.formatted_chars)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(digests: list[_Digest]) -> pa.RecordBatch:
        columns = list(zip(*(d.row() for d in digests), strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    current: _Digest | None = None
    for batch in batches:
        done = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True)
        for conv_id, formatted, mask in rows:
            if current is None or current.conv_id != conv_id:
                if current:
                    done.append(current)
                current = _Digest(conv_id)
            current.add(formatted, mask)
        yield batch_of(done)
    if current:
        yield batch_of([current])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """``DIGESTS`` of each conversation, parsed from ``FORMATTED`` rows.

    Turns go by number, equal numbers by their text. A digest runs over the turns one
    after another, so the rows of a conversation pass through one task, which holds
    a batch of them and two hash states. Rows without a conv_id are one conversation.
    """
    near = formatted.select("conv_id", "turn", "formatted", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return near.mapInArrow(_read_back, DIGESTS)
