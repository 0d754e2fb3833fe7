"""JSON arrays of objects, read in byte splits.

A file is read as pieces that end at a closing brace, wherever Spark splits it. A piece can
only be understood if it is known whether it starts inside a string and how many brackets are
open, so there are two passes. The first reports for each split, for both possible starts
(inside a string or not), the change of depth, and whether the start turns into the other
one. Composing these over the splits of a file tells every split its true start. The
second pass cuts the objects out where they stand; what reaches over an edge is put together
from its fragments. Objects are then parsed one by one.

A split starts behind a brace. A backslash before it could only escape the brace, so no
escape is ever pending there, and the two starts are all there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.sources.lines import MAX_BROADCAST_SPLITS, most_splits
from talkloom.sources.scratch import written

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
#: What may stand before the first object, between two, and behind the last one; null is an element too.
_OPEN = re.compile(rb"\s*\[\s*((?:null\s*,\s*)*)")
_BETWEEN = re.compile(rb"\s*,\s*((?:null\s*,\s*)*)")
_CLOSE = re.compile(rb"\s*((?:,\s*null\s*)*)\]\s*")
_NO_OBJECT = re.compile(rb"\s*\[\s*((?:null\s*(?:,\s*null\s*)*)?)\]\s*")

STATES = "file string, block long, flips long, outside long, inside long"
ELEMENTS = "file string, block long, place long, whole boolean, text binary"


class MalformedArray(ValueError):
    """The file is no JSON array of objects and nulls."""


def scan_piece(piece: bytes) -> tuple[int, int, int]:
    """Quotes that are not escaped, and the depth change by brackets at even and at odd numbers of quotes before."""
    if b"\\" in piece:
        piece = _ESCAPED.sub(b"", piece)
    parts = piece.split(b'"')
    change = [0, 0]
    for k, part in enumerate(parts):
        if part:
            change[k & 1] += part.count(b"{") + part.count(b"[") - part.count(b"]") - part.count(b"}")
    return len(parts) - 1, change[0], change[1]


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: whether its quotes are odd in number, and the depth change if it starts outside or inside a string."""
    at, flips, change = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        return pa.record_batch([[at[0]], [at[1]], [flips], [change[0]], [change[1]]], ["file", "block", "flips", "outside", "inside"])

    for batch in batches:
        for file, block, piece in _pieces(batch):
            if (file, block) != at:
                if at:
                    yield row()
                at, flips, change = (file, block), 0, [0, 0]
            quotes, even, odd = scan_piece(piece)
            # Of the two starts, the one that is outside strings just now has the even brackets.
            change[flips] += even
            change[1 - flips] += odd
            flips ^= quotes & 1
            # The brace that ends the piece counts for the start that is outside behind it.
            change[flips] -= 1
    if at:
        yield row()


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    return zip(
        batch.column("file").to_pylist(),
        batch.column("block").to_pylist(),
        (v.as_py() for v in batch.column("value").cast(pa.binary())),
        strict=True,
    )


class _Cutter:
    """Walks over the pieces of one split and gives out its elements and fragments."""

    def __init__(self, file: str, block: int, inside: int, depth: int):
        self.file, self.block, self.inside, self.depth = file, block, inside, depth
        self.place = 0
        # Starting within an object, this split first continues the last object of an earlier one.
        self.continues = bool(inside) or depth > 1
        self.begun = not self.continues
        self.parts: list[bytes] = []
        self.closed = False

    def fail(self, piece: bytes) -> None:
        raise MalformedArray(f"{self.file}: no JSON array of objects near {piece[:60]!r}")

    def nulls(self, text: bytes) -> Iterator[tuple]:
        for _ in range(text.count(b"null")):
            yield self.file, self.block, self.place, True, None
            self.place += 1

    def add(self, piece: bytes) -> Iterator[tuple]:
        if self.closed:
            self.fail(piece)
        if not self.inside and self.depth <= 1 and not self.parts:
            piece = yield from self._between(piece)
            if self.closed:
                return
        self.parts.append(piece)
        quotes, even, odd = scan_piece(piece)
        self.depth += odd if self.inside else even
        self.inside ^= quotes & 1
        if self.inside:
            return
        self.depth -= 1
        if self.depth < 1:
            self.fail(piece)
        if self.depth == 1:
            yield self._out(closing=b"}")

    def _between(self, piece: bytes) -> Iterator[tuple]:
        """The elements before the next object; the rest of the piece, from its opening brace."""
        ends = (_NO_OBJECT if self.depth == 0 else _CLOSE).fullmatch(piece)
        if ends:
            yield from self.nulls(ends[1])
            self.closed = True
            return b""
        lead = (_OPEN if self.depth == 0 else _BETWEEN).match(piece)
        if not lead or piece[lead.end() : lead.end() + 1] != b"{":
            self.fail(piece)
        yield from self.nulls(lead[1])
        self.depth = 1
        return piece[lead.end() :]

    def _out(self, closing: bytes) -> tuple:
        text = b"}".join(self.parts) + closing
        self.parts = []
        if self.begun:
            row = (self.file, self.block, self.place, bool(closing), text)
            self.place += 1
        else:
            # One place before this split's first element is the last element of the splits before.
            row = (self.file, self.block, -1, False, text)
            self.begun = True
        return row

    def rest(self) -> Iterator[tuple]:
        """The beginning of an object that the next splits end."""
        if self.parts:
            yield self._out(closing=b"")
        elif not self.closed and self.depth == 0:
            self.fail(b"")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter, at = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
        arrays = [pa.array(c, t) for c, t in zip(columns[:4], kinds, strict=True)]
        return pa.record_batch([*arrays, pa.array(columns[4], pa.binary())], ["file", "block", "place", "whole", "text"])

    for batch in batches:
        rows: list[tuple] = []
        starts = zip(batch.column("starts_inside").to_pylist(), batch.column("starts_depth").to_pylist(), strict=True)
        for (file, block, piece), (inside, depth) in zip(_pieces(batch), starts, strict=True):
            if (file, block) != at:
                if cutter:
                    rows += cutter.rest()
                cutter, at = _Cutter(file, block, inside, depth), (file, block)
            rows += cutter.add(piece)
        yield out(rows)
    if cutter:
        yield out(list(cutter.rest()))


def _with_starts(states: DataFrame) -> DataFrame:
    """Compose the splits of each file: whether a split starts inside a string, and at which depth."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("flips").over(earlier), F.lit(0)), F.lit(2)).cast("long")
    change = F.when(F.col("starts_inside") == 1, F.col("inside")).otherwise(F.col("outside"))
    return (
        states.withColumn("starts_inside", inside)
        .withColumn("change", change)
        .withColumn("starts_depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)).cast("long"))
    )


def _refuse_open(states: DataFrame) -> None:
    """Fail if a file ends inside a string or with other than all brackets closed."""
    ends = _with_starts(states).groupBy("file").agg(F.sum("change").alias("depth"), (F.sum("flips") % 2).alias("inside"))
    # The last piece has no brace behind it, though one was counted.
    wrong = ends.where((F.col("depth") != -1) | (F.col("inside") != 0)).select("file").first()
    if wrong:
        raise MalformedArray(f"{wrong.file}: the array is not closed")


def read_array_splits(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON array files as ``(file, pos, <fields>)``, each file read by many tasks.

    The rows are those of reading each array as a whole, for arrays of any size: only a
    single object must fit a task. Null elements count. A file that is no array of objects
    and nulls fails the read. A file of white space gives no rows.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"),
        "value",
    )
    # A file of white space is a single piece; it holds no array.
    raw = raw.where(~((F.octet_length("value") == F.col("bytes")) & F.col("value").rlike(r"\A\s*\z")))
    pieces = raw.select("file", "block", "value")
    states = written(pieces.mapInArrow(_split_states, STATES), "array-states")
    _refuse_open(states)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = _with_starts(states).select("file", "block", "starts_inside", "starts_depth")
    few = most_splits(spark, spark.read.format("binaryFile").load(path)) <= MAX_BROADCAST_SPLITS
    if few:
        # One row per split, bounded by the check; the pieces keep their order.
        known = pieces.join(F.broadcast(starts), ["file", "block"])
    else:
        ordered = pieces.withColumn("row", F.monotonically_increasing_id())
        known = ordered.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "row")
    elements = written(known.mapInArrow(_cut, ELEMENTS), "array-elements")
    counts = elements.where("place >= 0").groupBy("file", "block").agg(F.count("*").alias("n"))
    every = states.select("file", "block").join(counts, ["file", "block"], "left")
    bases = every.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = elements.join(F.broadcast(bases) if few else bases, ["file", "block"])
    placed = placed.select("file", "block", (F.col("base") + F.col("place")).alias("pos"), "whole", "text")
    # At most two fragments a split; those of one object meet.
    pieced = placed.where(~F.col("whole")).groupBy("file", "pos").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = pieced.select("file", "pos", F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), "}").alias("text"))
    objects = placed.where("whole").select("file", "pos", F.col("text").cast("string").alias("text")).unionByName(joined)
    record = F.from_json("text", schema, {"mode": "FAILFAST"})
    return objects.withColumn("record", record).select("file", "pos", "record.*")
