"""Hard negatives of anchors: rows of another label that score nearly as high as a positive.

Pairs are shuffled as packed keys (anchor, descending score, id), sorted inside their
partitions. So a task sees the pairs of an anchor best first, one at a time: a positive
opens a window below its score, and each negative that follows is given out for the
windows it is in, until they are full. What is held for an anchor is its open windows and
the few negatives that tie with the last score.

Every pair is scored, block by block, anchors against all rows. A block leaves out only pairs
that cannot count: positives behind its own first ones and, once the positives of all blocks
are known, negatives outside every window or behind the block's first ones in each window.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.sources.scratch import written

POSITIVES = NEGATIVES = 5
#: A negative scores at least so many per cent of its positive.
LOW = 80
#: Bytes of anchors that a task holds, and of rows in a cell where there are more anchors.
BLOCK_BYTES = 64 << 20
#: Anchors whose sorted pairs one task reads.
ANCHORS_A_TASK = 10_000
_ANCHOR_TILE, _ROW_TILE = 1024, 2048
_HELD = 1 << 19
_SIGN = 1 << 63
_KEY = struct.Struct(">QQQQB")
_PACKED = np.dtype([("anchor", ">u8"), ("number", ">u8"), ("score", ">u8"), ("id", ">u8"), ("positive", "u1")])
PAIRS = "anchor long, number long, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_components(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a null, non-finite or huge one."""
    column = F.col(vector) if isinstance(vector, str) else vector
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float(1 << 31))))
    return F.when(usable, scaled)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as exact whole numbers; those beyond a long are cut to its range."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    # Floating point products of whole numbers are exact as long as every sum fits the mantissa.
    kind = "float32" if bound < 1 << 24 else "float64" if bound < 1 << 53 else "int64" if bound < _SIGN else object
    out = a.astype(kind) @ b.T.astype(kind)
    return np.clip(out, -_SIGN, _SIGN - 1).astype(np.int64) if kind is object else out.astype(np.int64)


class Anchors:
    """A block of anchors; ``floors`` and ``tops`` are the windows of each, empty ones at the end."""

    def __init__(self, table: pa.Table, low: int):
        columns = table.combine_chunks()
        self.ids, self.numbers, self.labels = (columns[c].to_numpy() for c in ("id", "number", "label"))
        self.vectors = _matrix(_one(columns["vector"]))
        self.tops = None
        if "tops" in table.column_names:
            scores = [sorted((s for s in t or [] if s >= 0), reverse=True) for t in columns["tops"].to_pylist()]
            width = max(map(len, scores), default=0)
            # No score is between 1 and 0: what fills up the rows is an empty window.
            self.tops = np.array([s + [0] * (width - len(s)) for s in scores], np.int64).reshape(len(scores), width)
            self.floors = np.array([[-(-low * x // 100) for x in s] + [1] * (width - len(s)) for s in scores], np.int64).reshape(self.tops.shape)


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Survivors:
    """The pairs of a block of anchors that may count, as rows pass by."""

    def __init__(self, anchors: Anchors, most: int):
        self.anchors, self.most = anchors, most
        self.least = np.full(len(anchors.ids), np.iinfo(np.int64).min)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        mine = self.anchors
        for at in range(0, len(mine.ids), _ANCHOR_TILE):
            part = slice(at, at + _ANCHOR_TILE)
            for row in range(0, len(ids), _ROW_TILE):
                tile = slice(row, row + _ROW_TILE)
                scores = products(mine.vectors[part], vectors[tile])
                same = mine.labels[part, None] == labels[None, tile]
                if mine.tops is None:
                    wanted = same & (scores >= self.least[part, None]) & (mine.ids[part, None] != ids[None, tile])
                elif mine.tops.shape[1]:
                    wanted = ~same & (scores <= mine.tops[part].max(1)[:, None]) & (scores >= mine.floors[part].min(1)[:, None])
                    wanted &= mine.ids[part, None] != ids[None, tile]
                else:
                    continue
                place, column = np.nonzero(wanted)
                self.held.append((place + at, scores[place, column], ids[tile][column]))
                self.size += len(place)
                if self.size > _HELD:
                    self._reduce()

    def _first(self, which: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of the pairs ``which``, the first ``most`` of each anchor; highest score first, then lowest id."""
        order = which[np.lexsort((ids[which], -score[which], place[which]))]
        sorted_places = place[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_places, sorted_places, "left")
        return order[rank < self.most]

    def _reduce(self) -> tuple[np.ndarray, ...]:
        place, score, ids = (np.concatenate([np.empty(0, np.int64), *c]) for c in (zip(*self.held, strict=True) if self.held else [()] * 3))
        mine = self.anchors
        if mine.tops is None:
            keep = self._first(np.arange(len(place)), place, score, ids)
            full = np.bincount(place[keep], minlength=len(self.least)) >= self.most
            worst = np.full(len(self.least), np.iinfo(np.int64).max)
            np.minimum.at(worst, place[keep], score[keep])
            self.least[full] = worst[full]
        else:
            kept = [np.empty(0, np.int64)]
            for k in range(mine.tops.shape[1]):
                inside = (score <= mine.tops[place, k]) & (score >= mine.floors[place, k])
                kept.append(self._first(np.flatnonzero(inside), place, score, ids))
            keep = np.unique(np.concatenate(kept))
        self.held = [(place[keep], score[keep], ids[keep])]
        # Held pairs that all count are no reason to sort again at once.
        self.size = len(keep) // 2
        return self.held[0]

    def rest(self) -> pa.RecordBatch:
        place, score, ids = self._reduce()
        columns = [self.anchors.ids[place], self.anchors.numbers[place], score, ids]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["anchor", "number", "score", "id"])


def _scored(anchors: DataFrame, rows: DataFrame, most: int, low: int, block_bytes: int) -> DataFrame:
    """The surviving pairs of ``anchors`` (id, number, label, vector[, tops]) and ``rows`` (id, label, vector)."""
    count, width = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    row_bytes = 8 * ((width or 0) + POSITIVES + 4)
    if count * row_bytes <= block_bytes:
        # Bounded by the check just made.
        shared = anchors.sparkSession.sparkContext.broadcast(anchors.toArrow())

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Survivors(Anchors(shared.value, low), most)
            for batch in batches:
                found.add(batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector")))
            yield found.rest()

        return rows.mapInArrow(against, PAIRS)

    a_blocks, r_blocks = -(-count * row_bytes // block_bytes), max(1, -(-rows.count() * row_bytes // block_bytes))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int, key: Column) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return df.withColumn(own, F.pmod(key, F.lit(blocks).cast("long"))).withColumn(other, every)

    left = dealt(anchors, "a", a_blocks, "r", r_blocks, F.xxhash64("number"))
    # Rows of one id spread by their vectors.
    right = dealt(rows, "r", r_blocks, "a", a_blocks, F.xxhash64("id", "vector"))

    def cell(mine: pa.Table, others: pa.Table) -> pa.Table:
        found = Survivors(Anchors(mine, low), most)
        for batch in others.to_batches(max_chunksize=_ROW_TILE):
            found.add(batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector")))
        return pa.Table.from_batches([found.rest()])

    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(cell, PAIRS)


def _packed(positive: bool) -> Callable:
    """Pairs to keys whose byte order is anchor, descending score, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = np.uint64(_SIGN)
        for batch in batches:
            anchor, number, score, ids = (batch.column(c).to_numpy().view(np.uint64) ^ sign for c in ("anchor", "number", "score", "id"))
            keys = np.empty(batch.num_rows, _PACKED)
            keys["anchor"], keys["number"], keys["score"], keys["id"], keys["positive"] = anchor, number, ~score, ids, positive
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_PACKED.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
            yield pa.record_batch([fixed.cast(pa.binary())], ["key"])

    return run


def windowed(keys: Iterator[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> Iterator[tuple]:
    """Rows of the result from sorted keys; a row leaves as soon as its negative passes."""
    anchor, opened, windows, tied, tied_score = None, 0, [], [], None
    for key in keys:
        if key[:16] != anchor:
            anchor, opened, windows, tied, tied_score = key[:16], 0, [], [], None
        first, _, score, row, positive = _KEY.unpack(key)
        anchor_id, score, row = first - _SIGN, (~score & (1 << 64) - 1) - _SIGN, row - _SIGN
        if score != tied_score:
            tied, tied_score = [], score
        if positive:
            if opened < positives:
                opened += 1
                # A window is its positive, its score and the rank given last. Negatives of the same score and a lower id have passed already.
                window = [row, score, 0]
                if low * score <= 100 * score:
                    for negative in tied:
                        window[2] += 1
                        yield anchor_id, row, window[2], negative, score, score
                    windows.append(window)
            continue
        if len(tied) < negatives:
            tied.append(row)
        for window in windows:
            if window[2] < negatives and low * window[1] <= 100 * score:
                window[2] += 1
                yield anchor_id, window[0], window[2], row, window[1], score
        windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has whole-number vectors (see ``whole_components``); ``is_anchor`` is a column of it.
    A score is the inner product; a shorter vector counts as filled up with zeros. Rows with a
    null id, label or vector take no part. Rows of one id are rows of their own, but never
    positives or negatives of an anchor of that id; an anchor that occurs twice gives
    its rows twice. Equal scores go by id. An anchor without positives, or a positive
    without negatives in its window, gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.select(
            F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
        ).where("id is not null and label is not null and vector is not null"),
        "mining-rows",
    )
    anchors = written(rows.where("anchor").withColumn("number", F.monotonically_increasing_id()).drop("anchor"), "mining-anchors")
    rows = rows.drop("anchor")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    found = _scored(anchors, rows, positives, low, block_bytes).withColumn("rank", F.row_number().over(best))
    opening = written(found.where(F.col("rank") <= positives).drop("rank"), "mining-positives")
    tops = opening.groupBy("number").agg(F.collect_list("score").alias("tops"))
    placed = written(anchors.join(tops, "number").select("id", "number", "label", "vector", "tops"), "mining-windows")
    below = _scored(placed, rows, negatives, low, block_bytes)
    keys = opening.mapInArrow(_packed(True), "key binary").unionAll(below.mapInArrow(_packed(False), "key binary"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-anchors.count() // ANCHORS_A_TASK))
    sorted_keys = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:16]))
    mined = sorted_keys.mapPartitions(lambda part: windowed((key for key, _ in part), positives, negatives, low))
    return spark.createDataFrame(mined, RESULT)
