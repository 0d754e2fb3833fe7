"""Benchmark decontamination: size-partitioned MinHash containment search, checked exactly.

Items of up to ``LOOKED_UP`` shingles are candidates in every document that has one of their
shingles. Longer items are put into size classes (8, 16, 32, .. shingles). For each class a document
is cut into windows of twice the class size, one class size apart, so that any passage
of an item's length lies inside a window and the wanted containment of the item becomes
a known least Jaccard similarity with that window: a long document cannot hide a short
item. A window is a candidate for an item if any of ``HASHES`` MinHash values agree; for
an item whose contained shingles stand together that fails with a chance below 5e-6 at
the default threshold. Each candidate is checked by exact containment in the document's
whole shingle set. Minima of a class come from those of the class below, so that each
shingle is hashed once per permutation.

Documents stay where they are: the items are sent to the tasks, in blocks of bounded
size if there are many, so nothing but results is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.stores import sent_if_small
from talkloom.llm.text import MinHash, WordHashes, lower_words, shingle_hashes, sparing, text_bytes
from talkloom.sources.scratch import written

PERCENT = 75
HASHES = 64
SMALLEST = 8
LOOKED_UP = 2
#: Shingles of the items that are sent to the tasks at once: 16 MB, and the rows of one block.
BLOCK_SHINGLES = 2_000_000
_COLUMNS = 4096
SCHEMA = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [np.unique(shingle_hashes(lower_words(t), hashes)) for t in text_bytes(batch.column("text"))]
        yield pa.record_batch(
            [batch.column("item_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["item_id", "size", "shingles"],
        )


class _ItemIndex:
    """Items by size class; equal sets are held once with all their item ids."""

    def __init__(self, rows: pa.Table, permutations: MinHash):
        ids: dict[bytes, list] = {}
        for item, shingles in zip(rows.column("item_id").to_pylist(), rows.column("shingles").to_pylist(), strict=True):
            ids.setdefault(shingles, []).append(item)
        self.ids = list(ids.values())
        self.sets = [np.frombuffer(s, np.uint64) for s in ids]
        by_class: dict[int, list[int]] = {}
        short = [p for p, own in enumerate(self.sets) if len(own) <= LOOKED_UP]
        keys = np.concatenate([np.empty(0, np.uint64), *[self.sets[p] for p in short]])
        self.short = self._sorted(keys, np.repeat(np.array(short, np.int64), [len(self.sets[p]) for p in short]))
        for place, own in enumerate(self.sets):
            if len(own) <= LOOKED_UP:
                continue
            size = SMALLEST
            while size < len(own):
                size *= 2
            by_class.setdefault(size, []).append(place)
        self.classes = {}
        salts = (np.arange(permutations.size, dtype=np.uint64) << np.uint64(32))
        for size, places in by_class.items():
            keys = np.concatenate([permutations.signature(self.sets[p]).astype(np.uint64) | salts for p in places])
            self.classes[size] = self._sorted(keys, np.repeat(places, permutations.size))

    def _sorted(self, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        bits = max(16, int(len(keys) * 16).bit_length())
        flags = np.zeros(1 << bits, bool)
        flags[self.flag(keys, bits)] = True
        return keys[order], places[order], bits, flags

    @staticmethod
    def flag(keys: np.ndarray, bits: int) -> np.ndarray:
        """A small hash: low bits of the value, moved by the number of the permutation."""
        return (keys ^ ((keys >> np.uint64(32)) * np.uint64(0x9E3779B1))) & np.uint64((1 << bits) - 1)

    def candidates(self, shingles: np.ndarray, permutations: MinHash) -> set[int]:
        found = self._found(shingles, *self.short)
        if not self.classes:
            return found
        salts = (np.arange(permutations.size, dtype=np.uint64) << np.uint64(32))[:, None]
        blocks = self._blocks(shingles, permutations)
        size = SMALLEST
        for wanted in sorted(self.classes):
            while size < wanted:
                size *= 2
                blocks = _pairwise(blocks)
            windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            found |= self._found(windows.astype(np.uint64) | salts, *self.classes[wanted])
        return found

    def _found(self, values: np.ndarray, keys: np.ndarray, places: np.ndarray, bits: int, flags: np.ndarray) -> set[int]:
        found: set[int] = set()
        hits = values[flags[self.flag(values, bits)]]
        if len(hits):
            left, right = np.searchsorted(keys, hits), np.searchsorted(keys, hits, "right")
            for a, b in set(zip(left[left < right].tolist(), right[left < right].tolist(), strict=True)):
                found.update(places[a:b].tolist())
        return found

    @staticmethod
    def _blocks(shingles: np.ndarray, permutations: MinHash) -> np.ndarray:
        """Minima of runs of ``SMALLEST`` shingles; the last shingle fills up the last run."""
        rest = -len(shingles) % SMALLEST
        if rest:
            shingles = np.concatenate([shingles, np.repeat(shingles[-1:], rest)])
        parts = []
        for start in range(0, len(shingles), _COLUMNS):
            values = permutations.values(shingles[start : start + _COLUMNS])
            parts.append(values.reshape(permutations.size, -1, SMALLEST).min(axis=2))
        return np.concatenate(parts, axis=1)


def _pairwise(blocks: np.ndarray) -> np.ndarray:
    if blocks.shape[1] % 2:
        blocks = np.concatenate([blocks, blocks[:, -1:]], axis=1)
    return np.minimum(blocks[:, ::2], blocks[:, 1::2])


def _searched(sent, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, permutations = WordHashes(), MinHash(HASHES, seed=7)
        index = _ItemIndex(sent.value, permutations)
        for batch in batches:
            ids = batch.column("doc_id")
            out: list[tuple] = []
            for row, text in enumerate(text_bytes(batch.column("text"))):
                shingles = shingle_hashes(lower_words(text), hashes)
                if not len(shingles):
                    continue
                places = index.candidates(shingles, permutations)
                if not places:
                    continue
                own = np.unique(shingles)
                for place in sorted(places):
                    item = index.sets[place]
                    shared = int(np.isin(item, own, assume_unique=True).sum())
                    if 100 * shared >= percent * len(item):
                        doc = ids[row].as_py()
                        out += [(doc, i, len(item), shared, shared / len(item)) for i in index.ids[place]]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "item_shingles", "shared", "containment"],
            )

    return search


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    doc_text: str = "text",
    item_text: str = "text",
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for each item found in a document.

    An item is found if at least ``percent`` % of its distinct five-word shingles are
    among the document's. Items of fewer than five words are one shingle and are found
    in documents that are this very run of words. Items and documents without words
    give nothing. Repeated rows give a row each, null ids stay null, other columns are
    not read. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    sets = written(
        items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
        .mapInArrow(_item_sets, "item_id long, size long, shingles binary")
        .where("size > 0"),
        "leak-items",
    )
    total = sets.agg(F.sum("size")).first()[0] or 0
    count = -(-total // BLOCK_SHINGLES)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    found = []
    for block in range(count):
        part = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(count)) == block)
        sent = spark.sparkContext.broadcast(part.select("item_id", "shingles").toArrow())
        found.append(rows.mapInArrow(sparing(_searched(sent, percent)), SCHEMA))
    if not found:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionAll, found)


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay as they are.

    Rows that share an id are judged together; rows without an id stay.
    """
    leaks = written(find_leaks(docs, items, doc_id=doc_id, doc_text=text).select("doc_id").distinct(), "leaks")
    gone = sent_if_small(leaks.select(F.col("doc_id").alias("_gone")), 500_000)
    return docs.join(gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")
