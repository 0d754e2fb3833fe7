"""Quality scores: kernel ridge regression by random Fourier features, calibrated by isotonic regression.

A document is described by a row of statistics of its bytes, words and lines. Standard
scores of these go through ``FEATURES`` random cosines, whose inner products approximate
a Gaussian kernel; ridge weights come from normal equations that partitions sum up.
Raw scores of other labelled rows than those of the fit are counted in bins, and
pooling adjacent violators over the bins makes them chances.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.labels import one_label, remainder
from talkloom.llm.stores import sent_if_small
from talkloom.llm.text import text_bytes
from talkloom.sources.scratch import written

HELD_OUT = 5
CUT = 0.3
FEATURES = 256
RIDGE = 1e-3
SEED = 11
BINS = 400
#: Raw ridge scores are cut to this range before they are binned.
LOW, HIGH = -0.5, 1.5
#: Partial sums meet in so many tasks before the driver adds them up: 32 matrices of 257 x 258.
MEETING = 32

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "shouts", "symbols", "bars", "lines",
    "distinct_words", "same_as_last", "distinct_triples", "repeated_lines", "entropy", "beyond_ascii", "packed", "closing_marks",
]
_UPPER, _DIGIT, _MARK = np.arange(65, 91), np.arange(48, 58), np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def statistics(text: bytes) -> list[float]:
    """The values named in ``STATISTICS``; all 0 for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = len(text), len(words)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    shares = counts[counts > 0] / size
    lines = [line for line in text.split(b"\n") if line.strip()]
    triples = max(1, n - 2)
    return [
        np.log1p(size),
        np.log1p(n),
        (size - counts[9:14].sum() - counts[32]) / n,
        counts[_UPPER].sum() / max(1, letters),
        counts[_DIGIT].sum() / size,
        counts[_MARK].sum() / size,
        counts[33] / n,
        sum(int(counts[c]) for c in b"#*$%&<>") / n,
        counts[124] / n,
        np.log1p(len(lines)) - np.log1p(n),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples,
        1 - len(set(lines)) / len(lines),
        float(-(shares * np.log2(shares)).sum()),
        counts[128:].sum() / size,
        len(zlib.compress(text, 1)) / size if size >= 64 else 1.0,
        (counts[44] + counts[46] + counts[58] + counts[59]) / n,
    ]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t) for t in text_bytes(batch.column("text"))], np.float64).reshape(-1, len(STATISTICS))
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.record_batch([batch.column("doc_id"), values], ["doc_id", "stats"])


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_described, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    chances: np.ndarray

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        return lifted((stats - self.mean) / self.spread)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lifted(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(np.clip(self.raw(stats), LOW, HIGH), self.edges, self.chances)


def lifted(standard: np.ndarray) -> np.ndarray:
    """Random Fourier features of standard scores, and a constant."""
    random = np.random.default_rng(SEED)
    width = standard.shape[1]
    frequencies = random.normal(0, 1 / np.sqrt(width), (width, FEATURES))
    phases = random.uniform(0, 2 * np.pi, FEATURES)
    waves = np.sqrt(2 / FEATURES) * np.cos(np.clip(standard, -5, 5) @ frequencies + phases)
    return np.hstack([waves, np.ones((len(standard), 1))])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(STATISTICS))


def _normal_sums(mean: np.ndarray, spread: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            features = lifted((_stats_of(batch) - mean) / spread)
            target = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            total += features.T @ np.column_stack([features, target])
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sums


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for batch in batches:
        for part in batch.column("sums"):
            total += np.frombuffer(part.as_py(), np.float64)
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Never falling chances of the bins that have rows, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for n, p in zip(counts, positives, strict=True):
        pools.append([n, p, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, p2, width = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + p2, pools[-1][2] + width]
    return np.concatenate([np.full(int(width), p / n) for n, p, width in pools])


def fit(labelled: DataFrame) -> QualityModel | None:
    """Fit rows (stats, label, part): parts 0 to 2 give the weights, part 3 the calibration.

    All rows count. What reaches the driver are sums of fixed size. None without rows.
    """
    size = len(STATISTICS)
    at = F.posexplode("stats").alias("k", "v")
    moments = {r.k: (r.n, r.s, r.q) for r in labelled.select(at).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).collect()}
    if len(moments) < size:
        return None
    n, s, q = np.array([moments[k] for k in range(size)], np.float64).T
    mean = s / n
    spread = np.sqrt(np.maximum(q / n - mean**2, 1e-12))
    spread[spread < 1e-5] = 1.0
    partial = labelled.where("part < 3").select("stats", "label").mapInArrow(_normal_sums(mean, spread), "sums binary")
    met = partial.withColumn("k", F.pmod(F.spark_partition_id(), F.lit(MEETING))).groupBy("k").applyInArrow(_added, "sums binary")
    total = sum((np.frombuffer(r.sums, np.float64) for r in met.collect()), np.zeros((FEATURES + 1) * (FEATURES + 2)))
    total = total.reshape(FEATURES + 1, FEATURES + 2)
    penalty = RIDGE * max(1.0, total[-1, -2]) * np.eye(FEATURES + 1) / FEATURES
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    model = QualityModel(mean, spread, weights, np.array([LOW, HIGH]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (np.clip(model.raw(_stats_of(batch)), LOW, HIGH) - LOW) / (HIGH - LOW) * BINS
            yield pa.record_batch([pa.array(np.minimum(place, BINS - 1).astype(np.int64)), batch.column("label")], ["bin", "label"])

    bins = (
        labelled.where("part = 3").select("stats", "label").mapInArrow(binned, "bin long, label int")
        .groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).orderBy("bin").collect()
    )
    if not bins:
        return model
    where = LOW + (np.array([r.bin for r in bins]) + 0.5) / BINS * (HIGH - LOW)
    return QualityModel(mean, spread, weights, where, isotonic(np.array([r.n for r in bins], float), np.array([r.p for r in bins], float)))


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held_out: int = HELD_OUT, cut: float = CUT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learnt from rows whose id's remainder by ``held_out`` is not 0. The score
    is the chance of label 1. Null and empty texts have statistics of 0 and are scored
    like others. Rows without id are never learnt from and not held out. Repeated rows
    are scored alike; a document with several labels counts by their mean; other columns
    are not read. Without labels every score is 0.5. Nothing but the text's statistics
    goes into a score.
    """
    rows = written(described(docs, doc_id, text), "quality-stats")
    named = written(one_label(labels, doc_id, label), "quality-labels")
    part = F.pmod(F.crc32(F.concat(F.lit("part:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(4))
    learnt = rows.join(sent_if_small(named, 1_000_000), rows["doc_id"] == named["labelled_id"]).where(remainder("doc_id", held_out) != 0)
    model = fit(written(learnt.select("stats", "label", part.alias("part")), "quality-learnt"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _stats_of(batch)
            score = model.score(stats) if model else np.full(len(stats), 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "score"])

    return rows.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id",
        (remainder("doc_id", held_out) == 0).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
