"""Toxicity: one Kneser-Ney language model for toxic texts, one for ordinary texts.

Both classes share the word counts of all texts learnt from, and differ in how their share of a
word departs from their share of all words: P(word | class) = P(word) * P(class | word) / P(class).
The class shares are smoothed by Kneser-Ney: counts of a word in the classes are lessened by
discounts, which are estimated from counts of counts, and what is taken goes to the word's
stem, the words that begin alike; there a class counts with the number of its different words, not
with how often they occur; what is taken there goes to the share of all stems. So a rare expression
tells little more than its stem, and one that was not learnt tells what its stem does.

A text's evidence are the two log-likelihoods compared, in parts of a word: the difference per word over
the whole text and its spread; and for windows of a few words the logarithm of the mean, over
all windows, of the likelihood ratio. This mean stays the same however many windows an ordinary text
has, so length is no evidence, while a toxic passage shows in a long text. A logistic function of
these is fitted to the labelled rows that may be learnt from; there each row's own counts are taken out of the
model first, so that no row vouches for itself.

Every word learnt is counted, by its 63-bit hash, in a written table that grows with the input. The
most frequent rows, ``MOST_SENT`` at most, are sent to the tasks; if there are others, the distinct
keys of each document that may be among them, by a bit filter, are joined to them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.labels import one_label, remainder
from talkloom.llm.stores import sent_if_small
from talkloom.llm.text import sparing, text_bytes
from talkloom.sources.scratch import written

DIVISOR, HELD_OUT = 3, 1
CUT = 0.7
STEM = 5
#: Words of the windows, beside the whole text.
WINDOWS = (1, 2, 4, 16)
FEATURES = 2 + len(WINDOWS)
#: Discounts stay between this and just below the count; fewer than four counts of counts tell nothing.
LEAST_DISCOUNT = 0.1
#: A word's difference is cut to this, so that sums of exponents stay finite.
REACH = 12.0
#: Labelled rows to which the logistic function is fitted, at most; drawn by the hash of the id.
FIT_ROWS = 200_000
#: Rows of the table that are sent to the tasks: 48 MB in each. The others are joined.
MOST_SENT = 3_000_000
#: Bits of the filter for rows that are not sent: 32 MB.
FILTER_BITS = 1 << 28
_HELD_WORDS = 200_000
_HELD_COUNTS = 150_000
_LONG = 1 << 20
_WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")


def tokens(text: bytes) -> Iterator[bytes]:
    text = text.lower()
    return iter(_WORD.findall(text)) if len(text) < _LONG else (m.group() for m in _WORD.finditer(text))


def _stem(word: bytes) -> bytes:
    """The class of words that begin alike."""
    return word[:STEM] + b"*"


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


WORDS = "word long, stem long, toxic long, ordinary long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their stems and counts by class, summed up to a bound of held words."""
    counts = (Counter(), Counter())

    def flushed() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        columns = [[_hash(w) for w in words], [_hash(_stem(w)) for w in words], [counts[1][w] for w in words], [counts[0][w] for w in words]]
        for c in counts:
            c.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["word", "stem", "toxic", "ordinary"])

    for batch in batches:
        for text, label in zip(text_bytes(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            counts[label].update(tokens(text))
            if len(counts[0]) + len(counts[1]) > _HELD_COUNTS:
                yield flushed()
    yield flushed()


@dataclass
class Smoothing:
    """Discounts for counts of 0, 1, 2 and more, of words and of stems; the toxic share of all stems."""

    word: np.ndarray
    stem: np.ndarray
    share: float


def discounts(of_counts: list[int]) -> np.ndarray:
    """From the numbers of expressions counted once, twice, three and four times in a class."""
    one, two, three, four = (max(n, 1) for n in of_counts)
    once = one / (one + 2 * two)
    found = [1 - 2 * once * two / one, 2 - 3 * once * three / two, 3 - 4 * once * four / three]
    return np.array([0.0, *(min(max(d, LEAST_DISCOUNT), n + 0.95) for n, d in enumerate(found))])


def _smoothing(words: DataFrame, stems: DataFrame) -> Smoothing:
    def of(table: DataFrame, *names: str) -> np.ndarray:
        hits = [sum((F.count_if(F.col(c) == n) for c in names[1:]), F.count_if(F.col(names[0]) == n)) for n in (1, 2, 3, 4)]
        return discounts([h or 0 for h in table.agg(*hits).first()])

    toxic, ordinary = stems.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("ordinary") > 0)).first()
    return Smoothing(of(words, "toxic", "ordinary"), of(stems, "toxic", "ordinary"), (toxic + 0.5) / (toxic + ordinary + 1))


def shares(toxic: np.ndarray, ordinary: np.ndarray, behind: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """The smoothed toxic share of expressions with these counts; where there are none, what is behind."""
    d_toxic, d_ordinary = discount[np.minimum(toxic, 3)], discount[np.minimum(ordinary, 3)]
    total = toxic + ordinary
    return np.where(total > 0, (toxic - d_toxic + (d_toxic + d_ordinary) * behind) / np.maximum(total, 1), behind)


class Rows:
    """Counts (toxic, ordinary) by key, in order of the key; a missing key has none."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        self.keys, self.toxic, self.ordinary = keys, toxic, ordinary

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each key, and whether it is there."""
        if not len(self.keys):
            none = np.zeros(len(wanted), np.int64)
            return none, none, none > 0
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        same = self.keys[at] == wanted
        return np.where(same, self.toxic[at], 0).astype(np.int64), np.where(same, self.ordinary[at], 0).astype(np.int64), same


class WordRows(dict):
    """Numbers by word for the arrays of hashes, counts and differences of the words seen; starts afresh when it is full."""

    def __init__(self, sent: Rows, smoothing: Smoothing):
        super().__init__()
        self.sent, self.smoothing = sent, smoothing
        self.fresh: list[bytes] = []
        # Word and stem hash; counts of the word and of its stem; whether word and stem are among the rows sent.
        self.longs = np.zeros((6, _HELD_WORDS), np.int64)
        self.known = np.zeros((2, _HELD_WORDS), bool)
        self.value = np.zeros(_HELD_WORDS)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        self.fresh.append(word)
        return value

    def numbered(self, text: bytes) -> np.ndarray:
        """The numbers of the words in order; good until the next call."""
        if len(self) > _HELD_WORDS // 2:
            self.clear()
        out = np.fromiter(map(self.__getitem__, tokens(text)), np.int64)
        if self.fresh:
            self._learn(len(self) - len(self.fresh), len(self))
        return out

    def _learn(self, first: int, end: int) -> None:
        while end > self.longs.shape[1]:
            # A single text may have more different words than are held.
            self.longs, self.known, self.value = np.tile(self.longs, 2), np.tile(self.known, 2), np.tile(self.value, 2)
        part = slice(first, end)
        self.longs[0, part] = [_hash(w) for w in self.fresh]
        self.longs[1, part] = [_hash(_stem(w)) for w in self.fresh]
        self.fresh = []
        for k in (0, 1):
            self.longs[2 + 2 * k, part], self.longs[3 + 2 * k, part], self.known[k, part] = self.sent.find(self.longs[k, part])
        self.value[part] = _differences(self.smoothing, *self.longs[2:, part])


def _differences(smoothing: Smoothing, toxic, ordinary, stem_toxic, stem_ordinary) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) for words of these counts."""
    stem = shares(stem_toxic, stem_ordinary, np.full(len(toxic), smoothing.share), smoothing.stem)
    share = shares(toxic, ordinary, stem, smoothing.word)
    return np.clip(np.log(share / smoothing.share) - np.log((1 - share) / (1 - smoothing.share)), -REACH, REACH)


def evidence(differences: np.ndarray) -> list[float]:
    """Mean and spread of the words' differences, and for each window length the log of the mean likelihood ratio.

    A text shorter than a window is one window. A text without words has no evidence.
    """
    if not len(differences):
        return [0.0] * FEATURES
    out = [float(differences.mean()), float(differences.std())]
    sums = np.concatenate([[0.0], np.cumsum(differences)])
    for width in WINDOWS:
        each = sums[width:] - sums[:-width] if len(differences) >= width else sums[-1:]
        most = each.max()
        out.append(float(most + math.log(np.exp(each - most).mean())))
    return out


class ToxicityModel:
    """The rows at hand in a task: those sent to it and, for one text, those joined to it."""

    def __init__(self, sent: Rows, smoothing: Smoothing):
        self.smoothing, self.words = smoothing, WordRows(sent, smoothing)

    def missing(self, text: bytes, bits: np.ndarray) -> np.ndarray:
        """The distinct keys of a text that are not among the rows sent and that the filter lets pass."""
        numbers = np.unique(self.words.numbered(text))
        keys = np.unique(np.concatenate([self.words.longs[k, numbers[~self.words.known[k, numbers]]] for k in (0, 1)]))
        return keys[_passes(bits, keys)]

    def evidence(self, text: bytes, joined: Rows | None = None, label: int | None = None) -> list[float]:
        """Of a text; with a label, of one that was learnt, whose own counts are taken out."""
        numbers = self.words.numbered(text)
        if joined is None and label is None:
            return evidence(self.words.value[numbers])
        distinct, place, own = np.unique(numbers, return_inverse=True, return_counts=True)
        hashes, counts = self.words.longs[:2, distinct], self.words.longs[2:, distinct].copy()
        if joined is not None:
            for k in (0, 1):
                toxic, ordinary, found = joined.find(hashes[k])
                counts[2 * k, found], counts[2 * k + 1, found] = toxic[found], ordinary[found]
        if label is not None:
            row = 0 if label else 1
            counts[row] = np.maximum(counts[row] - own, 0)
            # A word that only this text has in its class is one word less of its stem.
            gone = np.flatnonzero(counts[row] == 0)
            stems, at = np.unique(hashes[1], return_inverse=True)
            counts[2 + row] = np.maximum(counts[2 + row] - np.bincount(at[gone], minlength=len(stems))[at], 0)
        return evidence(_differences(self.smoothing, *counts)[place])


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter, as 64-bit cells, has the bit of each key."""
    place = keys & (64 * len(bits) - 1)
    return (bits[place >> 6].view(np.uint64) >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0


def _filter(keys: DataFrame, count: int) -> np.ndarray:
    """A bit filter of the keys with about eight bits each, at most ``FILTER_BITS``."""
    size = min(FILTER_BITS, max(1 << 10, 1 << (8 * count).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(size - 1))
    cells = keys.groupBy(F.shiftright(place, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    # At most FILTER_BITS / 64 rows.
    found = cells.toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return bits


class Scorer:
    """The models of ``learnt`` (text, label), ready to give the evidence of texts."""

    def __init__(self, learnt: DataFrame):
        counted = learnt.select("text", "label").mapInArrow(sparing(_word_counts), WORDS)
        words = written(
            counted.groupBy("word", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxicity-words"
        )
        kinds = [F.count_if(F.col(c) > 0).alias(c) for c in ("toxic", "ordinary")]
        stems = written(words.groupBy("stem").agg(*kinds), "toxicity-stems")
        self.smoothing = _smoothing(words, stems)
        columns = ["toxic", "ordinary"]
        table = words.select(F.col("word").alias("key"), *columns).unionAll(stems.select(F.col("stem").alias("key"), *columns))
        # Frequencies in sixteenths of a power of two: as many of the highest as may be sent.
        level = F.floor(F.log2(F.col("toxic") + F.col("ordinary")) * 16)
        least = held = 0
        for row in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
            held += row["count"]
            if held > MOST_SENT:
                least = row["level"] + 1
                break
        self.context = learnt.sparkSession.sparkContext
        top = table.where(level >= least).toArrow()
        keys = top["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        # Counts beyond 32 bits change no share.
        counts = [np.minimum(top[c].to_numpy()[order], 2**32 - 1).astype(np.uint32) for c in columns]
        self.sent = self.context.broadcast((keys[order], *counts))
        self.rest = written(table.where(level < least), "toxicity-rest") if held > MOST_SENT else None

    def evidence(self, rows: DataFrame, kept: list[str], label: str | None = None) -> DataFrame:
        """``kept`` columns and ``evidence`` of each row with a ``text``; with ``label``, of rows learnt from."""
        sent, smoothing = self.sent, self.smoothing

        def model() -> ToxicityModel:
            return ToxicityModel(Rows(*sent.value), smoothing)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = model()
            for batch in batches:
                labels = batch.column(label).to_pylist() if label else [None] * batch.num_rows
                own = [None] * batch.num_rows
                if "joined" in batch.schema.names:
                    own = [_own_rows(j) for j in batch.column("joined").to_pylist()]
                found = [held.evidence(t, j, y) for t, j, y in zip(text_bytes(batch.column("text")), own, labels, strict=True)]
                yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(found, pa.list_(pa.float64()))], [*kept, "evidence"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", evidence array<double>"
        return (rows if self.rest is None else self._joined(rows, model)).mapInArrow(sparing(scored), schema)

    def _joined(self, rows: DataFrame, model) -> DataFrame:
        """``rows`` with the rows of the rest of the table that each text needs."""
        bits = self.context.broadcast(_filter(self.rest, self.rest.count()))

        def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = model()
            for batch in batches:
                for row, text in zip(batch.column("row").to_pylist(), text_bytes(batch.column("text")), strict=True):
                    keys = held.missing(text, bits.value)
                    yield pa.record_batch([pa.array(np.full(len(keys), row)), pa.array(keys)], ["row", "key"])

        numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
        found = (
            numbered.select("row", "text").mapInArrow(lacking, "row long, key long").join(self.rest, "key")
            .groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("key", "toxic", "ordinary")).alias("joined"))
        )
        return numbered.join(found, F.col("row") == F.col("_row"), "left").drop("row", "_row")


def _own_rows(joined: list[dict] | None) -> Rows | None:
    if not joined:
        return None
    columns = [np.array([x[c] for x in joined], np.int64) for c in ("key", "toxic", "ordinary")]
    order = np.argsort(columns[0])
    return Rows(*(c[order] for c in columns))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of the chance of label 1: Newton steps on scaled columns, pulled to 0 with weight 1."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-12] = 1.0
    columns = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    pull = np.eye(columns.shape[1])
    pull[-1, -1] = 1e-6
    beta = np.zeros(columns.shape[1])
    for _ in range(60):
        chance = 1 / (1 + np.exp(-np.clip(columns @ beta, -30, 30)))
        curve = (columns * (chance * (1 - chance))[:, None]).T @ columns + pull
        step = np.linalg.solve(curve, columns.T @ (y - chance) - pull @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    weights = beta[:-1] / scale
    return weights, float(beta[-1] - weights @ mean)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    divisor: int = DIVISOR,
    held_out: int = HELD_OUT,
    cut: float = CUT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learnt from rows whose id's remainder is not ``held_out``. The score is
    the chance of label 1. Null and empty texts, and texts without letters or digits,
    have no evidence and all the same score. Rows without id are never learnt from and not
    held out. Repeated rows are scored alike; a document with several labels counts by their mean;
    other columns are not read. Without labels of both kinds every score is 0.5.
    """
    named = written(one_label(labels, doc_id, label), "toxicity-labels")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    usable = named.where(remainder("labelled_id", divisor) != held_out)
    learnt = rows.join(sent_if_small(usable, 1_000_000), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")
    by_label = dict(learnt.groupBy("label").count().collect())
    if len(by_label) < 2:
        score = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scorer = Scorer(learnt)
        slots = 1 << 30
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < min(slots, slots * FIT_ROWS // sum(by_label.values()))
        # Bounded by FIT_ROWS, in expectation.
        fitted = scorer.evidence(learnt.where(drawn), ["label"], "label").toArrow()
        weights, offset = logistic(np.array(fitted["evidence"].to_pylist(), float).reshape(-1, FEATURES), fitted["label"].to_numpy().astype(float))
        found = scorer.evidence(rows, ["doc_id"])
        logit = F.lit(offset)
        for k, weight in enumerate(weights):
            logit = logit + F.get("evidence", F.lit(k)) * float(weight)
        score = found.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("score"))
    return score.select(
        "doc_id",
        (remainder("doc_id", divisor) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns stay as they are.

    Rows that share an id go together if one of them is toxic; rows without id stay.
    """
    verdicts = score_toxicity(docs, labels, doc_id, text).where("predicted = 1").select(F.col("doc_id").alias("_gone")).distinct()
    gone = sent_if_small(written(verdicts, "toxic"), 500_000)
    return docs.join(gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")
