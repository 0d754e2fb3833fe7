"""Token counts of texts of any length, exactly as the tokenizer's library gives them.

A short text is encoded as a whole, for word BPE run by run as token files are. A long one is cut into chunks that overlap, which are
encoded in different tasks, with offsets. Two neighbours are spliced inside their overlap, at
a place where both have a token edge and where the tokenizer provably cuts in any context;
then the count is that of the one chunk up to the place and of the other from it on. Where an
overlap has no such place, its text is cut again into chunks and overlaps ``WIDEN`` times as long;
at last the text is a single chunk, so every count is exact.

The proof looks at the two characters beside a place (see ``stable_places``) and holds for
word BPE tokenizers that drop white space (``token_files.separable``). For other tokenizer
files no place is proven and every text is encoded whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.text import text_bytes
from talkloom.llm.token_files import _encoder, id_kind, separable
from talkloom.sources.scratch import written

LIMIT = 2048
#: Characters of a chunk and of an overlap in the first round, and what a further round multiplies both by.
CHUNK, OVERLAP, WIDEN = 32_768, 512, 8
#: From this chunk length on a text is one chunk.
WHOLE = 1 << 31
#: Chunks that one task encodes: about 16 MB of text.
CHUNKS_A_TASK = 512
#: Texts handed to the tokenizer at a time.
_AT_A_TIME = 64

# Classes of characters whose class holds in any context; 0 is none of them.
UNSURE, SPACE, LETTER, DIGIT, OTHER, APOSTROPHE = range(6)
_TABLE = 0xD7A4


@cache
def _classes() -> np.ndarray:
    """The class by code point. Marks, jamo, and characters that composing, lower-casing or the Unicode version may change are unsure."""
    old = unicodedata.ucd_3_2_0
    found = np.zeros(_TABLE, np.int8)
    for code in range(_TABLE):
        char = chr(code)
        lower = char.lower()
        kind = unicodedata.category(char)
        if len(lower) != 1 or unicodedata.combining(char) or 0x1100 <= code <= 0x11FF or kind != old.category(char):
            continue
        if unicodedata.normalize("NFC", char) != char or unicodedata.category(lower)[0] != kind[0]:
            continue
        found[code] = {"L": LETTER, "N": DIGIT, "P": OTHER, "S": OTHER}.get(kind[0], UNSURE)
    found[[ord(c) for c in " \t\n\v\f\r"]] = SPACE
    found[ord("'")] = APOSTROPHE
    return found


def stable_places(text: str, specials: tuple[str, ...]) -> np.ndarray:
    """Places p where a token begins at p in every text that has these neighbours, and nothing before p bears on what follows.

    The splitter takes runs of letters, single digits, runs of other signs, and
    contractions, which begin with an apostrophe. So a run ends for certain where the class
    changes, except behind an apostrophe; a digit stands alone; white space is in no
    token. No composition crosses p, as both neighbours are characters that never
    compose with what is before them. Places inside a special string, or so near an end
    that one may reach across it, are left out.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = np.where(codes < _TABLE, _classes()[np.minimum(codes, _TABLE - 1)], UNSURE)
    before, after = kinds[:-1], kinds[1:]
    sure = (before != UNSURE) & (after != UNSURE) & (after != SPACE)
    sign = (before == OTHER) | (before == APOSTROPHE)
    inside = ((before == LETTER) & (after == LETTER)) | (sign & ((after == OTHER) | (after == APOSTROPHE))) | ((before == APOSTROPHE) & (after == LETTER))
    places = np.flatnonzero(sure & ~inside) + 1
    margin = max(map(len, specials), default=1)
    places = places[(places >= margin) & (places <= len(text) - margin)]
    for special in specials:
        start = text.find(special)
        while start >= 0:
            places = places[(places <= start) | (places >= start + len(special))]
            start = text.find(special, start + 1)
    return places


class Counter:
    """A tokenizer file of either library: counts of texts, and for splicing the edges of a chunk's tokens."""

    def __init__(self, path: str):
        # One thread a task: Spark shares out the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.splits = False
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            self.counts: Callable[[list[str]], list[int]] = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.tokenizer = tokenizer
        self.splits = separable(tokenizer.to_str())
        self.specials = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        if self.splits:
            # Run by run, with the ids of known runs kept: a text's words are mostly known ones.
            encode, kind = _encoder(path, id_kind(path)), np.dtype(id_kind(path))
            self.counts = lambda texts: [len(encode(t.encode(errors="replace"))) // kind.itemsize for t in texts]
        else:
            self.counts = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def edges(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of tokens; the proven places at which one begins; the tokens before each."""
        found = self.tokenizer.encode(text, add_special_tokens=False).offsets
        spans = np.array(found, np.int64).reshape(-1, 2)
        starts, ends = spans[:, 0], spans[:, 1]
        places = stable_places(text, self.specials)
        before = np.searchsorted(starts, places, "left")
        here = before < len(starts)
        places, before = places[here], before[here]
        # A token starts at the place and none reaches across it.
        reach = np.maximum.accumulate(np.append(0, ends))[before] if len(places) else before
        edge = (starts[before] == places) & (reach <= places)
        return len(starts), places[edge], before[edge]


#: Tokenizers of this Python worker, which serves many tasks.
_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for start in range(0, batch.num_rows, _AT_A_TIME):
                part = batch.slice(start, _AT_A_TIME)
                texts = [t.decode(errors="replace") for t in text_bytes(part.column("text"))]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(counter.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


CHUNKS = "row long, doc_id long, n_bytes long, chunk long, last boolean, text string"


def _cut(chunk: int, overlap: int):
    """Rows (row, doc_id, n_bytes, text) to chunks of ``chunk`` characters and the ``overlap`` after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes")), strict=True)
            for (row, doc, size), data in zip(keys, text_bytes(batch.column("text")), strict=True):
                text = data.decode(errors="replace")
                count = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(count):
                    last = k == count - 1
                    part = text[k * chunk :] if last else text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.record_batch([pa.array([v], t) for v, t in ((row, pa.int64()), (doc, pa.int64()), (size, pa.int64()), (k, pa.int64()), (last, pa.bool_()), (part, pa.string()))], ["row", "doc_id", "n_bytes", "chunk", "last", "text"])

    return run


EDGES = "row long, doc_id long, n_bytes long, chunk long, last boolean, n long, left_at array<long>, left_before array<long>, right_at array<long>, right_before array<long>"


def _encoded(path: str, chunk: int, overlap: int):
    """Per chunk its number of tokens and its edges in the overlaps; places count from the start of the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            rows = []
            for k, last, data in zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist(), text_bytes(batch.column("text")), strict=True):
                text = data.decode(errors="replace")
                if last and not k:
                    rows.append((counter.counts([text])[0], [], [], [], []))
                    continue
                total, places, before = counter.edges(text)
                left = places < (overlap if k else 0)
                right = places >= (len(text) if last else chunk)
                rows.append((total, places[left], before[left], places[right] - chunk, before[right]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4]
            kept = [batch.column(c) for c in ("row", "doc_id", "n_bytes", "chunk", "last")]
            yield pa.record_batch([*kept, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["row", "doc_id", "n_bytes", "chunk", "last", "n", "left_at", "left_before", "right_at", "right_before"])

    return run


def _spliced(edges: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens, failed) of each text; failed counts the overlaps without a common proven place."""
    right = edges.where(~F.col("last")).select("row", F.col("chunk").alias("cut"), "right_at", "right_before")
    left = edges.where("chunk > 0").select("row", (F.col("chunk") - 1).alias("cut"), "left_at", "left_before")
    common = right.join(left, ["row", "cut"]).withColumn("at", F.array_min(F.array_intersect("right_at", "left_at")))

    def tokens_before(side: str):
        place = F.array_position(f"{side}_at", F.col("at")).cast("int")
        return F.when(F.col("at").isNotNull(), F.element_at(f"{side}_before", place))

    gains = common.select("row", (tokens_before("right") - tokens_before("left")).alias("n"), F.col("at").isNull().cast("long").alias("failed"))
    ends = edges.where("last").select("row", "doc_id", "n_bytes", "n")
    sums = gains.groupBy("row").agg(F.sum("n").alias("gained"), F.sum("failed").alias("failed"))
    return ends.join(sums, "row", "left").select(
        "row", "doc_id", "n_bytes", (F.col("n") + F.coalesce("gained", F.lit(0))).alias("n_tokens"), F.coalesce("failed", F.lit(0)).alias("failed")
    )


def _long_counts(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts (row, doc_id, n_bytes, text), chunk by chunk, in as many rounds as it takes."""
    settled: list[DataFrame] = []
    while True:
        pieces = written(long.mapInArrow(_cut(chunk, overlap), CHUNKS), "token-chunks")
        tasks = -(-pieces.count() // CHUNKS_A_TASK)
        if not tasks and not settled:
            return long.selectExpr("doc_id", "n_bytes", "0L as n_tokens").limit(0)
        edges = written(pieces.repartition(max(tasks, 2 * long.sparkSession.sparkContext.defaultParallelism), "row", "chunk").mapInArrow(_encoded(path, chunk, overlap), EDGES), "token-edges")
        spliced = written(_spliced(edges), "token-splices")
        settled.append(spliced.where("failed = 0").select("doc_id", "n_bytes", "n_tokens"))
        failed = spliced.where("failed > 0").select("row")
        if failed.isEmpty():
            break
        core = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk))
        # The chunks of one text meet again: it was one value before.
        long = (
            pieces.join(failed, "row", "left_semi").groupBy("row", "doc_id", "n_bytes")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", core.alias("t")))), lambda x: x["t"]), "").alias("text"))
        )
        chunk, overlap = min(chunk * WIDEN, WHOLE), min(overlap * WIDEN, WHOLE)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionAll(more)
    return out


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a ``.json`` file of tokenizers or a ``.model`` file of
    sentencepiece, which all executors can read. No begin, end or other special token is added; special
    strings inside a text are what the library makes of them. Null and empty texts
    have 0 bytes and tokens. Null and repeated ids, and repeated rows, are rows like any
    other. Other columns are not read.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"), content.alias("text"))
    if _counter(tokenizer).splits:
        # At least as many bytes as characters: a text below this has one chunk in any case.
        is_long = F.col("n_bytes") > chunk + overlap
        long = rows.where(is_long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "n_bytes", "text")
        counts = rows.where(~is_long).mapInArrow(_whole(tokenizer), "doc_id long, n_bytes long, n_tokens long").unionAll(_long_counts(long, tokenizer, chunk, overlap))
    else:
        counts = rows.mapInArrow(_whole(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
