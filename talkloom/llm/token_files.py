"""Token-id files with a minimal perfect hash index over the document keys.

``write_tokens`` leaves in one folder: ``ids-<shard>.bin``, the raw little-endian ids of
documents in ascending doc_id order (2 bytes an id if the vocabulary allows it, else 4);
``shards``, a Parquet table with the number of ids before each file; and
``index-<bucket>.mph``, which maps a key to its shard, offset and length in constant time.

A bucket of the index holds about ``BUCKET_KEYS`` keys. Its minimal perfect hash is a
cascade of bit arrays (Limasset et al. 2017): a key that is alone at its place in a
level is placed there, the others go to the next level, and the rank of a key's bit is
its slot. A slot stores a 32-bit fingerprint, so that an unknown key is told apart.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.stores import committed, filesystem, sent_if_small
from talkloom.llm.text import mix, text_bytes
from talkloom.sources.scratch import written

END_ID = 2
SHARD_BYTES = 128 << 20
BUCKET_KEYS = 50_000
LEVELS = 48
#: Room for keys in a level, as a multiple of the keys that reach it.
ROOM = 2
#: Index files that one look-up task loads, and bytes of ids that one task reads, where there are many.
BUCKETS_A_TASK, TASK_BYTES = 16, 64 << 20
_CHUNKS_KEPT, _PARTS_KEPT = 300_000, 500_000


#: The characters that byte-level vocabularies write for the bytes 0 to 255: printable ones stand for themselves.
_PLAIN_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = (chr(256 + k) for k in range(256))
_BYTE_CHARS = str.maketrans({b: chr(b) if b in _PLAIN_BYTES else next(_OTHERS) for b in range(256)})
#: Stops, which split off a word before them. Signs of special tokens and the apostrophe of contractions are not among them.
_STOPS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'


class KnownIds(dict):
    """Ids as bytes by piece of text, kept; it starts afresh when it is full."""

    def __init__(self, encode: Callable[[str], list[int]], kind: str):
        super().__init__()
        self.encode, self.kind = encode, kind

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _PARTS_KEPT:
            self.clear()
        value = self[piece] = np.array(self.encode(piece), self.kind).tobytes()
        return value


class ChunkIds(dict):
    """Encoded ids of runs of non-space bytes, kept; it starts afresh when it is full.

    A tokenizer whose normaliser and splitter never look past ASCII white space gives
    the same ids for a text as for its runs one by one; ``separable`` says whether a
    tokenizer file is of that kind. A run of Latin letters is one pre-token, alone or
    before stops: lower-cased and in byte characters it goes straight to the
    tokenizer's model. Latin letters up to U+024F have no parts to compose. All other
    runs pass through the whole tokenizer.
    """

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        model = tokenizer.model
        self.words = KnownIds(
            lambda w: [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS))], kind
        )
        self.others = KnownIds(lambda part: tokenizer.encode(part, add_special_tokens=False).ids, kind)

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= _CHUNKS_KEPT:
            self.clear()
        text = chunk.decode(errors="replace")
        bare = text.rstrip(_STOPS)
        word = bare.lower()
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            value = self.words[word]
            if len(bare) < len(text):
                value += self.others[text[len(bare) :]]
        else:
            value = self.others[text]
        self[chunk] = value
        return value


def separable(tokenizer_json: str) -> bool:
    """Whether white space and case are dropped, no step sees across white space and runs of letters are whole: the case of word BPE."""
    spec = json.loads(tokenizer_json)

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part.get(name, [part])

    splits, model = steps(spec["pre_tokenizer"], "pretokenizers"), spec["model"]
    plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"], s.get("content")) == ("Replace", " ") for s in steps(spec["normalizer"], "normalizers"))
    plain = plain and any(s["type"] == "Lowercase" for s in steps(spec["normalizer"], "normalizers"))
    if [s["type"] for s in splits] != ["Split", "ByteLevel"]:
        return False
    first, second = splits
    pattern = first["pattern"].get("Regex", "")
    drops = first["behavior"] == "Removed" and first["invert"] and "\\s" in pattern and "|[\\p{L}]+|" in pattern
    drops = drops and not second["add_prefix_space"] and not second.get("use_regex", True)
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].isalpha()) and "<" in t["content"] and not any(c.isspace() for c in t["content"])
        for t in spec["added_tokens"]
    )
    return bool(plain and drops and added and spec["post_processor"] is None and model["type"] == "BPE" and not model["dropout"])


#: Encoders of this Python worker, which serves many tasks: known words stay known.
_ENCODERS: dict[tuple[str, str], Callable[[bytes], bytes]] = {}


def _encoder(path: str, kind: str) -> Callable[[bytes], bytes]:
    """text bytes -> ids as bytes, without the end id."""
    if (path, kind) not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        if separable(tokenizer.to_str()):
            known = ChunkIds(tokenizer, kind)
            _ENCODERS[path, kind] = lambda text: b"".join(map(known.__getitem__, text.split()))
        else:
            _ENCODERS[path, kind] = lambda text: np.array(
                tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, kind
            ).tobytes()
    return _ENCODERS[path, kind]


def id_kind(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def key_hash(ids: np.ndarray, copies: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64 bits for each key (doc_id or null, number among the rows of that id)."""
    value = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    value = np.where(null, np.uint64(0x1B873593CC9E2D51), value)
    return mix(value ^ (copies.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _writer(folder: str, tokenizer: str, kind: str, end_id: int, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, kind)
        end = np.array([end_id], kind).tobytes()
        width = len(end)
        part, number = TaskContext.get().partitionId(), -1
        last, copy = object(), 0
        stream = context = None
        offset = shard_bytes
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(ids, text_bytes(batch.column("text")), strict=True):
                if offset >= shard_bytes:
                    if context:
                        context.__exit__(None, None, None)
                    number, offset = number + 1, 0
                    shard = f"{part:06d}-{number:05d}"
                    context = committed(f"{folder}/ids-{shard}.bin")
                    stream = context.__enter__()
                copy = copy + 1 if doc == last else 0
                last = doc
                data = encode(text) + end
                stream.write(data)
                rows.append((doc, copy, shard, offset, len(data) // width))
                offset += len(data)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            null = np.array([d is None for d in columns[0]], bool)
            hashed = key_hash(np.array([d or 0 for d in columns[0]], np.int64), np.array(columns[1], np.int64), null)
            yield pa.record_batch(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.string()),
                    pa.array(columns[3], pa.int64()),
                    pa.array(columns[4], pa.int64()),
                    pa.array(hashed.view(np.int64)),
                ],
                ["doc_id", "copy", "shard", "offset", "n_tokens", "key"],
            )
        if context:
            context.__exit__(None, None, None)

    return write


def minimal_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits, and the slot of each key: the slots are 0 .. len(keys) - 1."""
    levels, slots, before = [], np.zeros(len(keys), np.int64), 0
    left = np.arange(len(keys))
    for level in range(LEVELS):
        if not len(left):
            return levels, slots
        room = max(64, ROOM * len(left))
        place = _place(keys[left], level, room)
        alone = np.bincount(place, minlength=room) == 1
        levels.append(alone)
        here = alone[place]
        slots[left[here]] = before + np.cumsum(alone)[place[here]] - 1
        before += int(alone.sum())
        left = left[~here]
    raise ValueError("two keys of one bucket have the same 64-bit hash")


def _place(keys: np.ndarray, level: int, room: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(room)).astype(np.int64)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


#: One rank is kept for so many bits; a look-up counts the bits of one block.
_BLOCK_BITS = 512
_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<i8"), ("length", "<i8")])
_HEAD = np.dtype([("levels", "<u4"), ("blocks", "<u4"), ("slots", "<u4"), ("names", "<u4"), ("width", "<u4")])


class Section:
    """Numbers of one kind in a file, read by their places: a few bytes for each."""

    def __init__(self, source, start: int, count: int, kind):
        self.source, self.start, self.count, self.kind = source, start, count, np.dtype(kind)
        self.end = start + count * self.kind.itemsize

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), self.kind)
        for k, place in enumerate(places.tolist()):
            out[k] = self.range(place, 1)[0]
        return out

    def range(self, place: int, count: int) -> np.ndarray:
        self.source.seek(self.start + place * self.kind.itemsize)
        return np.frombuffer(self.source.read(count * self.kind.itemsize), self.kind)


class BucketIndex:
    """One index file: where each key's ids are.

    The file holds its sizes, the places of each level, the levels' bits in blocks of 512, for each block the
    number of bits before it, a record for each slot, and the shard names. A look-up reads,
    for each level it comes to, one block and one rank, and then one record: as much
    for a large bucket as for a small one. Levels are passed with the same chance
    each, so two are read on average.
    """

    def __init__(self, source, whole: bool):
        """``source`` is an open file; ``whole`` reads it at once, for many look-ups."""
        if whole:
            source = io.BytesIO(source.read())
        head = Section(source, 0, 1, _HEAD).range(0, 1)[0]
        rooms = Section(source, _HEAD.itemsize, int(head["levels"]), "<i8")
        self.rooms = rooms.range(0, rooms.count)
        self.words = Section(source, rooms.end, int(head["blocks"]) * (_BLOCK_BITS // 64), "<u8")
        self.ranks = Section(source, self.words.end, int(head["blocks"]), "<u4")
        self.slots = Section(source, self.ranks.end, int(head["slots"]), _SLOT)
        self.names = Section(source, self.slots.end, int(head["names"]), f"S{head['width']}")
        self.first_blocks = np.concatenate([[0], np.cumsum(-(-self.rooms // _BLOCK_BITS))]).astype(np.int64)
        if whole:
            self.words, self.ranks, self.slots, self.names = (x.range(0, x.count) for x in (self.words, self.ranks, self.slots, self.names))

    @staticmethod
    def build(keys, shards, offsets, lengths) -> bytes:
        """The bytes of an index file."""
        levels, slots = minimal_hash(keys)
        names, codes = np.unique(np.asarray(shards, "U"), return_inverse=True)
        records = np.empty(len(keys), _SLOT)
        records["fingerprint"][slots], records["shard"][slots] = _fingerprints(keys), codes
        records["offset"][slots], records["length"][slots] = offsets, lengths
        bits = np.concatenate([np.zeros(0, bool), *(np.pad(x, (0, -len(x) % _BLOCK_BITS)) for x in levels)])
        ones = bits.reshape(-1, _BLOCK_BITS).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        text = np.array([n.encode() for n in names.tolist()] or [b"-"])
        head = np.array([(len(levels), len(ones), len(keys), len(text), text.itemsize)], _HEAD)
        rooms = np.array([len(x) for x in levels], "<i8")
        words = np.packbits(bits, bitorder="little").tobytes()
        return b"".join([head.tobytes(), rooms.tobytes(), words, ranks.astype("<u4").tobytes(), records.tobytes(), text.tobytes()])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``keys`` of those that the fingerprints know, and their records."""
        slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, room in enumerate(self.rooms.tolist()):
            if not len(left):
                break
            bit = _place(keys[left], level, room) + self.first_blocks[level] * _BLOCK_BITS
            here = (self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
            slots[left[here]] = self._rank(bit[here])
            left = left[~here]
        places = np.flatnonzero(slots >= 0)
        records = self.slots[slots[places]]
        same = records["fingerprint"] == _fingerprints(keys[places])
        return places[same], records[same]

    def shards(self, records: np.ndarray) -> list[str]:
        """The shard name of each record."""
        return [name.decode() for name in self.names[records["shard"].astype(np.int64)].tolist()]

    def _rank(self, bits: np.ndarray) -> np.ndarray:
        """The number of bits set before each of ``bits``."""
        block, word = bits // _BLOCK_BITS, (bits % _BLOCK_BITS) >> 6
        out = self.ranks[block].astype(np.int64)
        for k in range(_BLOCK_BITS // 64):
            value = self.words[block * (_BLOCK_BITS // 64) + k]
            mask = np.where(word > k, np.uint64(2**64 - 1), np.where(word == k, (np.uint64(1) << (bits & 63).astype(np.uint64)) - np.uint64(1), np.uint64(0)))
            out += np.bitwise_count(value & mask)
        return out


@dataclass
class TokenFiles:
    """A written folder: ``entries`` has a row per document, ``shards`` (shard, shard_start) one per file.

    Entries are doc_id, copy, key, bucket, shard, offset in bytes and n_tokens.
    """

    spark: SparkSession
    folder: str
    kind: str
    buckets: int
    entries: DataFrame
    shards: DataFrame

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, shard, offset, n_tokens, start) of ``keys`` (doc_id, copy, key, bucket) by the index; unknown keys drop out."""
        folder = self.folder

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, loaded = None, None
            for batch in batches:
                buckets = np.asarray(batch.column("bucket"))
                hashed = np.asarray(batch.column("key")).view(np.uint64)
                for bucket in np.unique(buckets):
                    rows = np.flatnonzero(buckets == bucket)
                    if loaded != bucket:
                        system, path = filesystem(f"{folder}/index-{bucket:06d}.mph")
                        with system.open_input_file(path) as source:
                            index, loaded = BucketIndex(source, whole=True), bucket
                    known, records = index.find(hashed[rows])
                    kept = batch.select(["doc_id", "copy"]).take(pa.array(rows[known]))
                    yield pa.record_batch(
                        [
                            *kept.columns,
                            pa.array(index.shards(records), pa.string()),
                            pa.array(records["offset"].astype(np.int64)),
                            pa.array(records["length"].astype(np.int64)),
                        ],
                        ["doc_id", "copy", "shard", "offset", "n_tokens"],
                    )

        # As many tasks as there are cores or, at some buckets each, more; a stated number is kept.
        tasks = max(1, min(self.buckets, max(self.spark.sparkContext.defaultParallelism, self.buckets // BUCKETS_A_TASK)))
        near = keys.select("doc_id", "copy", "key", "bucket").repartition(tasks, "bucket").sortWithinPartitions("bucket")
        found = near.mapInArrow(look_up, "doc_id long, copy long, shard string, offset long, n_tokens long")
        ids_before = (F.col("offset") / np.dtype(self.kind).itemsize).cast("long")
        return found.join(sent_if_small(self.shards, 1_000_000), "shard").select(*found.columns, (F.col("shard_start") + ids_before).alias("start"))

    def read(self, located: DataFrame, make=None, schema: str = "ids array<long>") -> DataFrame:
        """``located`` with ``make(ids)`` of each document, by default the ids themselves.

        Rows are put into file order first, so that files are read forwards.
        """
        folder, kind = self.folder, np.dtype(self.kind)
        names = located.columns

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source, opened = None, None
            for batch in batches:
                values = []
                places = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens")), strict=True)
                for shard, offset, length in places:
                    if shard != opened:
                        if source:
                            source.close()
                        system, path = filesystem(f"{folder}/ids-{shard}.bin")
                        source, opened = system.open_input_file(path), shard
                    source.seek(offset)
                    ids = np.frombuffer(source.read(length * kind.itemsize), kind)
                    values.append(make(ids) if make else ids.tolist())
                yield pa.record_batch([*batch.columns, pa.array(values, pa.int64() if make else pa.list_(pa.int64()))], [*names, "_value"])
            if source:
                source.close()

        size = (self.entries.agg(F.sum("n_tokens")).first()[0] or 0) * kind.itemsize
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
        ordered = located.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in located.schema.fields)
        name, _, value_kind = schema.partition(" ")
        return ordered.mapInArrow(fetch, f"{kinds}, _value {value_kind}").withColumnRenamed("_value", name)

    def get(self, doc_id: int | None, copy: int = 0) -> list[int] | None:
        """The ids of one document by its key: one index file, one read; None if there is no such key."""
        if not self.buckets:
            return None
        hashed = key_hash(np.array([doc_id or 0]), np.array([copy]), np.array([doc_id is None]))
        bucket = int(hashed.view(np.int64)[0] % self.buckets)
        system, path = filesystem(f"{self.folder}/index-{bucket:06d}.mph")
        with system.open_input_file(path) as source:
            index = BucketIndex(source, whole=False)
            known, records = index.find(hashed)
            shards = index.shards(records)
        if not len(known):
            return None
        system, path = filesystem(f"{self.folder}/ids-{shards[0]}.bin")
        width = np.dtype(self.kind).itemsize
        with system.open_input_file(path) as source:
            source.seek(int(records["offset"][0]))
            return np.frombuffer(source.read(int(records["length"][0]) * width), self.kind).tolist()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
    bucket_keys: int = BUCKET_KEYS,
) -> TokenFiles:
    """Encode every text, write ids in ascending doc_id order, build the index.

    A null or empty text is its end id alone. Null ids come first. Rows that repeat an
    id stand side by side in the order of their texts and have the keys (doc_id, 0),
    (doc_id, 1), ..; other columns are not read. An empty table leaves no files. Texts
    are range partitioned before they are encoded, because Spark reads the input of a
    range partitioning twice.
    """
    spark = docs.sparkSession
    kind = id_kind(tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    places = written(
        ordered.mapInArrow(
            _writer(folder, tokenizer, kind, end_id, shard_bytes),
            "doc_id long, copy long, shard string, offset long, n_tokens long, key long",
        ),
        "token-entries",
    )
    # One row per shard, of which there are few: a window over all of them is cheap.
    sums = places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    starts.write.mode("overwrite").parquet(f"{folder}/shards")
    shards = spark.read.schema("shard string, shard_start long").parquet(f"{folder}/shards")
    buckets = -(-places.count() // bucket_keys)
    entries = places.withColumn("bucket", F.pmod("key", F.lit(max(1, buckets))))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        hashed = table.column("key").to_numpy().view(np.uint64)
        columns = (table.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "offset", "n_tokens"))
        with committed(f"{folder}/index-{bucket:06d}.mph") as out:
            out.write(BucketIndex.build(hashed, *columns))
        return pa.table({"bucket": [bucket], "keys": [len(hashed)]})

    written(
        entries.select("bucket", "key", "shard", "offset", "n_tokens").groupBy("bucket").applyInArrow(index, "bucket long, keys long"),
        "token-index",
    )
    return TokenFiles(spark, folder, kind, buckets, entries, shards)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
