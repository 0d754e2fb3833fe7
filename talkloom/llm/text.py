"""Words, word shingles and MinHash values of whole texts, for use inside tasks.

Texts are handled as UTF-8 bytes: ``bytes.lower`` changes A-Z only and ``bytes.split``
cuts at space and U+0009 to U+000D only, which is the word rule ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
_CHUNK = 4096


class WordHashes(dict):
    """64-bit hashes of words, kept; it starts afresh when ``most`` words are held."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words, in order; a shorter text is one run."""
    count = len(words)
    if not count:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, count)
    span = min(width, count)
    runs = count - span + 1
    value = ids[:runs].copy()
    for k in range(1, span):
        value *= np.uint64(0x9E3779B97F4A7C15)
        value += ids[k : k + runs]
    return mix(value ^ np.uint64(span))


class MinHash:
    """``size`` seeded permutations of 32-bit values."""

    def __init__(self, size: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.size = size
        self.factor = random.integers(0, 2**31, size, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.shift = random.integers(0, 2**32, size, dtype=np.uint32)[:, None]

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """The permuted values, a row for each permutation."""
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        return short[None, :] * self.factor + self.shift

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        lowest = np.full(self.size, 2**32 - 1, np.uint32)
        for start in range(0, len(shingles), _CHUNK):
            np.minimum(lowest, self.values(shingles[start : start + _CHUNK]).min(axis=1), out=lowest)
        return lowest


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is the empty text."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory that is no longer used back to the system.

    Spark keeps Python workers for later tasks and stages; what Arrow and the C library hold
    in reserve for each of them would add up.
    """

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in run(batches):
            yield batch
            del batch
            pool.release_unused()
        pool.release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return spared


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()
