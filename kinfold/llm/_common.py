"""What the training-data operators share: checkpoints, Arrow batches, words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinfold.sources.shared import scratch, shared_dir, stored  # noqa: F401  for the operators here

#: Rows, and bytes of text, that are worked on at a time; one text can be longer.
PIECE_ROWS, PIECE_BYTES = 1000, 8 << 20
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes: one bound for all operators, set once, and a session's own lower one stays."""
    if int("".join(filter(str.isdigit, spark.conf.get(BATCH_CONF))) or 0) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def trim() -> None:
    """Give a worker's free memory back to the system, where its C library can; workers live on after heavy tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(work):
    """A worker's function that leaves no free memory behind."""

    @wraps(work)
    def run(batches):
        yield from work(batches)
        trim()

    return run


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = PIECE_ROWS, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most so many rows and bytes of a text column; empty ones are left out."""
    for batch in batches:
        if batch.num_rows:
            total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, before = 0, 0
            while at < batch.num_rows:
                end = min(max(at + 1, int(np.searchsorted(total, before + most, "right"))), at + rows, batch.num_rows)
                yield batch.slice(at, end - at)
                at, before = end, int(total[end - 1])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, a null as an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc_remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Words as small integers, with a 64-bit hash and a length in code points for each.

    One per Python worker; ``fresh`` empties it once it has grown past ``most`` words, which
    changes no result.
    """

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most, self._hash, self._chars = most, np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k >= len(self._hash):
            self._hash = np.concatenate([self._hash, np.zeros_like(self._hash)])
            self._chars = np.concatenate([self._chars, np.zeros_like(self._chars)])
        self._hash[k] = xxhash.xxh3_64_intdigest(word)
        self._chars[k] = len(word.decode("utf-8", "replace"))
        return k

    def fresh(self) -> None:
        if len(self) > self.most:
            self.clear()

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return self._hash[ids]

    def chars(self, ids: np.ndarray) -> np.ndarray:
        return self._chars[ids]


def raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def grouped_words(texts: list[str], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in one list, and how many each text has.

    A word is a run of characters other than space and U+0009 to U+000D, as bytes.split() has it.
    """
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        b = raw(t)
        own = (b.lower() if lower else b).split()  # of bytes: lowers A to Z only
        sizes[i] = len(own)
        words += own
    return words, sizes


class Table:
    """Open addressing over 64-bit keys, built and asked in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.used = np.full(1 << self.bits, -1, np.int32)  # the value's place, -1: free
        self.values = values
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.used[at] < 0
            self.used[at[free]] = left[free]  # of several for a slot one wins
            won = self.used[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each key its place among those given at the start, or -1."""
        at = self._slot(keys)
        found = self.used[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            here = self.used[at]
            ok = (here < 0) | (self.keys[at] == keys[wrong])
            found[wrong[ok]] = here[ok]
            wrong, at = wrong[~ok], at[~ok]
        return found


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of the runs that begin at starts and have these sizes, one after another."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
