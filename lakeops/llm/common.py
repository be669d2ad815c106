"""Shared by the operators: words, word hashes, Arrow batches, folds.

A *word* is a run of characters other than space and U+0009 to U+000D.  On UTF-8 bytes this
is what ``bytes.split()`` gives, and ``bytes.lower()`` lower-cases A to Z only, so texts travel
as binary columns and are cut by these two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch: bounds what a Python worker holds at a time.
BATCH_ROWS = 256


def map_batches(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches; ``build()`` runs once per task and returns the mapper."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = build()
        for batch in batches:
            if batch.num_rows:
                yield mapper(batch)

    return df.mapInArrow(run, schema)


def utf8(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys fall into fold 0."""
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def word_count(text: str | Column = "text") -> Column:
    """Number of words, by built-in functions; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


class Memo(dict):
    """word -> value, filled on demand by ``make``; emptied when ``most`` words are held."""

    def __init__(self, make: Callable[[bytes], int], most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


#: 64-bit hash of a word, shared by all tasks of a Python worker.
HASHES = Memo(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter text is one run as a whole."""
    n = len(h)
    if n == 0:
        return h
    if n < width:
        width = n
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = mixed(out * ODD[k % 64] + h[k : n - width + 1 + k])
    return out
