"""Helpers shared by the training-data operators: materialised tables and word hashes in numpy."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import storage
from maskwright.storage import drop_tables, shared_folder

__all__ = ["Words", "drop_tables", "shared_folder", "write_table"]

#: Bytes that separate words: space and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_BREAK = r"[\x20\x09-\x0D]+"

def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver happens to collect
    its garbage; a long operator would else keep all of them on the executors' disks."""
    gc.collect()
    if getattr(spark, "_jvm", None) is not None:  # not so for a session over Connect
        spark._jvm.System.gc()


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """A table of the shared folder in df's place; see `storage.write_table`."""
    release(df.sparkSession)
    return storage.write_table(df, tag)


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(mod: int, remainder: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == remainder, F.lit(False))


# ---------------------------------------------------------------------------------------------
# numpy

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection, so equal only if the inputs are)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _BASE, np.uint64), dtype=np.uint64)])
    return _powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice are about `most` bytes; one longer text stands alone."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Word boundaries and 64-bit word hashes of a slice of texts.

    start, end: byte offsets of each word in buf; doc: row of each word; first: for each row the
    index of its first word, with the total as last entry.
    """

    def __init__(self, column: pa.Array, lower: bool = True, alphanumeric: bool = False):
        self.buf, offsets = utf8(column)
        self.n_docs = len(offsets) - 1
        inside = (_IS_TERM if alphanumeric else _IS_WORD)[self.buf]
        n = len(inside)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        length = self.end - self.start
        if len(length):
            at = np.flatnonzero(inside)
            within = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
            values = (_FOLD if lower else _BYTE)[self.buf[at]]
            values *= powers(int(length.max()))[within]
            self.hash = mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64) * _MIX[2])
        else:
            self.hash = np.zeros(0, np.uint64)

    def prefix_hash(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the first k bytes of words of k bytes or more; unlike those of whole words."""
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + _FOLD[self.buf[self.start[at] + j]]
        return mix(h)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, hash) of every k-word shingle; a text of fewer words but one is one shingle."""
        n = len(self.hash)
        count = np.diff(self.first)
        full = max(0, n - k + 1)
        h = np.zeros(full, np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + self.hash[j : j + full]
        ok = self.doc[:full] == self.doc[k - 1 :] if full else np.zeros(0, bool)
        row, word, h = self.doc[:full][ok], np.flatnonzero(ok), mix(h[ok])
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = count[short] > j
                extra[has] = extra[has] * np.uint64(_BASE) + self.hash[self.first[short][has] + j]
            extra = mix(extra ^ np.uint64(_MIX[2]) * count[short].astype(np.uint64))
            row, word, h = np.concatenate([row, short]), np.concatenate([word, self.first[short]]), np.concatenate([h, extra])
            order = np.argsort(row, kind="stable")
            row, word, h = row[order], word[order], h[order]
        return row, word, h


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
