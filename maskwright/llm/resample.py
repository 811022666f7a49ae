"""Importance resampling: draw the documents whose n-grams look most like those of a target corpus.

An n-gram's bucket is the CRC-32 of its words, joined by one space. Instead of hashing each n-gram, a document is
scanned once after its separators are made one space: the scan keeps the CRC register after each byte. The register
of any substring follows from two of these prefixes, as a CRC is linear over GF(2): shift the earlier one by the
substring's length in zero bytes and cancel it from the later one. Shifts are table look-ups, so all n-grams of a
slice of documents are hashed by a few numpy gathers, whatever their lengths.

Plan: two scans. The first adds up bucket counts in each task (one vector of `buckets` numbers a task is all that
is shuffled); the second sums the buckets' gains for each document. Gains are one number a bucket, so they are
collected and broadcast (`MOST_BUCKETS`). Ranks over all documents come from a range partition by score: place in
the sorted partition plus the rows of the partitions before it, so nothing is ranked in one task.

Defined results: null and empty texts, and texts without words, have no features, weight 0 and are never drawn;
texts of any length are scanned whole; repeated rows count again each and get ranks of their own; equal scores go
by the smaller id, a null id last (its noise is that of the empty id). Only the columns named are read, so others
may have any names. An empty table gives no rows; an empty target is a target of no n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import slices, utf8, write_table

#: Gains are broadcast: so many buckets at most.
MOST_BUCKETS = 1 << 20
#: Documents ranked by one task.
RANKED = 2_000_000

#: A-Z in lower case; then words are made of 0-9, a-z and all bytes from 128 on.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_POLYNOMIAL = 0xEDB88320
#: Bytes scanned one after another; the rows of such chunks are scanned side by side.
_CHUNK = 256


def _byte_table() -> np.ndarray:
    """The register after one byte, for each value of the register's low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_STEP = _byte_table()


def _by_byte(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by its values for each byte (4 x 256)."""
    out = tables[0][register & 0xFF]
    for k in (1, 2, 3):
        out = out ^ tables[k][(register >> (8 * k)) & 0xFF]
    return out


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that shift a register by 0 to _CHUNK - 1 zero bytes, and by _CHUNK * 2^j."""
    one = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    short = np.empty((_CHUNK, 4, 256), np.uint32)
    for n in range(_CHUNK):
        short[n] = one
        one = _STEP[one & 0xFF] ^ (one >> 8)
    long = [one]
    for _ in range(31):
        long.append(np.stack([_by_byte(long[-1], x) for x in long[-1]]))
    return short, long


_SHORT, _LONG = _shift_tables()
_FLAT = _SHORT.ravel()


def shift(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n more zero bytes each."""
    at = (n % _CHUNK).astype(np.int64) * 1024
    out = _FLAT[at + (register & 0xFF)]
    for k in (1, 2, 3):
        out ^= _FLAT[at + (256 * k) + ((register >> (8 * k)) & 0xFF)]
    rest = n // _CHUNK
    for j in range(int(rest.max()).bit_length() if len(rest) else 0):
        odd = np.flatnonzero((rest >> j) & 1)
        out[odd] = _by_byte(_LONG[j], out[odd])
    return out


def prefix_registers(data: np.ndarray) -> np.ndarray:
    """The register after each number of bytes, from 0 to all; it starts at zero."""
    n = len(data)
    rows = max(1, -(-n // _CHUNK))
    padded = np.zeros(rows * _CHUNK, np.uint8)
    padded[:n] = data
    columns = np.ascontiguousarray(padded.reshape(rows, _CHUNK).T).astype(np.uint32)
    state = np.zeros(rows, np.uint32)
    for c in columns:
        state = _STEP[(state ^ c) & 0xFF] ^ (state >> 8)
    # Registers at the chunks' ends, by doubling: each adds those of 1, 2, 4, ... chunks before it.
    j, reach = 0, 1
    while reach < rows:
        state[reach:] = state[reach:] ^ _by_byte(_LONG[j], state[:-reach])
        j, reach = j + 1, 2 * reach
    state = np.append(np.uint32(0), state[:-1])
    out = np.empty((_CHUNK, rows), np.uint32)
    for k, c in enumerate(columns):
        state = _STEP[(state ^ c) & 0xFF] ^ (state >> 8)
        out[k] = state
    return np.append(np.uint32(0), out.T.ravel()[:n])


def substring_crcs(registers: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes from start to end, each, of the data whose prefix registers are given."""
    n = end - start
    ones = np.full(1, 0xFFFFFFFF, np.uint32)  # the register a CRC-32 starts from, and is inverted by at its end
    lengths, which = np.unique(n, return_inverse=True) if len(n) and n.max() >= _CHUNK else (np.arange(_CHUNK), n)
    return registers[end] ^ shift(registers[start], n) ^ (shift(np.repeat(ones, len(lengths)), lengths) ^ ones)[which]


class Normalised:
    """A slice of texts with A-Z lower-cased and each run of separators made one space; start, end: of each word;
    first: for each row the index of its first word, with the total as last entry."""

    def __init__(self, column: pa.Array):
        raw, offsets = utf8(column)
        n = len(raw)
        inside = _IS_WORD[raw]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        head = np.zeros(n, bool)
        head[offsets[:-1][offsets[:-1] < n]] = True
        keep = inside | (before & ~head)  # of a run of separators the first byte stays, as a space
        self.data = np.where(inside, _LOWER[raw], 0x20).astype(np.uint8)[keep]
        place = np.cumsum(keep) - keep
        tail = np.zeros(n, bool)
        tail[:-1] = ~inside[1:] | head[1:]
        if n:
            tail[-1] = True
        begins = np.flatnonzero(inside & (~before | head))
        self.start, self.end = place[begins], place[np.flatnonzero(inside & tail)] + 1
        self.first = np.searchsorted(begins, offsets)


def ngram_buckets(texts: Normalised, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to most: the buckets of all runs of n words, and where each row's begin (and the last end)."""
    registers = prefix_registers(texts.data)
    count = np.diff(texts.first)
    for n in range(1, most + 1):
        runs = np.maximum(count - n + 1, 0)
        ends = np.append(0, np.cumsum(runs))
        at = np.repeat(texts.first[:-1] - ends[:-1], runs) + np.arange(ends[-1])
        yield (substring_crcs(registers, texts.start[at], texts.end[at + n - 1]) % np.uint32(buckets)).astype(np.int64), ends


def bucket_counts(docs: DataFrame, text: str = "text", most: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many n-grams of all texts fall in each bucket that occurs."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for found, _ in ngram_buckets(Normalised(part.column("text")), most, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", most: int = 3, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: a thousand times the log of how much likelier the target's n-grams are to fall in the bucket."""
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    s = bucket_counts(docs, text, most, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, text, most, buckets).withColumnRenamed("n", "t")
    counted = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    counted = write_table(counted, "gain-counts")
    sums = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return counted.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score (the weight with the noise of the seed and the id)."""
    by_bucket = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():  # one row a bucket
        by_bucket[bucket] = gain
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Normalised(part.column("text"))
                features, weight = (np.zeros(part.num_rows, np.int64) for _ in range(2))
                for found, ends in ngram_buckets(texts, most, buckets):
                    features += np.diff(ends)
                    weight += np.diff(np.append(0, np.cumsum(gain[found]))[ends])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.diff(texts.first), features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def draw(scored: DataFrame, percent: int = 5, min_words: int = 20) -> DataFrame:
    """scored with rank: 1, 2, 3, ... for the drawn share of the documents of min_words or more, by score."""
    # The place settles equal rows; it is in the table, so a task that runs again cannot deal it anew.
    rows = write_table(scored.withColumn("__place", F.monotonically_increasing_id()).withColumn("__short", F.col("n_words") < min_words), "scored")
    n, eligible = rows.agg(F.count("*"), F.coalesce(F.sum((~F.col("__short")).cast("long")), F.lit(0))).first()
    keys = [F.col("__short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__place")]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANKED))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The id counts on within each partition; its upper bits are the partition's number.
    ordered = write_table(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, index = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    earlier = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    rank = F.col("__before") + index + 1
    drawn = F.when(~F.col("__short") & (rank <= eligible * percent // 100), rank)
    return ordered.withColumn("__part", part).join(F.broadcast(before), "__part", "left").withColumn("rank", drawn).drop("__part", "__before", "__at", "__place", "__short")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document."""
    return draw(weigh(docs, bucket_gains(docs, target, text), id_col, text, seed=seed), percent, min_words)
