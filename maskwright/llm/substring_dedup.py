"""Exact substring removal by a sampled suffix array.

Every byte covered by a `length`-byte string that starts elsewhere too is found. Sorting all
suffixes would move a multiple of the corpus, so a content-chosen sample of them is sorted: of each
length-byte window the suffix that starts with the smallest 32-byte gram (leftmost of equal ones).
Equal windows choose the same suffix at the same place, so whatever repeats meets in the sample,
which is about one suffix in 85 bytes.

The sample is range-partitioned by sampled splitters over its leading bytes (then gram, stretch and place, so
a hot gram is cut into several buckets). A bucket is sorted in its task by a multikey quicksort, and
neighbours are compared: suffixes next to each other with equal gram have equal leading bytes, and a stretch that
equals its neighbour's is repeated whole. What lies at a bucket's first or last suffix is compared across the
boundary, by a summary of at most two rows a bucket. Where leading bytes repeat but stretches
differ, the ends of a match lie inside; there blocks of 16 windows are compared: a block whose bytes
all repeat is removed, one whose common core does not repeat stays, and only in the few between is each
window compared on its own.

Blocks and windows are counted (map-side first) and joined on hashes, which adaptive execution splits where hot;
no group is gathered. A bucket is held by its task (40 bytes a suffix, a suffix in about 85 bytes of text), so
spark.sql.shuffle.partitions bounds memory. Grams, stretches and windows are compared by 64-bit hashes.

Defined results: null and empty texts have no bytes; matches never cross documents but may overlap
and lie in one document; rows of the same id and text count as one text, and fare alike; rows with a
null id are handled like others; an empty table gives no rows; texts of any length are whole, read by the slice; other
columns, whatever their names, are ignored. Two rows of the same id and text are one document stored twice, so
they do not repeat each other; rows of different ids do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import _BASE, _BYTE, drop_tables, mix, release, signed, slices, utf8, write_table

GRAM = 32
BUCKET = pa.schema([(name, pa.int64()) for name in ("key", "at", "lead", "g", "c")])
_MASK = (1 << 64) - 1


class Windows:
    """Rolling hashes of a slice of texts: gram and window hash at each byte, and window validity."""

    def __init__(self, column: pa.Array, length: int):
        self.buf, self.offsets = utf8(column)
        n = len(self.buf)
        self.length = length
        self.count = max(0, n - length + 1)
        if not self.count:
            return
        power, h = {1: _BASE}, {1: _BYTE[self.buf]}
        size = 1
        while size * 2 <= max(GRAM, length):
            step = np.uint64(power[size])
            h[size * 2] = h[size][: n - 2 * size + 1] * step + h[size][size:]
            power[size * 2] = power[size] * power[size] & _MASK
            size *= 2
            if size // 2 != GRAM and not length & (size // 2):
                del h[size // 2]  # not needed again
        total, at = np.zeros(self.count, np.uint64), 0
        for bit in sorted((b for b in h if length & b), reverse=True):
            total = total * np.uint64(power[bit]) + h[bit][at : at + self.count]
            at += bit
        self.window = mix(total)
        self.large_size = max(h)
        self.large = h[self.large_size]
        self.gram = mix(h[GRAM] ^ np.uint64(0x5555))
        size_of = np.diff(self.offsets)
        for_doc = np.maximum(size_of - length + 1, 0)
        self.row = np.repeat(np.arange(len(size_of)), for_doc)
        self.start = np.arange(len(self.row)) - np.repeat(np.cumsum(for_doc) - for_doc, for_doc) + np.repeat(self.offsets[:-1], for_doc)

    @property
    def step(self) -> int:
        """Windows of a block: few enough that the core holds the longest string that is hashed at once."""
        return max(1, min(BLOCK, self.length - self.large_size + 1))

    def block_hashes(self, first: np.ndarray, last: np.ndarray, core: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the bytes of windows first to last, and of the bytes that all windows of a block
        share. The first and the last window cover the one, the strings at both ends the other."""
        if not len(first):
            return (np.zeros(0, np.uint64),) * 2
        end = core + self.length - (self.step - 1) - self.large_size
        whole = mix(mix(self.window[first] + (last - first).astype(np.uint64)) * np.uint64(_BASE) + self.window[last])
        return whole, mix(mix(self.large[core] + number.astype(np.uint64)) * np.uint64(_BASE) + self.large[end])

    def leading(self, at: np.ndarray) -> np.ndarray:
        """The suffixes' first eight bytes as numbers of the same order."""
        value = np.zeros(len(at), np.uint64)
        for j in range(8):
            value = value << np.uint64(8) | self.buf[at + j].astype(np.uint64)
        return value ^ np.uint64(1 << 63)  # stored as signed

    def stretches(self) -> tuple[np.ndarray, ...]:
        """Runs of windows that choose the same suffix: row, first and last window start and the
        suffix's (in the text), leading bytes, gram and stretch hash."""
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
        if not self.count or not len(self.start):
            return none
        reach = self.length - GRAM + 1
        value, place = self.gram, np.arange(len(self.gram), dtype=np.int32)
        size = 1
        while size * 2 <= reach:
            a, b = value[:-size], value[size:]
            right = b < a
            value, place = np.where(right, b, a), np.where(right, place[size:], place[:-size])
            size *= 2
        off = reach - size
        a, b = value[: self.count], value[off : off + self.count]
        right = b < a
        chosen = np.where(right, place[off : off + self.count], place[: self.count])[self.start]
        first = np.ones(len(chosen), bool)
        first[1:] = (chosen[1:] != chosen[:-1]) | (self.row[1:] != self.row[:-1])
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(chosen)) - 1
        s1, s2 = self.start[heads], self.start[tails]
        g = self.gram[chosen[heads]]
        c = mix(self.window[s1] * np.uint64(_BASE) + mix(self.window[s2] ^ (s2 - s1).astype(np.uint64)))
        base = self.offsets[self.row[heads]]
        return self.row[heads], s1 - base, s2 - base, chosen[heads] - base, self.leading(chosen[heads]), g, c


BLOCK = 16


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, key, text; equal rows have equal keys."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


def stretch_table(docs: DataFrame, length: int) -> DataFrame:
    """key, at, lead, g, c: the sampled suffixes of all texts. at packs the first window's start and, from it, the
    last window's and the suffix's (under length, thus of 16 bits), as rows of the large shuffle are dear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                row, s1, s2, p, *hashes = Windows(part.column("text"), length).stretches()
                at = pa.array(s1 << 32 | (s2 - s1) << 16 | (p - s1))
                columns = [part.column("key").take(pa.array(row)), at, *(pa.array(signed(x)) for x in hashes)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "lead", "g", "c"])

    if length >= 1 << 16:
        raise ValueError("length is below 65536")
    return _texts(docs).select("key", "text").mapInArrow(run, "key long, at long, lead long, g long, c long")


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the first key, then the next: each key is sorted only among rows that those
    before leave tied."""
    order = np.argsort(keys[0], kind="quicksort")
    new = np.ones(len(order), bool)
    new[1:] = keys[0][order[1:]] != keys[0][order[:-1]]
    for key in keys[1:]:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
        if not len(tied):
            break
        order[tied] = order[tied][np.lexsort((key[order[tied]], group[tied]))]
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return order


def compare_neighbours(key: np.ndarray, at: np.ndarray, lead: np.ndarray, g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorts a bucket and compares neighbours. Returns, of suffixes whose gram is a neighbour's or at the
    bucket's edge: row, whether their gram has several stretches, whether their stretch is met twice,
    whether they are its first; whether gram and stretch reach the bucket's edge."""
    order = multikey_order([lead, g, c, key, at])
    if len(order):  # rows stored twice are neighbours in one bucket
        again = np.zeros(len(order), bool)
        again[1:] = np.all([x[order[1:]] == x[order[:-1]] for x in (g, c, key, at)], axis=0)
        order = order[~again]
    new_g = np.ones(len(order), bool)
    new_g[1:] = (g[order[1:]] != g[order[:-1]]) | (lead[order[1:]] != lead[order[:-1]])
    new_c = new_g.copy()
    new_c[1:] |= c[order[1:]] != c[order[:-1]]
    gram, stretch = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
    mixed = np.bincount(gram, new_c)[gram] > 1
    twice = np.bincount(stretch)[stretch] > 1
    edge_g = (gram == 0) | (gram == gram[-1:].sum())
    edge_c = (stretch == 0) | (stretch == stretch[-1:].sum())
    some = mixed | twice | edge_g
    return tuple(x[some] for x in (order, mixed, twice, new_c, edge_g, edge_c))


def repeated_suffixes(stretches: DataFrame) -> DataFrame:
    """key, at, mixed, twice, leads of suffixes whose gram is met again: whether the gram has several stretches, whether
    theirs is met twice, whether they are its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, BUCKET)
        key, at, lead, g, c = (table.column(x).to_numpy() for x in BUCKET.names)
        order, mixed, twice, leads, edge_g, edge_c = compare_neighbours(key, at, lead, g, c)
        columns = [pa.array(key[order]), pa.array(at[order]), pa.array(g[order], mask=~edge_g), pa.array(c[order], mask=~edge_c)]
        out = pa.table([*columns, pa.array(mixed), pa.array(twice), pa.array(leads)], ["key", "at", "g", "c", "mixed", "twice", "leads"])
        yield from out.to_batches(1 << 16)

    schema = "key long, at long, g long, c long, mixed boolean, twice boolean, leads boolean"
    buckets = stretches.select(*BUCKET.names).repartitionByRange("lead", "g", "c", "key", "at")
    met = write_table(buckets.mapInArrow(run, schema), "suffixes")
    # Across boundaries: a bucket has one gram and one stretch at each end, so these have two rows a bucket at most.
    place = F.struct("key", "at")
    several = F.coalesce(F.min("c") != F.max("c"), F.lit(False)) | F.max("mixed")
    grams = met.where("g is not null").groupBy("g").agg(several.alias("mixed_g"))
    ends = met.where("c is not null").groupBy("g", "c").agg(F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("twice_c"))
    joined = met.join(F.broadcast(grams), "g", "left").join(F.broadcast(ends), ["g", "c"], "left")
    judged = joined.select(
        "key", "at", F.coalesce("mixed_g", "mixed").alias("mixed"), F.coalesce("twice_c", "twice").alias("twice"),
        F.coalesce(F.col("first") == place, "leads").alias("leads"),
    )
    return judged.where("mixed or twice")


def _spread(part: pa.RecordBatch, step: int) -> tuple[np.ndarray, ...]:
    """Each spot's blocks of `step` windows, counted back from its suffix: row, kind, first and last
    window, suffix and number."""
    spots = part.column("spots")
    row = np.repeat(np.arange(part.num_rows), spots.value_lengths().to_numpy(zero_copy_only=False))
    flat = spots.flatten()
    s1, s2, p, kind = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("s1", "s2", "p", "kind"))
    low, high = (p - s2) // step, (p - s1) // step
    n = high - low + 1
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    row, kind, s1, s2, p = (np.repeat(x, n) for x in (row, kind, s1, s2, p))
    return row, kind, np.maximum(s1, p - step * number - step + 1), np.minimum(s2, p - step * number), p, number


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """key, s1, s2, p, whole, core, asked: blocks of windows. whole: hash of the block's bytes; core: of
    those that all windows of such a block have, wherever the spot ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                w = Windows(part.column("text"), length)
                step = w.step if w.count else 1
                row, kind, a, b, p, number = _spread(part, step)
                base = w.offsets[row]
                whole, core = w.block_hashes(base + a, base + b, base + p - step * number, number)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (a, b, p)), pa.array(signed(whole)), pa.array(signed(core)), pa.array(kind == 1)], names=["key", "s1", "s2", "p", "whole", "core", "asked"])

    return texts.mapInArrow(run, "key long, s1 int, s2 int, p int, whole long, core long, asked boolean")


def _single(texts: DataFrame, length: int) -> DataFrame:
    """key, s, w, asked: every window of the given blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                w = Windows(part.column("text"), length)
                row, kind, s, *_ = _spread(part, 1)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(s.astype(np.int32)), pa.array(signed(w.window[w.offsets[row] + s]) if len(s) else s), pa.array(kind == 1)], names=["key", "s", "w", "asked"])

    return texts.mapInArrow(run, "key long, s int, w long, asked boolean")


def _with_texts(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """key, text, spots (s1, s2, p, kind) of texts that have any, each text once."""
    lists = spots.groupBy("key").agg(F.collect_set(F.struct("s1", "s2", "p", "kind")).alias("spots"))
    return _texts(docs).select("key", "text").join(lists, "key").dropDuplicates(["key"])


def removed_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """key, s1, s2: stretches of window starts that repeat."""
    all_ = write_table(stretch_table(docs, length), "stretches")
    judged = repeated_suffixes(all_)
    # 0: repeated whole; 1: windows to ask for; 2: windows to compare with, of one copy
    kind = F.when(~F.col("twice"), 1).when(F.col("mixed") & F.col("leads"), 2).otherwise(0)
    s1 = F.shiftright("at", 32)
    spots = judged.select("key", s1.cast("int").alias("s1"), (s1 + F.shiftright("at", 16).bitwiseAND(0xFFFF)).cast("int").alias("s2"), (s1 + F.col("at").bitwiseAND(0xFFFF)).cast("int").alias("p"), kind.alias("kind"))
    spots = write_table(spots, "spots")
    drop_tables(all_)
    place = F.struct("key", "s1")

    blocks = write_table(_blocks(_with_texts(docs, spots.where("kind > 0")), length), "blocks")
    equal = blocks.groupBy("whole").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("whole", "first")
    judged = blocks.join(equal, "whole", "left").select("key", "s1", "s2", "p", "core", "asked", F.col("first").isNotNull().alias("both"), (F.col("first") == place).alias("leads"))
    judged = write_table(judged, "blocks")
    drop_tables(blocks)
    blocks = judged
    # A block is settled if all of it repeats, or its core does not. Where the core does, single windows
    # are compared: of open blocks, and of one of each kind of settled ones.
    cores = blocks.groupBy("core").agg(F.count("*").alias("n"), F.max(~F.col("both")).alias("open")).where("n > 1 and open").select("core")
    rest = blocks.where("not both or leads").join(cores, "core").select("key", "s1", "s2", "p", F.when(F.col("asked") & ~F.col("both"), 1).otherwise(2).alias("kind"))
    windows = write_table(_single(_with_texts(docs, rest), length), "windows")
    repeated = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    found = windows.where("asked").join(repeated, "w").select("key", F.col("s").alias("s1"), F.col("s").alias("s2"))
    return spots.where("kind <> 1").select("key", "s1", "s2").unionByName(blocks.where("both and asked").select("key", "s1", "s2")).unionByName(found)


def cut(text: bytes, s1: np.ndarray, s2: np.ndarray, length: int) -> tuple[bytes, int]:
    """text without the bytes of windows that start in [s1, s2], and the number of cut runs."""
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, s1, 1)
    np.add.at(depth, np.minimum(s2 + length, len(text)), -1)
    gone = np.cumsum(depth[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int((gone & ~np.append(False, gone[:-1])).sum())


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), n_spans of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, runs, sizes = [], [], []
            for text, spots in zip(batch.column("text"), batch.column("spots"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                rest, n = raw, 0
                if spots.is_valid:
                    s1, s2 = (spots.values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("s1", "s2"))
                    rest, n = cut(raw, s1, s2, length)
                kept.append(rest)
                runs.append(n)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, pa.int64())], names=["doc_id", "n_bytes", "kept", "n_spans"])

    spots = write_table(removed_spans(docs, length).groupBy("key").agg(F.collect_set(F.struct("s1", "s2")).alias("spots")), "cuts")
    release(docs.sparkSession)
    return _texts(docs).join(spots, "key", "left").select("doc_id", "text", "spots").mapInArrow(run, f"doc_id {kind}, n_bytes long, kept binary, n_spans long")


def digests(done: DataFrame) -> DataFrame:
    kept = F.octet_length("kept")
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - kept).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
