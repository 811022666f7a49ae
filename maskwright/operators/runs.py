"""Spans put into runs of text, with the runs of a document packed while they move.

A shuffle of runs of a few characters costs many times their text. So each task packs those that it reads, a row for
each document and bin of 2^BIN characters: their texts as one, and columns of differences, which compress to almost
nothing. Packed runs meet the spans of their document and bin, as a list, in one join, and are unpacked beside them.
A run is in the bin that it starts in, if it is shorter than a bin, else in a bin of long ones; a span goes to each bin
whose runs it may touch, so no row has more than a bin's spans, but for long runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins are 2^BIN characters wide; the bin of the runs that are longer.
BIN, LONG = 16, 1 << 62
#: Characters that are put together at once.
TOGETHER = 1 << 21


def _lists(values: pa.Array, heads: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)).astype(np.int32)), values)


def _differences(values: pa.Array, heads: np.ndarray) -> pa.Array:
    """Whole numbers as the first one of each list and what each adds to the one before; nulls add nothing."""
    v = pc.fill_null_forward(values).fill_null(0).to_numpy()
    d = np.diff(v, prepend=v[:1])
    d[heads] = v[heads]
    return pa.array(d, values.type, mask=values.is_null().to_numpy(zero_copy_only=False))


def _summed(values: pa.Array, heads: np.ndarray) -> pa.Array:
    """The numbers of `_differences`."""
    if not len(values):
        return values
    d = values.fill_null(0).to_numpy()
    s = np.cumsum(d, dtype=d.dtype)
    size = np.diff(np.append(heads, len(d)))
    v = s - np.repeat(s[heads] - d[heads], size)
    return pa.array(v, values.type, mask=values.is_null().to_numpy(zero_copy_only=False))


def _packed(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """doc_id, __bin, __text, __chars (of each run, -1 for null) and a list for each other column."""
    start, end = (batch.column(c).cast(pa.int64()) for c in ("start", "end"))
    length = pc.subtract(end, start).fill_null(0).to_numpy()
    bin_ = np.where(length > 1 << BIN, LONG, np.maximum(start.fill_null(0).to_numpy() >> BIN, 0))
    doc = batch.column("doc_id").dictionary_encode("encode")
    code = doc.indices.to_numpy()
    heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (bin_[1:] != bin_[:-1])))
    text = batch.column("text")
    chars = pc.utf8_length(text).fill_null(-1).cast(pa.int32())
    whole = pc.binary_join(_lists(text.cast(pa.binary()).fill_null(b""), heads), b"")
    out = [batch.column("doc_id").take(pa.array(heads)), pa.array(bin_[heads]), whole, _lists(chars, heads)]
    for c in names:
        v = batch.column(c)
        out.append(_lists(_differences(v, heads) if pa.types.is_integer(v.type) else v, heads))
    return pa.RecordBatch.from_arrays(out, names=["doc_id", "__bin", "__text", "__chars", *names])


def _pool(texts: list[bytes]) -> tuple[np.ndarray, bool]:
    """The characters of texts, one after another, as numbers; whether all are ASCII."""
    data = b"".join(texts)
    if data.isascii():
        return np.frombuffer(data, np.uint8), True
    return np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32), False


def _as_strings(codes: np.ndarray, size: np.ndarray, ascii_: bool, null: np.ndarray) -> pa.Array:
    """Strings of `size` characters each, one after another."""
    ends = np.append(0, np.cumsum(size))
    if ascii_:
        data = codes.astype(np.uint8).tobytes()
    else:
        data = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        width[(codes >= 0xDC80) & (codes < 0xDD00)] = 1  # a byte that is no text
        ends = np.append(0, np.cumsum(width))[ends]
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(size), [valid, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _put_in(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Packed runs with their spans (__spans) as runs again."""
    lists = batch.column("__chars")
    runs = lists.value_lengths().to_numpy()
    heads = (np.cumsum(runs) - runs)[runs > 0]
    row = np.repeat(np.arange(batch.num_rows), runs)
    flat = {c: batch.column(c).flatten() for c in names}
    for c, v in flat.items():
        if pa.types.is_integer(v.type):
            flat[c] = _summed(v, heads)
    start, end = (flat[c].cast(pa.int64()).fill_null(0).to_numpy() for c in ("start", "end"))
    size = lists.flatten().to_numpy()
    null, size = size < 0, np.maximum(size, 0).astype(np.int64)
    spans = batch.column("__spans")
    n_spans = spans.value_lengths().fill_null(0).to_numpy()
    some = spans.flatten()
    s, e = (some.field(c).cast(pa.int64()).to_numpy() for c in ("s", "e"))
    new = some.field("new")
    of = np.repeat(np.arange(batch.num_rows), n_spans)
    order = np.lexsort((e, s, of))
    s, e, of = s[order], e[order], of[order]
    # the spans that a run meets: from the first that ends after its start, to the last that starts before its end
    low = min(start.min(initial=0), end.min(initial=0), s.min(initial=0), e.min(initial=0))
    width = max(start.max(initial=0), end.max(initial=0), s.max(initial=0), e.max(initial=0)) - low + 2
    at = lambda group, place: group * width + (place - low)
    first, last = np.searchsorted(at(of, e), at(row, start), "right"), np.searchsorted(at(of, s), at(row, end), "left")
    count = np.maximum(last - first, 0)
    run = np.repeat(np.arange(len(row)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    lo, hi = np.clip(s[k] - start[run], 0, size[run]), np.clip(np.minimum(e[k], end[run]) - start[run], 0, size[run])
    shown = s[k] >= start[run]
    # a run's text is what lies before each piece, its new text, and what is left
    again = np.append(False, run[1:] == run[:-1])
    before = np.where(again, np.append(0, hi[:-1]), 0) if len(run) else hi
    left = np.zeros(len(row), np.int64)
    left[run] = hi  # the last piece of a run stays
    codes, plain = _pool(batch.column("__text").cast(pa.binary()).to_pylist())
    added, plain_too = _pool([x or b"" for x in new.cast(pa.binary()).to_pylist()])
    sizes = pc.utf8_length(new).fill_null(0).to_numpy().astype(np.int64)
    new_at = (np.cumsum(sizes) - sizes)[order][k] + len(codes)
    new_size = np.where(shown, sizes[order][k], 0)
    text_at = np.cumsum(size) - size
    if plain != plain_too:
        codes, added = codes.astype(np.uint32), added.astype(np.uint32)
    pool = np.concatenate([codes, added])
    run_of = np.concatenate([np.repeat(run, 2), np.arange(len(row))])
    seg_at = np.concatenate([np.stack([text_at[run] + before, new_at], 1).ravel(), text_at + left])
    seg_size = np.concatenate([np.stack([np.maximum(lo - before, 0), new_size], 1).ravel(), size - left])
    order = np.argsort(run_of, kind="stable")
    seg_at, seg_size, run_of = seg_at[order], seg_size[order], run_of[order]
    from_ = np.arange(seg_size.sum()) + np.repeat(seg_at - (np.cumsum(seg_size) - seg_size), seg_size)
    got = np.bincount(run_of, seg_size, len(row)).astype(np.int64)
    text = _as_strings(pool[from_], got, plain and plain_too, null)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *flat.values(), text], names=["doc_id", *names, "text"])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some TOGETHER characters, a row at least."""
    size = pc.binary_length(batch.column("__text").cast(pa.binary())).fill_null(0).to_numpy().astype(np.int64)
    part = np.cumsum(size) // TOGETHER
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(heads, np.append(heads[1:], batch.num_rows), strict=True):
        yield batch.slice(a, b - a)


def put_in_runs(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """runs (doc_id, start, end, text, ...) with spans (doc_id, start, end, new), sorted and disjoint in a document, put in."""
    names = [c for c in runs.columns if c not in ("doc_id", "text")]
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _packed(batch, names)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in _cut(batch):
                    yield _put_in(part, names)

    packed = runs.mapInArrow(pack, ", ".join([f"doc_id {kinds['doc_id']}", "__bin long", "__text binary", "__chars array<int>", *(f"`{c}` array<{kinds[c]}>" for c in names)]))
    low = F.greatest(F.shiftright(F.col("start").cast("long"), BIN) - 1, F.lit(0))
    high = F.greatest(F.shiftright(F.greatest(F.col("end"), F.col("start") + 1).cast("long") - 1, BIN), F.lit(0))
    bins = F.explode(F.concat(F.sequence(low, high), F.array(F.lit(LONG))))
    own = spans.where("doc_id is not null").select("doc_id", bins.alias("__bin"), F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("new").cast("string").alias("new")).alias("__span"))
    lists = own.groupBy("doc_id", "__bin").agg(F.collect_list("__span").alias("__spans"))
    met = packed.join(lists.hint("merge"), ["doc_id", "__bin"], "left")
    return met.mapInArrow(put, ", ".join([f"doc_id {kinds['doc_id']}", *(f"`{c}` {kinds[c]}" for c in names), f"text {kinds['text']}"]))
