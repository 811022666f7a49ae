"""Delimited files of any size, cut into byte ranges that many tasks read.

Whether a newline ends a record depends on all quotes before it, so a range cannot know its own state. Each range is
therefore read once under every state that it may begin in: what it gives is a map from those states to the states
at its end, with the records that end on the way. Such maps compose, so a prefix scan over a file's ranges (three
small rows a gigabyte, not the text) tells each range its state and the number of its first record; the ranges are
then parsed side by side, each the records that begin in it, the last one beyond its end.

Files are listed by tasks (`files.listed`), and their ranges are rows; a task reads many of them, however small they are,
and a range of RANGE_BYTES or more alone. Files are read through pyarrow's file systems, so their store has to be one that pyarrow
knows; `readers.read_tables` reads files of 2 GB at most through Spark itself.

Encodings and dialects are those of `readers`: a byte order mark, else UTF-8, else Windows-1252; tabs for .tsv, else the
most frequent mark of the first ten lines (of their first megabyte). A file whose quoting is broken, or that is
UTF-16 with odd or unpaired units, is rejected whole with a reason. Numbered parts of one file (`x.part-00000.csv`, as
the sink of named files leaves large ones) are read as that file, in order, with the first part's encoding and dialect.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions.text import extension
from maskwright.sources.files import listed, opened
from maskwright.sources.readers import DELIMITERS, TABLES
from maskwright.storage import write_table

RANGE_BYTES = 32 << 20
_BLOCK = 1 << 20
_HEAD = 1 << 20
#: Bytes that are searched first for the end of a record.
_NEAR = 1 << 12
#: Rows that are handed on together.
_ROWS = 10_000

#: States of a reader before a symbol.
RECORD, FIELD, PLAIN, QUOTED, CLOSED, BROKEN = range(6)
#: Symbols; a carriage return before a line feed begins a record, if none has begun, but ends none.
OTHER, MARK, QUOTE, NEWLINE, RETURN = range(5)
#: The next state, by state and symbol: quotes count at a cell's start and inside quotes alone.
_NEXT = np.array(
    [
        [PLAIN, FIELD, QUOTED, RECORD, FIELD],
        [PLAIN, FIELD, QUOTED, RECORD, FIELD],
        [PLAIN, FIELD, PLAIN, RECORD, PLAIN],
        [QUOTED, QUOTED, CLOSED, QUOTED, QUOTED],
        [BROKEN, FIELD, QUOTED, RECORD, CLOSED],
        [BROKEN, BROKEN, BROKEN, BROKEN, BROKEN],
    ],
    np.uint8,
)
_SAME = np.arange(6, dtype=np.uint8)
#: Whether a newline ends a record, by state.
_ENDS = np.array([1, 1, 1, 0, 1, 0], np.int64)
#: Maps of a symbol, without and with other characters before it.
_STEP = np.stack([_NEXT.T, _NEXT.T[:, _NEXT.T[OTHER]]])
_COUNT = np.stack([np.outer(np.arange(5) == NEWLINE, _ENDS), np.outer(np.arange(5) == NEWLINE, _ENDS[_NEXT.T[OTHER]])])


def composed(maps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One map and one count (each by starting state) of many, one after another; pairs are joined, round by round."""
    while len(maps) > 1:
        if len(maps) % 2:
            maps, counts = np.vstack([maps, _SAME[None]]), np.vstack([counts, np.zeros((1, 6), np.int64)])
        first, second = maps[::2], maps[1::2]
        counts = counts[::2] + np.take_along_axis(counts[1::2], first.astype(np.int64), 1)
        maps = np.take_along_axis(second, first.astype(np.int64), 1)
    return (maps[0], counts[0]) if len(maps) else (_SAME, np.zeros(6, np.int64))


def symbols(units: np.ndarray, after: int | None, delimiter: str) -> np.ndarray:
    """The symbol of each character code; after: the code that follows the last, if any."""
    following = np.append(units[1:], units.dtype.type(0 if after is None else after))
    out = np.full(len(units), OTHER, np.uint8)
    out[units == ord(delimiter)] = MARK
    out[units == ord('"')] = QUOTE
    out[(units == 10) | (units == 13)] = NEWLINE
    out[(units == 13) & (following == 10)] = RETURN
    return out


def block_map(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map and the counts of a block of symbols."""
    at = np.flatnonzero(found)
    led = (np.diff(at, prepend=-1) > 1).astype(np.int64)  # whether other characters stand before it
    maps, counts = _STEP[led, found[at]], _COUNT[led, found[at]]
    if len(found) and found[-1] == OTHER:
        maps, counts = np.vstack([maps, _NEXT[:, OTHER][None]]), np.vstack([counts, np.zeros((1, 6), np.int64)])
    return composed(maps, counts)


@dataclass(frozen=True)
class Layout:
    """How a file's bytes are to be read: where its text begins, in which encoding, and its delimiter."""

    skip: int
    encoding: str
    delimiter: str

    @property
    def unit(self) -> np.dtype:
        return np.dtype({"UTF-16LE": "<u2", "UTF-16BE": ">u2"}.get(self.encoding, "u1"))


def layout_of(path: str, head: bytes) -> Layout:
    skip, encoding = next((v for mark, v in ((b"\xff\xfe", (2, "UTF-16LE")), (b"\xfe\xff", (2, "UTF-16BE")), (b"\xef\xbb\xbf", (3, "UTF-8"))) if head.startswith(mark)), (0, "UTF-8"))
    if path.lower().endswith(".tsv"):
        return Layout(skip, encoding, "\t")
    text = head[skip:].decode(encoding if skip == 2 else "latin-1", "replace")
    first = "\n".join(text.replace("\r\n", "\n").split("\n", 10)[:10])
    return Layout(skip, encoding, max(DELIMITERS, key=first.count))


def _valid_utf16(units: np.ndarray, after: int | None, is_first: bool) -> bool:
    high = (units >= 0xD800) & (units < 0xDC00)
    low = np.append((units >= 0xDC00) & (units < 0xE000), after is not None and 0xDC00 <= after < 0xE000)
    return bool((high == low[1:]).all()) and not (is_first and low[0])


def _valid_utf8(data: bytes, rest: bytes, is_first: bool) -> bool:
    """Whether the characters that begin in data are whole; rest: the bytes after it, for the last of them."""
    lead = 0
    while not is_first and lead < min(3, len(data)) and data[lead] & 0xC0 == 0x80:
        lead += 1
    if lead == len(data):
        return True
    more = 0
    while more < min(3, len(rest)) and rest[more] & 0xC0 == 0x80:
        more += 1
    try:
        (data[lead:] + rest[:more]).decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


#: Opens a path for reading; what it gives can seek.
Open = Callable[[str], io.RawIOBase]


_PART = re.compile(r"\.part-\d{5,}(?=\.[^./]*\Z|\Z)")


def whole_name(path: str) -> str:
    """The file that a numbered part belongs to; other paths as they are."""
    return _PART.sub("", path)


def head_layout(open_: Open, path: str) -> Layout:
    with open_(path) as f:
        return layout_of(path, f.read(_HEAD))


def summary(open_: Open, path: str, size: int, start: int, end: int, head: str | None = None, how: Layout | None = None) -> tuple:
    """path, size, start, end, skip, encoding, delimiter, ends (by starting state), records (ended, by starting state), valid.
    head: the first part of the file, where path is a later one; how: that part's layout, where it is known."""
    how = how or head_layout(open_, head or path)
    if head and head != path:
        how = Layout(0, how.encoding, how.delimiter)
    with open_(path) as f:
        wide = how.unit.itemsize
        at, maps, counts, valid = max(start, how.skip), [], [], not (wide == 2 and size % 2)
        f.seek(at)
        ahead = f.read(min(_BLOCK, max(0, end - at)) + 4)
        while at < end:
            n = min(_BLOCK, end - at)
            data, rest = ahead[:n], ahead[n:]
            ahead = rest + f.read(min(_BLOCK, max(0, end - at - n)))
            units = np.frombuffer(data[: n - n % wide], how.unit)
            after = int(np.frombuffer(rest[:wide], how.unit)[0]) if len(rest) >= wide else None
            is_first = at == how.skip
            valid = valid and (_valid_utf16(units, after, is_first) if wide == 2 else _valid_utf8(data, rest, is_first))
            m, c = block_map(symbols(units, after, how.delimiter))
            maps.append(m)
            counts.append(c)
            at += n
    m, c = composed(np.array(maps, np.uint8).reshape(-1, 6), np.array(counts, np.int64).reshape(-1, 6))
    return path, size, start, end, how.skip, how.encoding, how.delimiter, m.tolist(), c.tolist(), valid


SUMMARY = "file string, path string, size long, start long, end long, skip int, encoding string, delimiter string, ends array<int>, records array<long>, valid boolean"
CARRIED = "file string, path string, start long, end long, skip int, encoding string, delimiter string, state int, row long, reason string"


def carry(ranges: list[tuple]) -> list[tuple]:
    """A file's ranges, in order, with their state, the number of the first record that begins in them, and the reason
    why the file is refused, if it is."""
    state, row, out = RECORD, 0, []
    encoding, file = ranges[0][5], whole_name(ranges[0][0])
    all_valid = all(r[9] for r in ranges)
    if encoding == "UTF-8" and not all_valid and ranges[0][4] == 0:
        encoding = "windows-1252"
    for path, _, start, end, skip, _, delimiter, ends, records, _ in ranges:
        out.append((file, path, start, end, skip, encoding, delimiter, state, row + (state != RECORD)))
        row, state = row + records[state], ends[state]
    reason = None
    if encoding.startswith("UTF-16") and not all_valid:
        reason = "broken UTF-16"
    elif state in (QUOTED, BROKEN):
        reason = "malformed quoting: " + ("a quote is never closed" if state == QUOTED else "text after a closing quote")
    return [(*r, reason) for r in out]


class _Lines:
    """The lines of a file from a place on, and how many bytes those read took."""

    def __init__(self, raw, encoding: str):
        self.encoding, self.taken = encoding, 0
        self.text = io.TextIOWrapper(raw, encoding=encoding.lower(), errors="replace", newline="")

    def __iter__(self) -> Iterator[str]:
        for line in self.text:
            self.taken += len(line) if self.encoding == "windows-1252" else len(line.encode(self.encoding, "replace"))
            yield line


def records(open_: Open, path: str, start: int, end: int, skip: int, encoding: str, delimiter: str, state: int, row: int) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of the records that begin in a range."""
    csv.field_size_limit((1 << 31) - 1)
    how = Layout(skip, encoding, delimiter)
    at = max(start, skip)
    with open_(path) as f:
        f.seek(at)
        block = _NEAR
        while state != RECORD and at < end:  # to the end of the record that an earlier range began
            data = f.read(block + how.unit.itemsize)
            units = np.frombuffer(data[: len(data) - len(data) % how.unit.itemsize], how.unit)
            n = min(len(units), block // how.unit.itemsize)
            block = min(2 * block, _BLOCK)
            if not n:
                return
            found = symbols(units[:n], int(units[n]) if len(units) > n else None, delimiter).tolist()
            k = 0
            while k < n and state != RECORD:
                state = int(_NEXT[state, found[k]])
                k += 1
            at += k * how.unit.itemsize
            f.seek(at)
        if at >= end:
            return
        lines = _Lines(f, encoding)
        parsed = csv.reader(iter(lines), delimiter=delimiter, strict=True)
        while at + lines.taken < end:
            cells = next(parsed, None)
            if cells is None:
                return
            yield row, cells or [""]
            row += 1


def _batches(rows: Iterator[tuple], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches, however few each file or range has."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), shape.types, strict=True)], schema=shape)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), shape.types, strict=True)], schema=shape)


_STRING, _INT, _LONG = pa.string(), pa.int32(), pa.int64()
_SUMMED = pa.schema([("file", _STRING), ("path", _STRING), ("size", _LONG), ("start", _LONG), ("end", _LONG), ("skip", _INT), ("encoding", _STRING), ("delimiter", _STRING), ("ends", pa.list_(_INT)), ("records", pa.list_(_LONG)), ("valid", pa.bool_())])
_CARRIED = pa.schema([("file", _STRING), ("path", _STRING), ("start", _LONG), ("end", _LONG), ("skip", _INT), ("encoding", _STRING), ("delimiter", _STRING), ("state", _INT), ("row", _LONG), ("reason", _STRING)])
_RECORDS = pa.schema([("file", _STRING), ("row", _LONG), ("cells", pa.list_(_STRING))])


def carried(ranges: DataFrame) -> DataFrame:
    """The prefix scan: each range with the state and the row number it begins with. A task goes through file after file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        yield from _batches((r for _, of in groupby(rows, lambda r: r[0]) for r in carry([r[1:] for r in of])), _CARRIED)

    return ranges.repartition("file").sortWithinPartitions("file", "path", "start").mapInArrow(run, CARRIED)


def read_large_tables(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects) of a delimited file, or of all in a folder, as `readers.read_tables` gives them, but with files of
    any size read by many tasks; rows are numbered through a file."""
    width = max(2, range_bytes - range_bytes % 2)  # no range parts the two bytes of a UTF-16 unit
    whole = F.regexp_replace("path", _PART.pattern.replace(r"\Z", r"\z"), "")
    tables = listed(spark, path).where(extension(F.col("path")).isin(*TABLES)).withColumn("file", whole)
    found = write_table(tables.withColumn("head", F.min("path").over(Window.partitionBy("file"))), "files")
    some = F.greatest(F.lit(1), F.ceil(F.col("size") / width))
    ranges, size = found.agg(F.coalesce(F.sum(some), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(int(ranges), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // RANGE_BYTES))))
    cut = found.select("file", "path", "size", "head", F.explode(F.sequence(F.lit(0).cast("long"), some - 1)).alias("k"))
    cut = cut.select("file", "path", "size", "head", (F.col("k") * width).alias("start"), F.least("size", (F.col("k") + 1) * width).alias("end"))

    def in_tasks(df: DataFrame) -> DataFrame:
        """Ranges next to each other are read by one task, as many in each."""
        return df.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            head, how = None, None
            for b in batches:
                for r in b.to_pylist():
                    if r["head"] != head:
                        head, how = r["head"], head_layout(opened, r["head"])
                    yield r.pop("file"), *summary(opened, how=how, **r)

        yield from _batches(rows(), _SUMMED)

    known = write_table(carried(in_tasks(cut).mapInArrow(summaries, SUMMARY)), "ranges")
    good = known.where("reason is null").drop("reason")
    rejects = known.where("reason is not null").select(F.col("file").alias("path"), "reason").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for r in b.to_pylist():
                    file = r.pop("file")
                    for number, cells in records(opened, **r):
                        yield file, number, cells

        yield from _batches(rows(), _RECORDS)

    rows = in_tasks(good).mapInArrow(run, "file string, row long, cells array<string>")
    cells = rows.select(F.col("file").alias("doc_id"), F.lit(0).alias("sheet"), "row", F.posexplode("cells").alias("col", "value"))
    return cells, rejects
