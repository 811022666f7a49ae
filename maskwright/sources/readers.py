"""Sources: whole texts, delimited tables, term lists, annotated corpora, with reasons for what is refused."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import extension, trimmed
from maskwright.sources.files import listed, opened

# Extensions by kind, and why others are refused.
TEXTS = ("txt", "md", "json", "log", "xml", "html", "htm", "eml", "yaml", "yml")
TABLES = ("csv", "tsv")
REFUSED = {"xls": "old workbook: save it as .xlsx", "xlsm": "workbook with macros: save it as .xlsx", "xlsb": "binary workbook: save it as .xlsx", "doc": "old document: save it as .docx"}
DELIMITERS = (",", ";", "\t", "|")
# End of fixed values.


def dispatch(files: DataFrame) -> DataFrame:
    """files (path, ...) with `kind` (text, table, or null) and `reason` where refused."""
    ext = extension(F.col("path"))
    reason = F.lit(None).cast("string")
    for e, why in REFUSED.items():
        reason = F.when(ext == e, why).otherwise(reason)
    kind = F.when(ext.isin(*TEXTS), "text").when(ext.isin(*TABLES), "table")
    return files.withColumns({"kind": kind, "reason": F.when(kind.isNull(), F.coalesce(reason, F.lit("unsupported type")))})


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, text: every file as one text, as it stands."""
    df = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return df.where(extension(F.col("name")).isin(*TEXTS))


#: Bytes of texts that `read_text_files` hands on together.
_TOGETHER = 4 << 20


def read_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same of millions of files, in a folder and the folders in it, through pyarrow's file systems: folders are listed by
    tasks (`files.listed`), where `read_texts` has the driver hold a record of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                with opened(path) as f:
                    texts.append(f.read())
                names.append(path)
                size += len(texts[-1]) + len(path)
                if size > _TOGETHER:
                    yield shaped(names, texts)
                    names, texts, size = [], [], 0
        if names:
            yield shaped(names, texts)

    def shaped(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["name", "text"])

    found = listed(spark, paths).where(extension(F.col("path")).isin(*TEXTS)).select("path")
    dealt = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "name string, text binary").select("name", F.col("text").cast("string").alias("text"))


def whole_units(body: Column, little: bool) -> Column:
    """Whether UTF-16 bytes are whole units, with each high surrogate before a low one and no other low ones."""
    byte = "[0-9A-F]{2}"
    unit = (lambda high: byte + high) if little else (lambda high: high + byte)
    plain, high, low = unit("(?:[0-9A-CEF][0-9A-F]|D[0-7])"), unit("D[89AB]"), unit("D[C-F]")
    return F.hex(body).rlike(f"^(?:{plain}|{high}{low})*+\\z")


def decoded(content: Column) -> Column:
    """struct<text, encoding, bom>: by the byte order mark, else UTF-8, else Windows-1252. The last needs
    spark.sql.legacy.javaCharsets=true in the session. UTF-16 with odd or unpaired units has a null text."""
    head2, head3 = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 3))
    encoding = F.when(head2 == "FFFE", "UTF-16LE").when(head2 == "FEFF", "UTF-16BE").when(head3 == "EFBBBF", "UTF-8").when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("windows-1252")
    skip = F.when(head2.isin("FFFE", "FEFF"), 3).when(head3 == "EFBBBF", 4).otherwise(1)
    body = F.substring(content, skip, F.length(content))
    wide = lambda e: F.when(whole_units(body, e == "UTF-16LE"), F.decode(body, e))
    text = F.when(encoding == "UTF-16LE", wide("UTF-16LE")).when(encoding == "UTF-16BE", wide("UTF-16BE")).when(encoding == "UTF-8", body.cast("string")).otherwise(F.decode(body, "windows-1252"))
    return F.struct(text.alias("text"), encoding.alias("encoding"), (skip > 1).alias("bom"))


def dialect_of(name: Column, text: Column) -> Column:
    """struct<delimiter, newline>: tab for .tsv, else the most frequent mark of the first lines."""
    head = F.array_join(F.slice(F.split(text, r"\r?\n"), 1, 10), "\n")
    counts = F.array(*(F.struct(F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))), F.lit(-k), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)))
    best = F.array_max(counts)["d"]
    newline = F.when(F.contains(text, F.lit("\r\n")), "\r\n").when(F.contains(text, F.lit("\n")), "\n").when(F.contains(text, F.lit("\r")), "\r").otherwise("\n")
    return F.struct(F.when(extension(name) == "tsv", "\t").otherwise(best).alias("delimiter"), newline.alias("newline"))


def parsed(text: str, delimiter: str) -> Iterator[list[str]]:
    """Records of delimited text: quoted cells, doubled quotes and newlines inside quotes, blank lines kept as one empty
    cell. A quote that is never closed, or text between a closing quote and the next mark, is an error."""
    csv.field_size_limit((1 << 31) - 1)
    lines = io.StringIO(text, newline="")
    for row in csv.reader(lines, delimiter=delimiter, strict=True):
        yield row or [""]


def read_tables(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects) of delimited files, whatever their encoding and dialect. cells: doc_id (path), sheet,
    row, col, value, all strings as they stand; rejects: path, reason. A file is parsed by one task (quoted newlines allow
    no cut), record by record, and is 2 GB at most, as Spark's binary source has it; `read_plain_table` splits larger ones."""
    return parsed_tables(spark.read.format("binaryFile").load(paths).where(extension(F.col("path")).isin(*TABLES)))


def parsed_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of files (path, content) that were chosen otherwise."""
    raw = files.select("path", decoded(F.col("content")).alias("d")).select("path", "d.text", "d.encoding")
    broken = F.col("text").isNull() & F.col("encoding").startswith("UTF-16")
    d = raw.where(~broken).withColumn("s", dialect_of(F.col("path"), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text, delimiter in zip(*(b.column(c).to_pylist() for c in ("path", "text", "delimiter")), strict=True):
                error, rows = None, []
                try:
                    for k, cells in enumerate(parsed(text, delimiter)):
                        rows.append((path, k, cells, None))
                except csv.Error as e:
                    error, rows = str(e), []
                rows = rows if error is None else [(path, None, None, error)]
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names=["path", "row", "cells", "error"])

    kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
    flat = d.select("path", F.coalesce("text", F.lit("")).alias("text"), F.col("s.delimiter").alias("delimiter"))
    got = flat.mapInArrow(run, "path string, row int, cells array<string>, error string")
    rejects = got.where("error is not null").select("path", F.concat(F.lit("malformed quoting: "), "error").alias("reason"))
    rejects = rejects.unionByName(raw.where(broken).select("path", F.lit("broken UTF-16").alias("reason")))
    rows = got.where("error is null").select(F.col("path").alias("doc_id"), F.lit(0).alias("sheet"), "row", F.posexplode("cells").alias("col", "value"))
    return rows, rejects


def read_plain_table(spark: SparkSession, path: str, columns: int, delimiter: str = ",") -> DataFrame:
    """doc_id (path), line (a number that rises within a split), col, value of UTF-8 files of any size without newlines in
    quotes: splits are read by many tasks; blank lines are skipped."""
    names = [f"c{k}" for k in range(columns)]
    shape = ", ".join(f"{n} string" for n in names)
    raw = spark.read.schema(shape).option("sep", delimiter).option("escape", '"').option("emptyValue", "").option("nullValue", "\x00").csv(path)
    rows = raw.select(F.input_file_name().alias("doc_id"), F.monotonically_increasing_id().alias("line"), F.posexplode(F.array(*names)).alias("col", "value"))
    return rows.where("value is not null")


def read_terms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """term: the non-empty lines of term lists."""
    return spark.read.text(paths).select(trimmed(F.col("value")).alias("term")).where("term <> ''").distinct()


def read_annotated(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(texts, gold) of JSON lines {"text", "spans": [{"start", "end", "label"}]}."""
    raw = spark.read.schema("text string, spans array<struct<start:int,end:int,label:string>>").json(paths)
    texts = raw.withColumn("doc_id", F.xxhash64("text"))
    return texts.select("doc_id", "text"), texts.select("doc_id", F.inline("spans")).withColumnRenamed("label", "type")


def union_sheets(*sheets: DataFrame) -> DataFrame:
    """Cells of several sheets as one document; sheet numbers follow the order given."""
    out = None
    for k, cells in enumerate(sheets):
        one = cells.withColumn("sheet", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def coverage_notes(files: DataFrame) -> DataFrame:
    """path, notes: what a reader should know about how a file was read (columns encoding, bom)."""
    notes = F.array_compact(F.array(F.when(F.col("encoding") == "windows-1252", "read as Windows-1252"), F.when(F.col("encoding").startswith("UTF-16"), "saved again as UTF-8"), F.when(F.col("bom"), "byte order mark kept")))
    return files.select("path", notes.alias("notes"))
