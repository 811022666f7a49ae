"""Sinks: redacted texts, delimited tables, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import base_name, neutralised
from maskwright.operators.replace import key_csv
from maskwright.sources.files import write_named_files


def redacted_name(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn(name, F.concat(base_name(F.col(name)), F.lit(".redacted.txt")))


def write_texts(df: DataFrame, path: str, doc: str = "doc_id", overwrite: bool = False) -> None:
    """name, text (and doc) as files `<base>.redacted.txt` of a folder. Of texts with one base name each has its document's
    id behind the base."""
    named = df.select(F.col(doc).alias("doc"), base_name(F.col("name")).alias("base"), F.col("text"))
    several = named.groupBy("base").agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumn("several", F.lit(True))
    told = named.join(several, "base", "left")
    name = F.concat("base", F.when(F.col("several"), F.concat(F.lit("."), F.col("doc").cast("string"))).otherwise(""), F.lit(".redacted.txt"))
    write_named_files(told.select(name.alias("name"), F.lit(0).alias("part"), F.coalesce("text", F.lit("")).alias("content")), path, overwrite, dealt=True)


def write_texts_table(df: DataFrame, path: str) -> None:
    """name, text as Parquet, where a file for each text would be too many."""
    redacted_name(df).write.mode("errorifexists").parquet(path)


def csv_lines(cells: DataFrame, delimiter: str = ",") -> DataFrame:
    """doc_id, sheet, row, line: cells neutralised and quoted where needed."""
    v = neutralised(F.coalesce("value", F.lit("")))
    marks = F.contains(v, F.lit(delimiter)) | v.rlike(r'["\r\n]') | v.rlike(r"^\s|\s\z")
    quoted = F.when(marks, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    rows = cells.groupBy("doc_id", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", quoted.alias("q")))).alias("c"))
    return rows.select("doc_id", "sheet", "row", F.array_join(F.transform("c", lambda x: x["q"]), delimiter).alias("line"))


def write_csv(cells: DataFrame, path: str, delimiter: str = ",", newline: str = "\n", bom: bool = False, name: Column | None = None, parts: int | None = None) -> None:
    """Rows of cells as delimited files of a folder, one for each name (of the columns doc_id and sheet; by default
    `<doc_id>-<sheet>.redacted-data.csv`, .tsv with tabs). A large table is written by many tasks, as numbered parts in
    order of the rows; with bom the first of them alone starts with the byte order mark."""
    ending = "tsv" if delimiter == "\t" else "csv"
    name = F.format_string(f"%s-%s.redacted-data.{ending}", F.col("doc_id").cast("string"), F.col("sheet").cast("string")) if name is None else name
    lines = csv_lines(cells, delimiter).select(name.alias("name"), F.col("row").cast("long").alias("part"), F.concat("line", F.lit(newline)).alias("content"))
    if bom:
        first = lines.groupBy("name").agg(F.min("part").alias("part")).withColumn("mark", F.lit("\ufeff"))
        marked = lines.join(first, ["name", "part"], "left")
        lines = marked.select("name", "part", F.concat(F.coalesce("mark", F.lit("")), "content").alias("content"))
    write_named_files(lines, path, parts=parts)


def write_key(key: DataFrame, path: str, name: Column | None = None) -> None:
    """The re-identification key of each document as a file of a folder (`<doc_id>.key.csv` by default): type, original,
    replacement, values quoted, in order of first appearance."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".key.csv")) if name is None else name
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in key_csv(key)]
    rows = key.select(name.alias("name"), F.col("position").alias("part"), F.concat(F.when(F.col("position") == 1, "type,original,replacement").otherwise(""), F.lit("\n"), F.concat_ws(",", *quoted)).alias("content"))
    write_named_files(rows, path)


def clean_table(cells: DataFrame, original: DataFrame) -> DataFrame:
    """Cells for a clean workbook: sheets as "Sheet 1..n", a number or boolean kept where the text did not change."""
    o = original.select("doc_id", "sheet", "row", "col", F.col("value").alias("__o"), "scalar_num", "scalar_bool")
    m = cells.join(o, ["doc_id", "sheet", "row", "col"])
    same = F.col("value") == F.col("__o")
    return m.select("doc_id", F.concat(F.lit("Sheet "), (F.col("sheet") + 1).cast("string")).alias("sheet"), "row", "col", "value", F.when(same, F.col("scalar_num")).alias("scalar_num"), F.when(same, F.col("scalar_bool")).alias("scalar_bool"))
