"""Repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

The corpus is the sequence of its non-blank lines, document after document. Round k ranks every
position by its next 2^k lines: the rank of a position and the rank of the one 2^(k-1) lines on make a
pair, distinct pairs are range-sorted, and a pair's place is the new rank (order-preserving, so
the last ranks are the suffix array). Positions of equal rank are an interval of the array with a
common prefix of 2^k lines or more; a position alone in its interval is settled and leaves, so
rounds get smaller and end when no run repeats at that length.

A position whose interval has an earlier position starts a later copy. Runs of two lines or more,
or of one line of `min_chars` characters or more, that start earlier in the corpus (by doc_id,
then by line) are deleted; the union of these windows is every maximal repeated run, which `runs`
lists with its earlier copy. Of every line some copy stays.

Each round shuffles the open positions by document (a range window), by pair (counted map-side)
and joins the ranks back by pair, a join that adaptive execution splits where a pair is hot.
Nothing is gathered but Spark's range samples.

Defined results: lines are compared without white space at their ends; blank lines are never
compared, and go only inside a deleted run; null texts stay null and empty ones empty; rows of the same
id and text count as one document and fare alike; rows with a null id come first in the order and
are handled like others; an empty table gives no rows; texts of any length are split whole; other columns stay as they
are, but for one named `__removed`, which is an error, as the report has that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import write_table

KEY = ("doc_id", "th")
BLANKS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), i (number among non-blank lines), j (among all), a, b (the
    line's id: two hashes), chars."""
    split = F.split(F.col("text").cast("string"), "\n")
    trimmed = F.transform(split, lambda x, j: F.struct(F.regexp_replace(x, BLANKS, "").alias("line"), j.alias("j")))
    lines = docs.select("doc_id", _text_hash().alias("th"), F.posexplode(F.filter(trimmed, lambda x: x["line"] != "")).alias("i", "x"))
    return lines.select(*KEY, "i", "x.j", F.xxhash64("x.line").alias("a"), F.xxhash64(F.lit(1), "x.line").alias("b"), F.length("x.line").alias("chars"))


def _place() -> Column:
    return F.struct("doc_id", "th", "i")


def _ranked(positions: DataFrame, by: list[str]) -> DataFrame:
    """Positions whose `by` others share too, with its rank and the first such position."""
    groups = positions.groupBy(*by).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last")
    ranks = groups.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, "first", F.monotonically_increasing_id().alias("rank"))
    return positions.join(write_table(ranks, "line-ranks"), by)


def repeated(docs: DataFrame, min_chars: int = 120, most_rounds: int = 24) -> tuple[DataFrame, DataFrame]:
    """(lines, copies). copies: doc_id, th, i, n (lines of the window: 1 or 2, the least that count),
    depth (2^k lines at least are common), first (the earliest position of that common prefix)."""
    lines = write_table(line_table(docs), "lines")
    level = write_table(_ranked(lines, ["a", "b"]).select(*KEY, "i", "chars", "first", "rank"), "line-level")
    later = F.struct("first.doc_id", "first.th", "first.i") < _place()
    copies = [level.where(later & (F.col("chars") >= min_chars)).select(*KEY, "i", F.lit(1).alias("n"), F.lit(1).alias("depth"), "first")]
    for k in range(most_rounds):
        step = 1 << k
        ahead = Window.partitionBy(*KEY).orderBy("i").rangeBetween(step, step)
        pairs = level.select(*KEY, "i", F.col("rank").alias("r"), F.max("rank").over(ahead).alias("s")).where("s is not null")
        level = write_table(_ranked(pairs, ["r", "s"]).select(*KEY, "i", "first", "rank"), "line-level")
        if level.isEmpty():
            break
        copies.append(level.where(later).select(*KEY, "i", F.lit(2).alias("n"), F.lit(2 * step).alias("depth"), "first"))
    found = copies[0]
    for c in copies[1:]:
        found = found.unionByName(c)
    return lines, found


def runs(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, th, first_line, last_line (among all lines of the text), n_lines (non-blank), depth,
    copy_of: the maximal runs to delete, with the earlier position of their longest common prefix, of equal ones the first line's."""
    at = copies.groupBy(*KEY, "i").agg(F.max("n").alias("n"), F.max("depth").alias("depth"), F.max_by("first", "depth").alias("copy_of"))
    covered = at.select(*KEY, F.explode(F.when(F.col("n") == 2, F.array(F.col("i"), F.col("i") + 1)).otherwise(F.array("i"))).alias("i"), "depth", "copy_of")
    covered = covered.groupBy(*KEY, "i").agg(F.max("depth").alias("depth"), F.max_by("copy_of", "depth").alias("copy_of"))
    numbered = covered.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*KEY).orderBy("i")))
    same = [lines[k].eqNullSafe(numbered[k]) for k in (*KEY, "i")]
    with_lines = numbered.join(lines, same[0] & same[1] & same[2]).select(*(numbered[k] for k in KEY), lines["j"], "run", "depth", "copy_of")
    return with_lines.distinct().groupBy(*KEY, "run").agg(F.min("j").alias("first_line"), F.max("j").alias("last_line"), F.count("*").alias("n_lines"), F.max("depth").alias("depth"), F.min_by("copy_of", F.struct(-F.col("depth"), "j")).alias("copy_of")).drop("run")


def dedup(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """docs with the later copies of repeated runs deleted from `text`, and a struct column
    __removed (n_lines, n_removed, n_runs, longest_run)."""
    if "__removed" in docs.columns:
        raise ValueError("a column is named __removed")
    lines, copies = repeated(docs, min_chars)
    spans = runs(lines, copies).groupBy(*KEY).agg(
        F.collect_list(F.struct(F.col("first_line").alias("s"), F.col("last_line").alias("e"))).alias("spans"), F.sum("n_lines").alias("n_removed"), F.count("*").alias("n_runs"), F.max("n_lines").alias("longest_run")
    )
    d = docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("__id"), _text_hash().alias("__th"))
    met = d.join(spans, d["__id"].eqNullSafe(spans["doc_id"]) & (d["__th"] == spans["th"]), "left")
    split = F.split(F.col("d.text").cast("string"), "\n")
    kept = F.filter(split, lambda x, j: ~F.exists(F.col("spans"), lambda r: (j >= r["s"]) & (j <= r["e"])))
    text = F.when(F.col("spans").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: F.regexp_replace(x, BLANKS, "") != "")), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return met.select(*(text.alias(c) if c == "text" else F.col("d").getField(c).alias(c) for c in docs.columns), F.struct(F.when(F.col("d.text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), zero("n_removed"), zero("n_runs"), zero("longest_run")).alias("__removed"))


def clean(docs: DataFrame, min_chars: int = 120) -> DataFrame:
    """The documents without later copies; those of which nothing is left go."""
    done = dedup(docs, min_chars)
    emptied = (F.col("__removed.n_removed") > 0) & (F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") == "")
    return done.where(~emptied).drop("__removed")
