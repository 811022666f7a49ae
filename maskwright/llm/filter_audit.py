"""Audit of filters that are applied one after another: what each order of them removes, at each step.

A document's filters are evaluated once, to a mask of failure bits; all that the audit needs of a corpus is then
the number of documents of each (part, mask), the mask cells. A recursive CTE enumerates the orders: it extends
each prefix of filters by every letter that it does not hold, joins the part's cells, and carries the bits applied
so far; each level emits the metrics of its step. A part has 1 + 5 + 20 + 60 + 120 + 120 prefixes for five filters,
whatever the number of its documents, and orders with a common prefix share its rows.

Plan: one scan of the texts writes a row of digest, id, part and bits for each document. Copies are found by the
smallest id of each digest (a partial minimum, so a text that a third of the rows hold is no hot group), joined
back by id and digest, which no group shares. Cells are summed before they are shuffled.

Defined results: null texts are empty texts, copies of each other; a null part is the empty string; a document
without an id is never a copy of another and never the one that others copy, but counts; repeated rows with the
smallest id of their text are no copies; several labels of a document count once, as 1 if one of them is 1, and
labels of a null id belong to nobody. Texts of any length are read whole. Only the columns named are read, so
others may have any names. An empty table has no parts and gives no rows. Texts are compared by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import WORD_BREAK, text_column, write_table

#: Letter of each filter; bit k of a mask is set where the filter of letter k fails.
FILTERS = "ABCDE"
MOST_FILTERS = 8
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_bits(body: Column, min_words: int = 50, distinct_percent: int = 65, upper_percent: int = 5) -> Column:
    """Failure bits of the filters that need the text alone: A few words, B few distinct words, C upper case, D symbols."""
    # Bound in a lambda, so that the text is split once.
    counted = F.element_at(F.transform(F.array(F.array_remove(F.split(body, WORD_BREAK), "")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), 1)

    def bits(c: Column) -> Column:
        failed = (
            c["n"] < min_words,
            100 * c["d"] < distinct_percent * c["n"],
            100 * F.regexp_count(body, F.lit("[A-Z]")) > upper_percent * F.length(body),
            body.rlike(r"[#$%&*|]"),
        )
        return sum((F.when(bad, F.lit(1 << k)).otherwise(F.lit(0)) for k, bad in enumerate(failed)), F.lit(0))

    return F.element_at(F.transform(F.array(counted), bits), 1)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, good, toxic: one row for each row of docs."""
    body = text_column(text)
    rows = write_table(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), text_bits(body).alias("bits"),
        ),
        "audit-rows",
    )
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    labelled = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    return (
        rows.join(first, ["doc_id", "digest"], "left").join(labelled, "doc_id", "left")
        .select("part", (F.col("bits") + F.when(copy, 16).otherwise(0)).alias("mask"), *(F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")))
    )


def mask_cells(masked: DataFrame) -> DataFrame:
    """part, cells: the counts of each mask that occurs in the part."""
    counts = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^filters cells at most


@contextmanager
def _recursion_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Spark ends recursions of more than a million rows; here their number is known, so no other bound is needed."""
    name, least = "spark.sql.cteRecursionRowLimit", 1_000_000
    before = spark.conf.get(name, str(least))
    if rows > int(before) >= 0:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_PREFIXES = """
WITH RECURSIVE prefixes(part, prefix, applied, step, filter, m) AS (
  SELECT part, CAST('' AS STRING), 0, 0, CAST('' AS STRING),
         named_struct('kept', 0L, 'removed', 0L, 'redundant', 0L, 'unique_fails', 0L, 'good_lost', 0L, 'toxic_lost', 0L)
  FROM {cells}
  UNION ALL
  SELECT p.part, concat(p.prefix, substr('<letters>', f.k + 1, 1)), p.applied | shiftleft(1, f.k), p.step + 1, substr('<letters>', f.k + 1, 1),
         aggregate(c.cells, named_struct('kept', 0L, 'removed', 0L, 'redundant', 0L, 'unique_fails', 0L, 'good_lost', 0L, 'toxic_lost', 0L),
           (m, x) -> named_struct(
             'kept', m.kept + IF(x.mask & (p.applied | shiftleft(1, f.k)) = 0, x.n, 0L),
             'removed', m.removed + IF(x.mask & p.applied = 0 AND x.mask & shiftleft(1, f.k) <> 0, x.n, 0L),
             'redundant', m.redundant + IF(x.mask & p.applied <> 0 AND x.mask & shiftleft(1, f.k) <> 0, x.n, 0L),
             'unique_fails', m.unique_fails + IF(x.mask = shiftleft(1, f.k), x.n, 0L),
             'good_lost', m.good_lost + IF(x.mask & p.applied = 0 AND x.mask & shiftleft(1, f.k) <> 0, x.good, 0L),
             'toxic_lost', m.toxic_lost + IF(x.mask & p.applied = 0 AND x.mask & shiftleft(1, f.k) <> 0, x.toxic, 0L)))
  FROM prefixes p JOIN {cells} c ON c.part = p.part LATERAL VIEW explode(sequence(0, <last>)) f AS k
  WHERE p.applied & shiftleft(1, f.k) = 0
)
SELECT part, prefix, step, filter, m.* FROM prefixes WHERE step > 0
"""


def prefixes(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """part, prefix (filters applied so far), step, filter (the last of them) and its metrics; for every prefix of every order."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters) or not letters.isalnum():
        raise ValueError(f"one letter or digit a filter, {MOST_FILTERS} filters at most")
    spark = cells.sparkSession
    cells = write_table(cells, "audit-cells")
    a_part = sum(factorial(len(letters)) // factorial(len(letters) - k) for k in range(len(letters) + 1))
    with _recursion_rows(spark, cells.count() * a_part + 1):  # it ends where a level adds no row below the bound
        return write_table(spark.sql(_PREFIXES.replace("<letters>", letters).replace("<last>", str(len(letters) - 1)), cells=cells), "audit-prefixes")


def orders(found: DataFrame, letters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and metrics of every full order; shapley: its filter's removed, summed over all orders."""
    n = len(letters)
    # A prefix of k filters begins (n - k)! orders.
    begun = F.element_at(F.array(*(F.lit(factorial(n - k)) for k in range(1, n + 1))), F.col("step"))
    shapley = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * begun).alias("shapley"))
    steps = (
        found.where(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
        .withColumn("prefix", F.col("filter_order").substr(F.lit(1), F.col("step")))
    )
    return steps.join(found, ["part", "prefix", "step"]).join(shapley, ["part", "filter"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), *METRICS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    return orders(prefixes(mask_cells(masks(docs, labels, id_col, text, part))))
