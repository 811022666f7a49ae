"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Words are runs of letters and digits, lower-cased; shingles are five of them. Items are put into
partitions by their number of shingles (powers of two). An item's sketch holds its smallest
shingle hashes: as many as the partition's largest item may miss (a fifth at containment 0.8) and a
margin. A document that contains the item at the threshold holds all of the sketch but for the
shingles it may miss, so the search loses no item however long the document is, while most
documents meet no sketch at all. Candidates are then verified with their shingle texts.

The scan of the documents is one pass: shingles are hashed in generated code and probe the
sketches, which are broadcast only if their number is below `most_broadcast` (else joined by
shuffle). Only pairs that meet a sketch are shuffled, counted map-side first.

Defined results: null or empty texts and items have no shingles and match nothing; of fewer than five
words all are one shingle, so such an item is found only in a document of just these words;
rows of one doc_id (or item_id) count as one document (item); rows with a null id are not reported.
an empty table of documents or items gives no pairs; texts of any length are whole. Columns other than the ids and texts
are not touched. Whether sketches are broadcast changes the plan alone, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import text_column, write_table

K = 5


def words(name: str) -> Column:
    return F.array_remove(F.split(F.lower(text_column(name)), r"[^\p{L}\p{N}]+"), "")


def exploded(df: DataFrame, key: str, name: str = "text") -> DataFrame:
    """key, w (the words), i: a row for each shingle, which starts at word i."""
    some = df.where(F.col(key).isNotNull()).select(key, words(name).alias("w")).where(F.size("w") > 0)
    return some.select(key, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0)))).alias("i"))


def shingle_hash() -> Column:
    return F.xxhash64(*(F.get("w", F.col("i") + j) for j in range(K)))


def shingle_texts(name: str) -> Column:
    """The distinct shingles of a text."""
    w = words(name)
    made = F.transform(F.array(w), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - K, F.lit(0))), lambda i: F.array_join(F.slice(x, i + 1, K), " ")))
    return F.array_distinct(F.element_at(made, 1))


def sketches(items: DataFrame, min_containment: float, margin: int) -> DataFrame:
    """item_id, h, need: the sketch's hashes, and how many of them a match has at least."""
    hashed = exploded(items, "item_id").select("item_id", shingle_hash().alias("h")).distinct()
    counted = hashed.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    may_miss = lambda n: n - F.ceil(n * F.lit(min_containment) - F.lit(1e-9))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the item's size partition
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("h"))).withColumn("m", F.least(F.col("n"), may_miss(largest) + margin))
    return ranked.where(F.col("k") <= F.col("m")).select("item_id", "h", F.greatest(F.lit(1), F.col("m") - may_miss(F.col("n"))).alias("need"))


def leaks(docs: DataFrame, items: DataFrame, min_containment: float = 0.8, margin: int = 2, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every item that a document contains."""
    sketch = write_table(sketches(items, min_containment, margin), "sketches")
    small = sketch.count() <= most_broadcast
    met = exploded(docs, "doc_id").select("doc_id", shingle_hash().alias("h")).join(F.broadcast(sketch) if small else sketch, "h")
    pairs = met.groupBy("doc_id", "item_id", "h").agg(F.max("need").alias("need")).groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    found = write_table(pairs.where(F.col("n") >= F.col("need")).select("doc_id", "item_id"), "leak-candidates")

    doc_ids = found.select("doc_id").distinct()
    whole = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(doc_ids, "doc_id", "left_semi").select("doc_id", shingle_texts("text").alias("has"))
    wanted = items.where(F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("string").alias("text")).where(F.size(words("text")) > 0)
    wanted = wanted.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(shingle_texts("text")))).alias("item"))
    shared = whole.join(found, "doc_id").join(F.broadcast(wanted) if small else wanted, "item_id").select("doc_id", "item_id", F.size("item").alias("n_item"), F.array_intersect("has", "item").alias("shared"))
    # rows of one doc_id count as one document
    counted = shared.groupBy("doc_id", "item_id").agg(F.max("n_item").cast("long").alias("n_item"), F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).cast("long").alias("n_shared"))
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= F.col("n_item") * F.lit(min_containment) - F.lit(1e-9))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that contain no item, as they are."""
    return docs.join(leaks(docs, items, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
