"""Replacement: consistent numbering and splicing.

`redacted` works in the row: detection, resolution, numbering and splicing of a text need no shuffle.
`label_map` and `apply_spans` do the same where spans are a table, with one shuffle by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.config import POOLS
from maskwright.functions.text import blocks, bound, cut, let, let_sql, neutralised, normalised
from maskwright.operators.intervals import Ranged

MASK = "[REDACTED]"


def _pool(type_: Column, n: Column) -> Column:
    """The nth stand-in of a type; null beyond its pool, or without one."""
    found = F.lit(None).cast("string")
    for name, values in POOLS.items():
        found = F.when(type_ == name, F.get(F.array(*map(F.lit, values)), (n - 1).cast("int"))).otherwise(found)
    return found


def replacement(type_: Column, n: Column, mode: str) -> Column:
    label = F.concat(F.lit("["), type_, F.lit("_"), n.cast("string"), F.lit("]"))
    return F.lit(MASK) if mode == "redact" else F.coalesce(_pool(type_, n), label) if mode == "pseudonymize" else label


#: Of keyed spans v (s, type, key): sorted by key (o), the first of each key (at), those in order of appearance by type (h), and
#: their numbers, in the order of at again. Sorts in place of searches, so thousands of values take their time only once.
_NUMBERED = bound("o", "sort_array(transform(v, (x, i) -> named_struct('type', x.type, 'key', x.key, 'i', i)))", bound(
    "at", "filter(sequence(0, size(o) - 1), j -> j = 0 OR o[j - 1].key <> o[j].key OR o[j - 1].type <> o[j].type)", bound(
        "h", "sort_array(transform(at, j -> named_struct('type', o[j].type, 'i', o[j].i, 'key', o[j].key)))", bound(
            "first", "filter(transform(h, (x, j) -> named_struct('type', x.type, 'j', j)), (x, j) -> j = 0 OR h[j - 1].type <> x.type)", bound(  # one for each type
                "n", "sort_array(transform(h, (x, j) -> named_struct('type', x.type, 'key', x.key, 'n', j + 1 - aggregate(first, 0, (a, f) -> IF(f.type = x.type, f.j, a)))))", bound(
                    "back", "sort_array(flatten(transform(at, (j, m) -> transform(slice(o, j + 1, coalesce(get(at, m + 1), size(o)) - j), x -> named_struct('i', x.i, 'n', n[m].n)))))",
                    "transform(v, (x, i) -> named_struct('s', x.s, 'key', x.key, 'n', back[i].n))",
                ))))))
#: The same by searching, which is quicker where there are few.
_FEW_NUMBERED = bound("d", "array_distinct(transform(v, x -> named_struct('type', x.type, 'key', x.key)))", (
    "transform(v, x -> named_struct('s', x.s, 'key', x.key, 'n', cast(array_position(transform(filter(d, y -> y.type = x.type), y -> y.key), x.key) AS int)))"
))
_ONE = "transform(v, x -> named_struct('s', x.s, 'key', x.key, 'n', 1))"


def numbered(spans: Column) -> Column:
    """Spans (sorted, disjoint) as structs s, key, n: n counts the values of a type by first appearance."""
    keyed = F.transform(spans, lambda s: F.struct(s.alias("s"), s["type"].alias("type"), F.concat(s["type"], F.lit(":"), normalised(s["text"])).alias("key")))
    return let_sql(keyed, f"CASE WHEN size(v) <= 1 THEN {_ONE} WHEN size(v) <= 24 THEN {_FEW_NUMBERED} ELSE {_NUMBERED} END")


_BEFORE = "IF(i = 0, 0, get(v.p, i - 1).`end`)"
_SPLICED = "concat(array_join(transform(v.p, (x, i) -> concat({gap}, x.new)), ''), {tail})"
#: Few pieces are cut from the text itself, many from its blocks.
_FEW_PIECES = _SPLICED.format(gap=f"substr(v.t, {_BEFORE} + 1, x.start - {_BEFORE})", tail="substr(v.t, get(v.p, size(v.p) - 1).`end` + 1)")
_MANY_PIECES = bound("b", blocks("v.t"), _SPLICED.format(gap=cut(_BEFORE, "x.start"), tail=cut("get(v.p, size(v.p) - 1).`end`", "length(v.t)")))


def spliced(text: Column, pieces: Column) -> Column:
    """text with array<struct<start, end, new>> put in; pieces are sorted and disjoint."""
    both = F.struct(text.alias("t"), pieces.alias("p"))
    return let_sql(both, f"CASE WHEN size(v.p) = 0 THEN v.t WHEN size(v.p) <= 16 THEN {_FEW_PIECES} ELSE {_MANY_PIECES} END")


def redacted(text: Column, spans: Column, mode: str) -> Column:
    """text with its resolved spans replaced."""
    def put(s: Column) -> Column:
        return F.when(F.size(s) == 0, text).otherwise(_put_in(text, s, mode))

    return let(spans, put)


def _put_in(text: Column, spans: Column, mode: str) -> Column:
    pieces = F.transform(numbered(spans), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), replacement(x["s"]["type"], x["n"], mode).alias("new")))
    return spliced(text, pieces)


def label_map(active: DataFrame, doc: str = "doc_id", place: Column | None = None) -> DataFrame:
    """doc, type, value (normalised), n, first_text: values numbered by first appearance."""
    return _numbered_values(active, doc, place).drop("__at")


def _numbered_values(active: DataFrame, doc: str, place: Column | None = None) -> DataFrame:
    at = F.col("start") if place is None else place
    firsts = active.groupBy(doc, "type", normalised(F.col("text")).alias("value")).agg(F.min(at).alias("__at"), F.min_by("text", at).alias("first_text"))
    n = F.row_number().over(Window.partitionBy(doc, "type").orderBy("__at", "value"))
    return firsts.select(doc, "type", "value", n.alias("n"), "first_text", "__at")


def label_map_in_ranges(active: DataFrame, doc: str = "doc_id", parts: int | None = None) -> DataFrame:
    """The same where one document may hold more values than a task should: counts are carried from range to range."""
    firsts = active.groupBy(doc, "type", normalised(F.col("text")).alias("value")).agg(F.min("start").alias("__first"), F.min_by("text", "start").alias("first_text"))
    ranged = Ranged(firsts, [doc, "type"], [F.col("__first"), F.col("value")], parts)
    numbered_ = ranged.sum_before(ranged.rows, "__n", F.lit(1))
    return numbered_.select(doc, "type", "value", (F.col("__n") + 1).cast("int").alias("n"), "first_text")


def reid_key(active: DataFrame, mode: str = "label", doc: str = "doc_id", place: Column | None = None) -> DataFrame:
    """doc, position (from 1, in order of first appearance), type, original, replacement, first_text of every value; empty
    where nothing can be undone."""
    key = _numbered_values(active, doc, place)
    position = F.row_number().over(Window.partitionBy(doc).orderBy("__at", "type", "value"))
    new = replacement(F.col("type"), F.col("n"), mode).alias("replacement")
    return key.where(F.lit(mode != "redact")).select(doc, position.alias("position"), "type", F.col("value").alias("original"), new, "first_text")


def key_csv(key: DataFrame) -> list[Column]:
    """The key's columns as they are written: cells that could run as formulas neutralised."""
    return [neutralised(F.col(c)).alias(c) for c in ("type", "original", "replacement")]


def apply_spans(texts: DataFrame, active: DataFrame, mode: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """texts with the active spans of a table replaced; texts without any stay."""
    key = label_map(active, doc).drop("first_text")
    named = active.withColumn("value", normalised(F.col("text"))).join(key, [doc, "type", "value"])
    pieces = named.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", replacement(F.col("type"), F.col("n"), mode).alias("new")))).alias("__p"))
    return texts.join(pieces, doc, "left").withColumn(text, F.when(F.col("__p").isNull(), F.col(text)).otherwise(spliced(F.col(text), F.col("__p")))).drop("__p")


def reidentify(texts: DataFrame, key: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverse of label mode: labels found in the texts become the originals of the key."""
    from maskwright.operators.rules import located, span_rows

    labels = span_rows(texts.where(F.contains(F.col(text), F.lit("["))), located(F.col(text), r"\[[A-Z_]+_\d+\]"), doc)
    found = labels.join(key.select(doc, F.col("replacement").alias("t"), F.col("first_text").alias("new")), [doc, "t"])
    pieces = found.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.length("t")).alias("end"), "new"))).alias("__p"))
    return texts.join(pieces, doc, "left").withColumn(text, F.when(F.col("__p").isNull(), F.col(text)).otherwise(spliced(F.col(text), F.col("__p")))).drop("__p")


def pools(spark: SparkSession) -> DataFrame:
    """The stand-ins as a table: type, n, value."""
    return spark.createDataFrame([(t, i + 1, v) for t, values in POOLS.items() for i, v in enumerate(values)], "type string, n int, value string")
