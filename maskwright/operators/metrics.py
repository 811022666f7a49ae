"""Reports on findings, and quality against annotated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import blocks, bound, cut, let_sql, normalised

#: A candidate model is rejected if it loses more F1 than this.
MOST_F1_LOSS = 0.005


def findings_by_value(spans: DataFrame) -> DataFrame:
    """type, value, n, n_off, first_text of spans with `active`, over all documents."""
    by = F.struct("doc_id", "start")
    return spans.groupBy("type", normalised(F.col("text")).alias("value")).agg(F.count("*").alias("n"), F.count_if(~F.col("active")).alias("n_off"), F.min_by("text", by).alias("first_text"))


def findings_rollup(spans: DataFrame) -> DataFrame:
    """Counts of each value, of each type (value null) and of all (both null), with the switch state."""
    r = spans.select("type", normalised(F.col("text")).alias("value"), "active").rollup("type", "value").agg(F.count("*").alias("n"), F.count_if("active").alias("n_on"))
    return r.withColumn("state", F.when(F.col("n_on") == F.col("n"), "all").when(F.col("n_on") == 0, "none").otherwise("some"))


def top_values(found: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent values of each type; of equal ones the smaller value."""
    w = Window.partitionBy("type").orderBy(F.desc("n"), "value")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def doc_summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.count_if("active").alias("redacted"), F.count_if(~F.col("active")).alias("kept"))


def eval_spans(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of exact (doc, start, end, type), for each type and all (null)."""
    key = ["doc_id", "start", "end", "type"]
    both = gold.select(*key, F.lit(1).alias("g")).distinct().join(predicted.select(*key, F.lit(1).alias("p")).distinct(), key, "full_outer")
    n = both.rollup("type").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_predicted"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("n_right"), F.grouping("type").alias("__all"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    n = n.withColumns({"precision": ratio("n_right", "n_predicted"), "recall": ratio("n_right", "n_gold")})
    f1 = F.when(F.col("n_right") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return n.withColumn("f1", f1).drop("__all")


#: The sweep over the starts and ends v.e of a text's spans, in order: how many characters but white space gold (g), predicted (p)
#: and both cover. What lies between two events is cut from the text v.t, or from its blocks v.b where there are many.
_SWEEP = "aggregate(sort_array(v.e), named_struct('at', 0, 'g', 0, 'p', 0, 'n_gold', 0L, 'n_covered', 0L, 'n_predicted', 0L), (a, e) -> {body})".format(
    body=bound(
        "n", f"IF(e.at > a.at AND (a.g > 0 OR a.p > 0), length(regexp_replace(IF(v.b IS NULL, substr(v.t, a.at + 1, e.at - a.at), {cut('a.at', 'e.at', 'v.b')}), r'\\s+', '')), 0)",
        """named_struct('at', e.at, 'g', a.g + e.g, 'p', a.p + e.p, 'n_gold', a.n_gold + IF(a.g > 0, n, 0),
           'n_covered', a.n_covered + IF(a.g > 0 AND a.p > 0, n, 0), 'n_predicted', a.n_predicted + IF(a.p > 0, n, 0))""",
    )
)


def _events(spans: str, g: int, p: int) -> str:
    """SQL for the starts and ends of an array of spans."""
    made = lambda at, sign: f"named_struct('at', s.{at}, 'g', {sign * g}, 'p', {sign * p})"
    return f"flatten(transform(coalesce({spans}, array()), s -> array({made('start', 1)}, {made('`end`', -1)})))"


def eval_chars(texts: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, n_gold, n_covered, n_predicted: characters other than white space, of documents with any in a span.

    A document's spans are put beside its text, and one sweep over their starts and ends counts what lies between them, so no
    row stands for a character and text that no span covers is not looked at."""

    def beside(spans: DataFrame, name: str) -> DataFrame:
        place = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
        return spans.where("start < end").groupBy("doc_id").agg(F.collect_set(place).alias(name))

    both = beside(gold, "__g").join(beside(predicted, "__p"), "doc_id", "full_outer")
    met = texts.select("doc_id", "text").join(both, "doc_id")
    swept = met.withColumn("__e", F.concat(F.expr(_events("__g", 1, 0)), F.expr(_events("__p", 0, 1))))
    many = F.when(F.size("__e") > 32, F.expr(blocks("text")))
    done = swept.select("doc_id", let_sql(F.struct(F.col("text").alias("t"), many.alias("b"), F.col("__e").alias("e")), _SWEEP).alias("n"))
    return done.select("doc_id", "n.n_gold", "n.n_covered", "n.n_predicted").where("n_gold + n_predicted > 0")


#: Whether spans v.s, in order, leave nothing of the name x (from its first place v.at on) but spaces and dots.
_LEFT_OVER = r"""aggregate(v.s, named_struct('at', v.at, 'ok', true), (a, s) -> named_struct(
  'at', greatest(a.at, s.`end`),
  'ok', a.ok AND (s.start <= a.at OR substr(v.name, a.at - v.at + 1, least(s.start - a.at, length(v.name))) RLIKE r'^[ .]*\z')),
  a -> a.ok AND (a.at >= v.at + length(v.name) OR substr(v.name, a.at - v.at + 1) RLIKE r'^[ .]*\z'))"""


def name_coverage(cases: DataFrame, spans: DataFrame, min_score: float = 0.5) -> DataFrame:
    """case_id, name, covered: whether persons found cover every character of the name, where it first stands, but spaces
    and dots; a name that the text lacks is not covered, one without other characters is left out. cases: case_id, text, names;
    spans: case_id, start, end, type, score. A case's spans are put beside its text."""
    people = spans.where((F.col("type") == "PERSON") & (F.col("score") >= min_score) & (F.col("start") < F.col("end")))
    beside = people.groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    met = cases.select("case_id", "text", F.filter(F.array_distinct("names"), lambda n: n.rlike("[^ .]")).alias("names")).join(beside, "case_id", "left")
    each = F.expr("transform(names, n -> named_struct('name', n, 'at', instr(text, n) - 1))")
    named = met.select("case_id", F.coalesce("s", F.expr("array()")).alias("s"), F.inline(each))
    # Spans before and after the name tell nothing about it.
    near = F.expr("filter(s, x -> x.start < at + length(name) AND x.`end` > at)")
    covered = (F.col("at") >= 0) & let_sql(F.struct("name", "at", near.alias("s")), _LEFT_OVER)
    return named.select("case_id", "name", covered.alias("covered")).groupBy("case_id", "name").agg(F.min("covered").alias("covered"))


def passes_gate(base: DataFrame, candidate: DataFrame, most_loss: float = MOST_F1_LOSS) -> DataFrame:
    """Two results of eval_spans compared: type, base_f1, f1, accepted."""
    b = base.select(F.coalesce("type", F.lit("*")).alias("type"), F.col("f1").alias("base_f1"))
    c = candidate.select(F.coalesce("type", F.lit("*")).alias("type"), "f1")
    return b.join(c, "type", "left").withColumn("accepted", F.col("base_f1") - F.coalesce("f1", F.lit(0.0)) <= most_loss)
