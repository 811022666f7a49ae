"""Span sets: filters, overlap resolution, anti-overlap and merging.

Where a text's spans are an array beside it, they are handled in the row (no shuffle). Where spans are
a table, one shuffle by document serves windows; groups are islands of overlapping spans, never whole
documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.config import RedactionConfig
from maskwright.functions.text import WHITE_SPACE, blocks, bound, cut, digits, let_sql, mapped, running, trimmed
from maskwright.operators.intervals import Ranged, overlap_join
from maskwright.storage import write_table

#: Manual before rule before model.
SOURCE_RANK = {"manual": 3, "rule": 2, "ml": 1}


def rank_of(source: Column) -> Column:
    return F.when(source == "manual", 3).when(source == "rule", 2).otherwise(1)


#: The greedy choice within an island `a` of spans.
_RANKED = (
    "transform(a, s -> named_struct('a', CASE s.source WHEN 'manual' THEN -3 WHEN 'rule' THEN -2 ELSE -1 END, 'b', s.start - s.`end`, "
    "'c', -s.score, 'd', s.ord, 'e', s.start, 's', s))"
)
_CHOSEN = (
    f"CASE WHEN size(a) <= 1 THEN a ELSE sort_array(aggregate(sort_array({_RANKED}), slice(a, 1, 0), (kept, r) -> "
    "CASE WHEN exists(kept, k -> k.start < r.s.`end` AND r.s.start < k.`end`) THEN kept ELSE array_append(kept, r.s) END)) END"
)
#: Spans v, in order of start, cut where one starts at or after the greatest end before it.
_BY_ISLANDS = bound("o", "array_sort(transform(v, s -> named_struct('start', s.start, 'end', s.`end`, 'ord', s.ord, 's', s)))", bound(
    "reach", running("transform(o, x -> cast(x.`end` AS bigint))", lambda a, b: f"greatest({a}, {b})", "-1L"), bound(
        "heads", "filter(sequence(0, size(o) - 1), i -> o[i].start >= reach[i])",
        "flatten(transform(heads, (h, n) -> " + bound("a", "transform(slice(o, h + 1, coalesce(get(heads, n + 1), size(o)) - h), x -> x.s)", _CHOSEN) + "))",
    )
))


def resolve(spans: Column) -> Column:
    """The greedy choice among an array of spans: by source, length, score and order; a span stays if
    it overlaps none that stays (touching is no overlap). Sorted by start.

    Spans are cut into islands of overlapping ones first, so that the work is in proportion to spans."""
    return let_sql(spans, f"CASE WHEN size(v) <= 1 THEN v ELSE {_BY_ISLANDS} END")


def resolve_overlaps(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The same over a table: spans are grouped into islands of overlapping ones, and each is resolved alone."""
    before = Window.partitionBy(doc).orderBy("start", "end", "ord").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(doc).orderBy("start", "end", "ord").rowsBetween(Window.unboundedPreceding, 0)
    fields = [c for c in spans.columns if c != doc]
    marked = spans.withColumn("__new", F.when(F.col("start") < F.max("end").over(before), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(so_far))
    return _by_island(marked, doc, fields)


def _by_island(marked: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    islands = marked.groupBy(doc, "__island").agg(F.collect_list(F.struct(*fields)).alias("s"))
    return islands.select(doc, F.inline(resolve(F.col("s"))))


def resolve_overlaps_in_ranges(spans: DataFrame, doc: str = "doc_id", parts: int | None = None) -> DataFrame:
    """The same where one document may hold more spans than a task should: ends and islands are carried from range to
    range, so that no task holds a document."""
    ranged = Ranged(spans, [doc], [F.col("start"), F.col("end"), F.col("ord")], parts)
    reached = ranged.greatest_before(ranged.rows, "__reach", F.col("end"))
    new = write_table(reached.withColumn("__new", F.when(F.col("start") < F.col("__reach"), 0).otherwise(1)), "islands")
    marked = ranged.sum_before(new, "__earlier", F.col("__new")).withColumn("__island", F.col("__earlier") + F.col("__new"))
    return _by_island(marked, doc, [c for c in spans.columns if c != doc])


def keep_span(config: RedactionConfig, s: Column) -> Column:
    """Whether the settings keep a span: manual ones always; others by type, score and allow list."""
    allowed = [t.strip().lower() for t in config.allow if t.strip()]
    by_rule = s["type"].isin(*sorted(config.enabled)) & (s["score"] >= config.min_score)
    if allowed:
        by_rule &= ~F.lower(trimmed(s["text"])).isin(*allowed)
    return (s["source"] == "manual") | by_rule


def filter_spans(spans: DataFrame, config: RedactionConfig, allow: DataFrame | None = None) -> DataFrame:
    """The same over a table; allow (column term) may be a table, joined on the trimmed lower-case text."""
    s = {c: F.col(c) for c in ("type", "score", "source", "text")}
    kept = spans.where(keep_span(config, s))
    if allow is not None:
        terms = allow.select(F.lower(trimmed(F.col("term"))).alias("__term")).where("__term <> ''").distinct()
        kept = kept.withColumn("__t", F.when(F.col("source") != "manual", F.lower(trimmed(F.col("text"))))).join(terms, F.col("__t") == F.col("__term"), "left_anti").drop("__t")
    return kept


def finalize(spans: DataFrame, config: RedactionConfig, doc: str = "doc_id") -> DataFrame:
    """Settings, then overlaps; candidates themselves need not be found again."""
    return resolve_overlaps(filter_spans(spans, config), doc)


def plausible(type_: Column, text: Column) -> Column:
    """A model's hit that cannot be what it says is dropped."""
    n = F.length(digits(text))
    return (
        F.when(type_ == "EMAIL", F.contains(text, F.lit("@")))
        .when(type_ == "PHONE", n >= 6)
        .when(type_ == "CREDIT_CARD", n >= 12)
        .when(type_ == "SSN", n >= 9)
        .when(type_.isin("IBAN", "IP_ADDRESS"), n >= 4)
        .otherwise(True)
    )


def without_overlap(a: DataFrame, b: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans of a that overlap no span of b in their document."""
    place = [doc, "start", "end"]
    other = b.select(doc, F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    hit = overlap_join(a.select(*place).distinct(), other, [doc]).select(*place).distinct()
    return a.join(hit, place, "left_anti")


# What may stand between two pieces of one name, and what is trimmed from its ends.
JOINER = r"^[ \-./:@_]{1,2}\z"
END_MARKS = rf"[{WHITE_SPACE}\-\x{{2013}}\x{{2014}}.,:;/]+"
# End of fixed values.

#: Whether a piece x (start, reach: the end of what stands before it in its run) joins that, by what stands between them in the
#: blocks b of the text.
_JOINS = (
    "CASE WHEN x.reach IS NULL THEN false WHEN x.start <= x.reach THEN true WHEN x.start - x.reach > 2 THEN false ELSE "
    + bound("gap", cut("x.reach", "x.start"), f"gap RLIKE r'{JOINER}' AND (gap <> '. ' OR {cut('greatest(x.reach - 2, 0)', 'x.reach')} RLIKE r'(?:^|[^\\p{{L}}])\\p{{L}}\\z')")
    + " END"
)


def merge_spans(spans: DataFrame, texts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Model pieces joined, in order of start and end: a piece joins the one before it if that has its type
    and reaches it, or only a joiner of one or two characters stands between (". " only after an initial). A
    piece of another type in between parts them; what follows starts anew. Ends lose marks; what is left
    of fewer than two characters goes.

    A document's pieces are put beside its text by one join, and what stands between them is cut there, from blocks of
    the text, so that neither is copied for each piece."""
    order = ["start", "end", "ord" if "ord" in spans.columns else "type"]
    by = Window.partitionBy(doc).orderBy(*order)
    s = spans.drop("text").withColumn("__turn", F.when(F.col("type") == F.lag("type").over(by), 0).otherwise(1))
    s = s.withColumn("__run", F.sum("__turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(doc, "__run").orderBy(*order)
    s = s.withColumn("__reach", F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = F.struct(*(F.col(c) for c in order), F.col("type").alias("t"), "score", F.col("end").alias("e"), F.col("__run").alias("run"), F.col("__reach").alias("reach"))
    beside = s.groupBy(doc).agg(F.array_sort(F.collect_list(pieces)).alias("__o")).join(texts.select(F.col(doc), F.col(text).alias("__text")), doc)
    cut_up = F.expr(blocks("__text"))
    # islands: where a piece does not join, a new one starts
    marked = let_sql(F.struct(F.col("__o").alias("o"), cut_up.alias("b")), bound("b", "v.b", f"transform(v.o, x -> named_struct('x', x, 'joins', {_JOINS}))"))
    parted = "transform(heads, (h, n) -> slice(v, h + 1, coalesce(get(heads, n + 1), size(v)) - h))"
    islands = let_sql(marked, bound("heads", "filter(sequence(0, size(v) - 1), i -> NOT v[i].joins)", parted))
    ends = mapped(islands, "g -> named_struct('a', array_min(transform(g, y -> y.x.start)), 'b', array_max(transform(g, y -> y.x.e)), 'type', g[0].x.t, 'score', array_max(transform(g, y -> y.x.score)))")
    raw = let_sql(F.struct(ends.alias("g"), cut_up.alias("b")), bound("b", "v.b", f"transform(v.g, g -> named_struct('a', g.a, 'type', g.type, 'score', g.score, 'raw', {cut('g.a', 'g.b')}))"))
    out = beside.select(doc, F.inline(raw))
    headless = F.regexp_replace("raw", f"^{END_MARKS}", "")
    cut_off = F.regexp_replace(headless, rf"{END_MARKS}\z", "")
    start = F.col("a") + F.length("raw") - F.length(headless)
    made = out.select(doc, start.cast("int").alias("start"), (start + F.length(cut_off)).cast("int").alias("end"), "type", cut_off.alias("text"), "score")
    return made.where(F.length("text") >= 2)
