"""Tables: header semantics, cells, distinct-value scans, replacement across sheets.

Cells are rows (doc_id, sheet, row, col, value). Rules and models run on distinct (sheet, column,
context, value) only; findings are joined back to every cell that holds the value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from maskwright.config import HEADER, RedactionConfig
from maskwright.functions.text import column_label, dialect, normalised, trimmed
from maskwright.operators.replace import label_map, replacement, spliced
from maskwright.operators.runs import put_in_runs
from maskwright.storage import write_table

# What a header says about its column; the first that matches wins.
COLUMN_RULES = (
    (r"e-?mail", "EMAIL"),
    (r"\b(credit|debit)[\s-]*card\b", "CREDIT_CARD"),
    (r"\biban\b", "IBAN"),
    (r"\b(api[\s-]*key|password|passcode|routing[\s-]*number|bank[\s-]*account|account[\s-]*id)\b", "ID_NUMBER"),
    (r"\b(user ?name|login|handle)\b", "ID_NUMBER"),
    (r"\b(company|business|organi[sz]ation|employer|product|file|domain|brand)[\s_-]*name\b", "ORG"),
    (r"^\s*(company|organi[sz]ation|employer|business|firm|vendor|supplier)\s*$", "ORG"),
    (r"^\s*(company[\s_-]*)?(website|web[\s_-]*site|homepage|domain)\s*$", "ORG"),
    (r"\b(first|last|middle|given|family|full|maiden|nick)[\s_-]*name\b|\b(sur|fore)name\b|^\s*name\s*$", "PERSON"),
    (r"\b(contact|patient|customer|client|employee|member|owner|person|guardian|spouse)[\s_-]*name\b", "PERSON"),
    (r"\b(phone|mobile|cell|fax|tel|telephone)\b", "PHONE"),
    (r"\b(dob|date[\s_-]*of[\s_-]*birth|birth[\s_-]*date|birthday)\b", "DATE"),
    (r"\b(ssn|social[\s_-]*security)\b", "SSN"),
    (r"\b(zip|postal[\s_-]*code|post[\s_-]*code|postcode)\b", "ZIP"),
    (r"\b(street|address|addr)\b", "ADDRESS"),
    (r"^\s*(city|town|county|location|home ?town)\s*$", "LOCATION"),
    (r"\b(mrn|medical[\s_-]*record|patient[\s_-]*id|member[\s_-]*id|account[\s_-]*(no|number|#)|passport|licen[cs]e[\s_-]*(no|number)|national[\s_-]*id|tax[\s_-]*id|employee[\s_-]*id)\b", "ID_NUMBER"),
    (r"\b(linked\s*in|twitter|facebook|instagram)\b", "URL"),
)
NUMERIC = r"^[\s$€£¥(+-]*\d[\d.,/:\s-]*%?\)?\s*\z"
# End of fixed values.

HEADER_SCORE = 0.99
AT = ["doc_id", "sheet", "row", "col"]


def classify_column(header: Column) -> Column:
    """The entity type that a header names, or null."""
    h = F.regexp_replace(header, r"^\x{feff}", "")
    h = trimmed(F.replace(F.regexp_replace(h, r"([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))
    out = F.lit(None).cast("string")
    for pattern, type_ in reversed(COLUMN_RULES):
        out = F.when(h.rlike(dialect(pattern, flags="i").replace("$", r"\z")), type_).otherwise(out)
    return F.when(h != "", out)


def unpivot(df: DataFrame, columns: Sequence[str], doc: Column, sheet: Column, row: Column) -> DataFrame:
    """A wide table as cells; row 0 is its header (see header_cells), so data rows count from 1."""
    values = F.posexplode(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))).alias("col", "value")
    return df.select(doc.alias("doc_id"), sheet.alias("sheet"), row.alias("row"), values)


def header_cells(docs: DataFrame, names: Sequence[str], sheet: int = 0) -> DataFrame:
    """Row 0 of every document: the column names."""
    return docs.select("doc_id").distinct().select("doc_id", F.lit(sheet).alias("sheet"), F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, names))).alias("col", "value"))


def detect_header(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, has_header: whether row 0 names the columns. True if one of its values names a type;
    else it needs two filled values, all different, short, starting with a letter, without "@" or three digits
    in a row, and one without digits above a number in rows 1 to 20."""
    top = F.max(F.when(F.col("row") == 0, trimmed(F.col("value")))).alias("h")
    number = F.max(F.when((F.col("row") > 0) & F.col("value").rlike(dialect(NUMERIC)), 1).otherwise(0)).alias("num")
    m = cells.where("row between 0 and 20").groupBy("doc_id", "sheet", "col").agg(top, number).where("h is not null")
    filled = F.col("h") != ""
    odd = filled & ~((F.length("h") <= 40) & F.col("h").rlike(r"^\p{L}") & ~F.contains("h", F.lit("@")) & ~F.col("h").rlike(r"\d{3}"))
    g = m.groupBy("doc_id", "sheet").agg(
        F.max(classify_column(F.col("h")).isNotNull()).alias("named"),
        F.count_if(filled).alias("n"),
        F.countDistinct(F.when(filled, F.lower("h"))).alias("d"),
        F.count_if(odd).alias("odd"),
        F.max(filled & ~F.col("h").rlike(r"\d") & (F.col("num") == 1)).alias("over_number"),
    )
    return g.select("doc_id", "sheet", (F.col("named") | ((F.col("n") >= 2) & (F.col("d") == F.col("n")) & (F.col("odd") == 0) & F.col("over_number"))).alias("has_header"))


def with_context(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """cells with `context`: the header of body cells, the column letter of row 0 and of tables without one."""
    names = cells.where("row = 0").select("doc_id", "sheet", "col", trimmed(F.col("value")).alias("__h"))
    named = cells.join(headers, ["doc_id", "sheet"], "left").join(names, ["doc_id", "sheet", "col"], "left")
    own = F.coalesce("has_header", F.lit(False)) & (F.col("row") > 0) & (F.coalesce("__h", F.lit("")) != "")
    return named.withColumn("context", F.when(own, F.col("__h")).otherwise(column_label(F.col("col")))).drop("__h", "has_header")


def column_types(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, sheet, col, type of the columns whose header names one."""
    top = cells.where("row = 0").join(headers.where("has_header"), ["doc_id", "sheet"])
    return top.select("doc_id", "sheet", "col", classify_column(F.col("value")).alias("type")).where("type is not null")


def structural_spans(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Every non-blank body cell of a typed column as a span of that type."""
    v = trimmed(F.col("value"))
    met = cells.where((F.col("row") > 0) & (v != "")).join(types, ["doc_id", "sheet", "col"])
    lead = F.instr("value", v) - 1
    return met.select(*AT, lead.cast("int").alias("start"), (lead + F.length(v)).cast("int").alias("end"), "type", v.alias("text"), F.lit("rule").alias("source"), F.lit(HEADER_SCORE).alias("score"), F.lit(HEADER << 40).cast("bigint").alias("ord"))


def cell_spans(cells: DataFrame, config: RedactionConfig) -> DataFrame:
    """Rule and list spans of every cell, found once for each distinct (context, value). The text
    scanned is "context: value | ", and spans are clipped to the value."""
    from maskwright.api import candidate_spans

    distinct = cells.select("context", "value").where("value <> ''").distinct()
    shown = F.concat("context", F.lit(": "), "value", F.lit(" | "))
    found = distinct.select("context", "value", F.inline(candidate_spans(shown, config)))
    return cells.join(clip(found), ["context", "value"]).select(*AT, "start", "end", "type", "text", "source", "score", "ord")


def clip(found: DataFrame) -> DataFrame:
    """Spans in "context: value | " as spans of the value; the context itself is never replaced."""
    lead = F.length("context") + 2
    s, e = F.greatest(F.col("start") - lead, F.lit(0)), F.least(F.col("end") - lead, F.length("value"))
    cut = found.withColumns({"__s": s, "__e": e}).where("__s < __e")
    text = F.col("value").substr(F.col("__s") + 1, F.col("__e") - F.col("__s"))
    return cut.select(*(c for c in found.columns if c not in ("start", "end", "text")), F.col("__s").cast("int").alias("start"), F.col("__e").cast("int").alias("end"), text.alias("text")).where(trimmed(F.col("text")) != "")


def covered_cells(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells of which one rule span of score 0.99 or more covers all but the white space at the ends."""
    v = trimmed(F.col("value"))
    lead = F.instr("value", v) - 1
    sure = spans.where("source = 'rule' and score >= 0.99").select(*AT, "start", "end")
    return cells.where(v != "").join(sure, AT).where((F.col("start") <= lead) & (F.col("end") >= lead + F.length(v))).select(AT).distinct()


def scan_plan(cells: DataFrame, covered: DataFrame) -> DataFrame:
    """The distinct samples a model has to read: doc_id, sheet, col, context, value, targets."""
    from maskwright.functions.text import needs_model

    left = cells.where(needs_model(F.col("value"))).join(covered, AT, "left_anti")
    return left.groupBy("doc_id", "sheet", "col", "context", "value").agg(F.count("*").alias("targets"))


def scan_stats(cells: DataFrame, covered: DataFrame, plan: DataFrame) -> DataFrame:
    """cells, unique_values, reused_cells, rule_covered_cells of each document."""
    some = cells.where(trimmed(F.col("value")) != "").groupBy("doc_id").agg(F.count("*").alias("cells"))
    p = plan.groupBy("doc_id").agg(F.count("*").alias("unique_values"), (F.sum("targets") - F.count("*")).alias("reused_cells"))
    c = covered.groupBy("doc_id").agg(F.count("*").alias("rule_covered_cells"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return some.join(p, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", "cells", zero("unique_values"), zero("reused_cells"), zero("rule_covered_cells"))


def observed_scan_plan(cells: DataFrame, covered: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """scan_plan as a written table, and the sums of scan_stats over all documents, observed while it is written: no second
    pass over the cells."""
    from maskwright.functions.text import needs_model

    seen = Observation("scan")
    flagged = cells.join(covered.select(*AT, F.lit(True).alias("__covered")).distinct(), AT, "left").withColumn("__covered", F.coalesce("__covered", F.lit(False)))
    samples = flagged.groupBy("doc_id", "sheet", "col", "context", "value").agg(
        F.count_if(trimmed(F.col("value")) != "").alias("__cells"), F.count_if("__covered").alias("__rules"), F.count_if(~F.col("__covered") & needs_model(F.col("value"))).alias("targets")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = samples.observe(
        seen, zero(F.sum("__cells")).alias("cells"), F.count_if(F.col("targets") > 0).alias("unique_values"),
        zero(F.sum(F.greatest(F.col("targets") - 1, F.lit(0)))).alias("reused_cells"), zero(F.sum("__rules")).alias("rule_covered_cells"),
    )
    plan = write_table(counted.where("targets > 0").drop("__cells", "__rules"), "scan-plan")
    return plan, dict(seen.get)


def project_findings(cells: DataFrame, findings: DataFrame) -> DataFrame:
    """A model's findings on samples (doc_id, sheet, col, context, value, start, end, type, score; offsets in
    the value) at every cell that holds the value, clipped to it; blank slices are dropped."""
    f = findings.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", F.length("value"))}).where("start < end")
    f = f.withColumn("text", F.col("value").substr(F.col("start") + 1, F.col("end") - F.col("start"))).where(trimmed(F.col("text")) != "")
    return cells.join(f, ["doc_id", "sheet", "col", "context", "value"]).select(*AT, "start", "end", "type", "text", "score")


def resolve_cells(spans: DataFrame, config: RedactionConfig) -> DataFrame:
    """Settings and overlaps, cell by cell, in the row."""
    from maskwright.operators.spans import filter_spans, resolve

    fields = ["start", "end", "type", "text", "source", "score", "ord"]
    kept = filter_spans(spans, config).groupBy(*AT).agg(F.collect_list(F.struct(*fields)).alias("s"))
    return kept.select(*AT, F.inline(resolve(F.col("s"))))


def redact_cells(cells: DataFrame, active: DataFrame, mode: str = "label") -> DataFrame:
    """cells with their spans replaced; one numbering for all sheets of a document."""
    place = F.struct("sheet", "row", "col", "start")
    key = label_map(active, "doc_id", place).drop("first_text").withColumnRenamed("value", "__v")
    named = active.withColumn("__v", normalised(F.col("text"))).join(key, ["doc_id", "type", "__v"])
    pieces = named.groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("start", "end", replacement(F.col("type"), F.col("n"), mode).alias("new")))).alias("__p"))
    return cells.join(pieces, AT, "left").withColumn("value", F.when(F.col("__p").isNull(), F.col("value")).otherwise(spliced(F.col("value"), F.col("__p")))).drop("__p")


def pivot_back(cells: DataFrame, columns: Sequence[str], header_rows: int = 1) -> DataFrame:
    """Body cells as a wide table again."""
    body = cells.where(F.col("row") >= header_rows)
    wide = body.groupBy("doc_id", "sheet", "row").pivot("col", list(range(len(columns)))).agg(F.first("value"))
    return wide.select("doc_id", "sheet", "row", *(F.col(str(i)).alias(c) for i, c in enumerate(columns)))


def apply_to_runs(runs: DataFrame, active: DataFrame) -> DataFrame:
    """Formatted runs (doc_id, run_no, start, end, text) with spans (doc_id, start, end, new) put in: the new
    text goes where a span starts, and what it covers of later runs is removed."""
    done = put_in_runs(runs, active.select("doc_id", "start", "end", "new"))
    return done.select("doc_id", "run_no", *(c for c in runs.columns if c not in ("doc_id", "run_no")))
