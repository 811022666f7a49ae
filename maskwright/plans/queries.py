"""Queries over the given tables: (spark, sf_dir) to DataFrame, one for each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import api
from maskwright.config import MODEL, TYPES, RedactionConfig
from maskwright.functions import text as fx
from maskwright.operators import layout, metrics, model, propagate, replace, review, rules, spans, table_functions, tables
from maskwright.operators.intervals import Ranged
from maskwright.sources import delimited, readers, writers
from maskwright.storage import shared_folder, write_table
from maskwright.streaming import detect as streams

ALL = RedactionConfig(enabled=frozenset(TYPES))
TERMS = ("that", "nicht", "mente", "Que")
AT = tables.AT


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where a table has fewer splits than that, as one small file has; larger
    tables are left as they are read. This changes the plan, never the result."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def rare_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with what the documents hardly have: a record for each customer."""
    return spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey + 10000000 AS doc_id",
        """concat('Customer ', c_name, ', SSN ', lpad(c_custkey % 900, 3, '0'), '-', lpad(c_custkey % 97, 2, '0'), '-', lpad(c_custkey * 7 % 9999, 4, '0'),
        ', born March ', c_custkey % 28 + 1, ', 19', c_custkey % 90 + 10, ' or ', c_custkey % 12 + 1, '/', c_custkey % 28 + 1, '/2001. Lives at ', c_custkey % 9000 + 1, ' Oak Street, CA ', lpad(c_custkey * 13 % 99999, 5, '0'),
        '. Account Number: A', lpad(c_custkey, 6, '0'), ', 2001:db8:0:0:0:0:0:', c_custkey % 9999, '; IBAN ',
        CASE c_custkey % 3 WHEN 0 THEN 'GB82 WEST 1234 5698 7654 32' WHEN 1 THEN 'DE89 3704 0044 0532 0130 00' ELSE 'GB00 WEST 1234 5698 7654 32' END,
        '. Write to c', c_custkey, '@mail.example.org or www.example.org/c/', c_custkey, ', P.O. Box ', c_custkey % 500, '; (555) ', lpad(c_custkey % 1000, 3, '0'), '-0199.') AS text""",
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).unionByName(rare_texts(spark, sf))


def rule_rows(df: DataFrame, *types: str) -> DataFrame:
    return rules.span_rows(df, rules.detect_rules(F.col("text"), types or TYPES), "doc_id")


def _rule_query(*types: str):
    return lambda spark, sf: rule_rows(texts(spark, sf), *types)


def rule_url(spark, sf):
    pages = spread(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    return rule_rows(pages, "URL")


def rule_ipv6(spark, sf):
    return rule_rows(texts(spark, sf), "IP_ADDRESS").where(F.contains("text", F.lit(":")))


CUSTOM_RULES = (
    ("ID_NUMBER", r"\bAccount Number: ([A-Z]\d+)", 0.8, 1, "", None),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 0.95, 0, "", "luhn"),
    ("CUSTOM", r"\bcustomer#\d+\b", 0.7, 0, "i", None),
)


def _custom_rules(spark) -> DataFrame:
    return spark.createDataFrame(CUSTOM_RULES, "type string, pattern string, score double, group int, flags string, valid string")


def custom_rules(spark, sf):
    """Rules that are rows of a table, as Column expressions."""
    return api.rules_spans(texts(spark, sf), table_functions.rules_of(_custom_rules(spark))).select("doc_id", "start", "end", "type", "text", "score")


def custom_rules_sql(spark, sf):
    """The same rules by the table function, from SQL."""
    table_functions.register(spark)
    beside = texts(spark, sf).crossJoin(F.broadcast(table_functions.one_row(_custom_rules(spark))))  # one row of rules
    return spark.sql("SELECT * FROM find_by_rules(TABLE({texts}))", texts=beside)


def candidates(spark, sf):
    return rules.span_rows(texts(spark, sf), api.candidate_spans(F.col("text"), RedactionConfig(deny=TERMS)), "doc_id")


def deny_list(spark, sf):
    return rules.span_rows(texts(spark, sf), rules.deny_spans(F.col("text"), TERMS), "doc_id")


def occurrences(spark, sf):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return propagate.occurrences(table(spark, sf, "documents").select("doc_id", "text"), terms)


CONFIG = RedactionConfig(min_score=0.9, allow=("10.0.0.1", " GB82 WEST 1234 5698 7654 32 "))


def filter_spans(spark, sf):
    return spans.filter_spans(rule_rows(texts(spark, sf)), CONFIG)


def resolved(spark, sf) -> DataFrame:
    return api.detect(texts(spark, sf), ALL)


def found_once(spark, sf) -> DataFrame:
    """The resolved spans as a written table, for queries that read them several times: texts are scanned once."""
    return write_table(resolved(spark, sf), "found")


def finalize(spark, sf):
    """Two settings over one written table of candidates, which are not searched for again."""
    stored = write_table(rule_rows(texts(spark, sf)), "candidates")
    one, two = (spans.finalize(stored, c).withColumn("setting", F.lit(n)) for n, c in (("all", ALL), ("strict", CONFIG)))
    return one.unionByName(two)


def resolve_overlaps(spark, sf):
    """From a table of candidates, by islands."""
    return spans.resolve_overlaps(rule_rows(texts(spark, sf)))


def _one_document(spark, sf) -> DataFrame:
    """Candidates of all texts, as if these were one document, text after text in order of their ids."""
    t = texts(spark, sf).withColumn("all", F.lit(0))
    ranged = Ranged(t.select("all", "doc_id", F.length("text").cast("long").alias("n")), ["all"], [F.col("doc_id")], 20)
    offsets = ranged.sum_before(ranged.rows, "offset", F.col("n")).select("doc_id", "offset")
    moved = rule_rows(t).join(offsets, "doc_id").withColumns({"start": F.col("offset") + F.col("start"), "end": F.col("offset") + F.col("end")})
    return moved.select(F.lit(0).alias("doc_id"), "start", "end", "type", "text", "source", "score", (F.col("offset") + F.col("ord")).alias("ord"))


def resolve_one_document(spark, sf):
    """Overlaps of one document that spans twenty partitions."""
    return spans.resolve_overlaps_in_ranges(_one_document(spark, sf), parts=20).drop("ord")


def label_one_document(spark, sf):
    """Its values numbered, over twenty partitions too."""
    return replace.label_map_in_ranges(_one_document(spark, sf), parts=20)


def redact_label(spark, sf):
    return api.redact(texts(spark, sf), config=ALL)


def redact_mask(spark, sf):
    return api.redact(texts(spark, sf), config=RedactionConfig(enabled=ALL.enabled, mode="redact"))


def redact_fake(spark, sf):
    return api.redact(texts(spark, sf), config=RedactionConfig(enabled=ALL.enabled, mode="pseudonymize"))


def redact_conversations(spark, sf):
    """A conversation is a document: its values are numbered over all its turns."""
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    found = rules.span_rows(turns, api.active_spans(F.col("text"), ALL), "conv_id", "turn")
    key = replace.label_map(found, "conv_id", F.struct("turn", "start")).drop("first_text")
    named = found.withColumn("value", fx.normalised(F.col("text"))).join(key, ["conv_id", "type", "value"])
    pieces = named.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "end", replace.replacement(F.col("type"), F.col("n"), "label").alias("new")))).alias("p"))
    return turns.join(pieces, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("p").isNull(), F.col("text")).otherwise(replace.spliced(F.col("text"), F.col("p"))).alias("text"))


def value_keys(spark, sf):
    return resolved(spark, sf).select("doc_id", "start", review.occurrence_key().alias("occurrence_key"), fx.value_key(F.col("type"), F.col("text")).alias("value_key"))


def label_map(spark, sf):
    return replace.label_map(resolved(spark, sf))


def reid_key(spark, sf):
    return replace.reid_key(resolved(spark, sf))


def reidentify(spark, sf):
    """Redacted, and back: each value in the writing of its first occurrence."""
    t, active = texts(spark, sf), found_once(spark, sf)
    return replace.reidentify(replace.apply_spans(t, active, "label"), replace.reid_key(active))


def neutralise_cells(spark, sf):
    o = table(spark, sf, "orders")
    v = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "=").when(F.col("o_orderkey") % 4 == 1, " @").when(F.col("o_orderkey") % 4 == 2, "-").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", fx.neutralised(v).alias("cell"))


def _log(found: DataFrame) -> DataFrame:
    """Decisions that follow from the spans themselves."""
    key = fx.value_key(F.col("type"), F.col("text"))
    value = found.where(F.length("text") % 3 == 0).select("doc_id", F.lit(10).alias("seq"), F.lit("value").alias("kind"), key.alias("key"), F.lit(True).alias("value")).distinct()
    back = found.where(F.length("text") % 2 == 0).select("doc_id", F.lit(15).alias("seq"), F.lit("value").alias("kind"), key.alias("key"), F.lit(False).alias("value")).distinct()
    early = found.where(F.col("start") % 3 == 0).select("doc_id", F.lit(5).alias("seq"), F.lit("occurrence").alias("kind"), review.occurrence_key().alias("key"), F.lit(True).alias("value"))
    late = found.where(F.col("start") % 2 == 0).select("doc_id", F.lit(20).alias("seq"), F.lit("occurrence").alias("kind"), review.occurrence_key().alias("key"), F.lit(True).alias("value"))
    return value.unionByName(back).unionByName(early).unionByName(late)


def active(spark, sf) -> DataFrame:
    found = found_once(spark, sf)
    return review.active_spans(found, _log(found))


def decisions_asof(spark, sf):
    return review.as_of(_log(found_once(spark, sf)), 12)


def value_decisions(spark, sf):
    return review.value_states(_log(found_once(spark, sf)))


def decisions_in_force(spark, sf):
    """A log of a decision for each finding, with undo and redo between."""
    found = found_once(spark, sf)
    kind = F.when(F.col("start") % 4 == 0, "undo").when(F.col("start") % 7 == 0, "redo").otherwise("value")
    return review.in_force(found.select("doc_id", F.col("start").alias("seq"), kind.alias("kind"), fx.value_key(F.col("type"), F.col("text")).alias("key"), (F.length("text") % 2 == 0).alias("value")))


def manual_terms(spark, sf):
    """Capitalised words picked by hand: those at places that five divides."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    picked = rules.span_rows(docs, rules.located(F.col("text"), r"[A-Z][a-z]{5,}"), "doc_id").where("start % 5 = 0")
    return review.manual_terms(docs, picked.select("doc_id", "start", (F.col("start") + F.length("t")).alias("end"), F.col("t").alias("text")))


def anti_overlap(spark, sf):
    found = write_table(rule_rows(texts(spark, sf)), "candidates")
    return spans.without_overlap(found.where("type <> 'PHONE'"), found.where("type = 'PHONE'"))


def final_view(spark, sf):
    found = found_once(spark, sf)
    manual = found.where("type = 'ZIP'").withColumns({"source": F.lit("manual"), "type": F.lit("CUSTOM"), "score": F.lit(1.0)})
    return review.final_view(found, manual, _log(found))


def export_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "xlsx").otherwise("text").alias("kind"), F.when(F.col("doc_id") % 5 == 0, "pending").when(F.col("doc_id") % 5 == 1, "failed").otherwise("done").alias("ml_state"))
    return review.export_gate(d, d.where("doc_id % 2 = 0").select("doc_id"))


def findings_by_value(spark, sf):
    return metrics.findings_by_value(active(spark, sf))


def findings_rollup(spark, sf):
    return metrics.findings_rollup(active(spark, sf))


def top_values(spark, sf):
    return metrics.top_values(metrics.findings_by_value(active(spark, sf)).select("type", "value", "n"))


def doc_summary(spark, sf):
    return metrics.doc_summary(active(spark, sf))


def findings_by_label(spark, sf):
    """Findings of labelled documents, by quality and toxicity."""
    found = rule_rows(table(spark, sf, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return table(spark, sf, "labels").join(found, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


def needs_model(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.needs_model(F.col("text")).alias("needs_model"))


def normalise_caps(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.normalise_caps(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("text"))


# Names: an annotator that SQL can follow -----------------------------------------------------


NAME = r"[A-Z][a-z]{3,}(?: [a-z]{2,})?"


def names(spark, sf) -> DataFrame:
    """Capitalised words of four letters or more, with a small word after them, are taken for persons at even
    places; those at odd ones are left to propagation."""
    d = rules.span_rows(spread(table(spark, sf, "documents").select("doc_id", "text")), rules.located(F.col("text"), NAME), "doc_id").where("start % 2 = 0")
    place = [F.col("start").alias("start"), (F.col("start") + F.length("t")).alias("end"), F.lit("PERSON").alias("type"), F.col("t").alias("text")]
    return d.select("doc_id", *place, F.lit("ml").alias("source"), F.lit(0.9).alias("score"), (F.lit(MODEL << 40) + F.col("start")).cast("bigint").alias("ord"))


def name_variants(spark, sf):
    """Of every two words of which the first is capitalised, as names."""
    two = rules.span_rows(spread(table(spark, sf, "documents").select("doc_id", "text")), rules.located(F.col("text"), r"[A-Z][a-z]+ [a-z]+"), "doc_id")
    two = two.select("doc_id", F.lit("PERSON").alias("type"), F.initcap("t").alias("text"), F.lit(0.9).alias("score"), F.col("start").cast("bigint").alias("ord"))
    return propagate.name_variants(two).select("doc_id", "type", "term", "score")


def propagate_names(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return propagate.with_propagation(docs, names(spark, sf)).drop("ord").withColumn("score", F.round("score", 6))


def plausible_spans(spark, sf):
    """Rule hits under the names of other types, as a bad model might give them."""
    found = rule_rows(texts(spark, sf)).withColumn("type", F.when(F.col("start") % 4 == 0, "EMAIL").when(F.col("start") % 4 == 1, "CREDIT_CARD").when(F.col("start") % 4 == 2, "SSN").otherwise("IBAN"))
    return found.where(spans.plausible(F.col("type"), F.col("text"))).select("doc_id", "start", "type", "text")


def merge_spans(spark, sf):
    """Every capitalised or numbered word a piece; pieces next to each other join."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pieces = rules.span_rows(docs, rules.located(F.col("text"), r"[A-Z][a-z]+|[0-9]+"), "doc_id").select("doc_id", "start", (F.col("start") + F.length("t")).alias("end"), F.when(F.col("t").rlike("^[0-9]"), "ID_NUMBER").otherwise("PERSON").alias("type"), F.col("t").alias("text"), F.lit(0.8).alias("score"))
    return spans.merge_spans(pieces, docs)


LABELS = [("B-PER", "PERSON"), ("I-PER", "PERSON"), ("B-LOC", "LOCATION"), ("I-LOC", "LOCATION"), ("B-X", None), ("O", None)]


def type_scores(spark, sf):
    """Logits made of each event's value."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("token"), "value")
    made = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), ((F.floor("value") * (i + 3)) % 11 / 2.0).alias("logit")) for i, (n, _) in enumerate(LABELS)))).alias("l")
    logits = e.select("doc_id", "token", made).select("doc_id", "token", "l.label", "l.logit")
    return model.type_scores(logits, model.label_table(spark, model.NAME_LABELS)).withColumn("score", F.round("score", 6))


def dictionary_spans(spark, sf):
    """A model behind the annotator interface, in Arrow batches, over all documents."""
    def load():
        return model.dictionary_annotator({"The": "PERSON", "Der": "PERSON", "Que": "LOCATION"})

    return model.annotate(table(spark, sf, "documents").select("doc_id", "text"), load)[0].drop("ord")


def chunk_cover(spark, sf):
    """Chunks of every document: how many, their characters, and where the last ends."""
    c = model.chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"), F.max(F.col("offset") + F.length("chunk")).alias("covered"))


def chunk_rows(spark, sf):
    """Every chunk of every document, of 200 tokens at most, so that some shrink."""
    return model.chunks(table(spark, sf, "documents").select("doc_id", "text"), most_tokens=CHUNK_TOKENS)


CHUNK_TOKENS = 200


# Tables ----------------------------------------------------------------------------------------

CUSTOMER = ["Customer Name", "Account Number", "Market Segment", "Balance"]
SUPPLIER = ["Company Name", "supplier_no", "Total"]


def cells(spark, sf) -> DataFrame:
    """A workbook for each nation: a sheet of customers and one of suppliers."""
    c = spread(table(spark, sf, "customer")).select("c_nationkey", "c_custkey", "c_name", F.concat(F.lit("A-"), "c_custkey").alias("acct"), "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("bal"))
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.col("s_suppkey").cast("string").alias("no"), F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("bal"))
    one = tables.unpivot(c, ["c_name", "acct", "c_mktsegment", "bal"], F.col("c_nationkey").cast("bigint"), F.lit(0), (F.col("c_custkey") + 1).cast("int"))
    two = tables.unpivot(s, ["s_name", "no", "bal"], F.col("s_nationkey").cast("bigint"), F.lit(1), (F.col("s_suppkey") + 1).cast("int"))
    return one.unionByName(tables.header_cells(one, CUSTOMER, 0)).unionByName(two).unionByName(tables.header_cells(two, SUPPLIER, 1))


def _context(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Cells with their context and the typed columns, each written once, as the steps after them read both several times."""
    all_ = write_table(cells(spark, sf), "raw-cells")
    headers = write_table(tables.detect_header(all_), "headers")
    c = write_table(tables.with_context(all_, headers), "cells")
    return c, write_table(tables.column_types(c, headers), "column-types")


def classify_columns(spark, sf):
    """Headers as data: every word of the documents with one that headers have, and a header of every kind."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("word"))
    d = words.select(F.concat_ws("_", "word", F.get(F.array(*(F.lit(x) for x in ("name", "Email", "phoneNo", "zip", "user name", "first_name", "dateOfBirth"))), (F.col("doc_id") % 7).cast("int"))).alias("header"))
    fixed = spark.createDataFrame([(x,) for x in (*CUSTOMER, *SUPPLIER, "FirstName", "E-mail", "IBAN", "city", "Home Town", "LinkedIn", "web site", "")], "header string")
    return d.unionByName(fixed).distinct().select("header", tables.classify_column(F.col("header")).alias("type"))


def detect_header(spark, sf):
    return tables.detect_header(cells(spark, sf))


def unpivot_cells(spark, sf):
    return _context(spark, sf)[0]


def column_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fx.column_label(F.col("p_partkey") % 17000).alias("label"))


def structural_spans(spark, sf):
    c, types = _context(spark, sf)
    return tables.structural_spans(c, types)


def _cell_candidates(c: DataFrame, types: DataFrame) -> DataFrame:
    return tables.cell_spans(c, ALL).unionByName(tables.structural_spans(c, types).select(*AT, "start", "end", "type", "text", "source", "score", "ord"))


def covered_cells(spark, sf):
    c, types = _context(spark, sf)
    return tables.covered_cells(c, _cell_candidates(c, types))


def scan_plan(spark, sf):
    c, types = _context(spark, sf)
    return tables.scan_plan(c, tables.covered_cells(c, tables.structural_spans(c, types)))


def scan_stats(spark, sf):
    c, types = _context(spark, sf)
    covered = tables.covered_cells(c, tables.structural_spans(c, types))
    return tables.scan_stats(c, covered, tables.scan_plan(c, covered))


def scan_observed(spark, sf):
    """The same sums over all documents, observed while the plan is written."""
    c, types = _context(spark, sf)
    _, stats = tables.observed_scan_plan(c, tables.covered_cells(c, tables.structural_spans(c, types)))
    return spark.createDataFrame([stats], ", ".join(f"{k} long" for k in stats))


def project_findings(spark, sf):
    """A model that takes the first five characters of each sample for a place."""
    c, types = _context(spark, sf)
    plan = tables.scan_plan(c, tables.covered_cells(c, tables.structural_spans(c, types)))
    findings = plan.select("doc_id", "sheet", "col", "context", "value", F.lit(-2).alias("start"), F.lit(5).alias("end"), F.lit("LOCATION").alias("type"), F.lit(0.8).alias("score"))
    return tables.project_findings(c, findings)


def clip_to_cells(spark, sf):
    c = _context(spark, sf)[0]
    found = c.select("doc_id", "sheet", "row", "col", "context", "value", F.lit(0).alias("start"), (F.length("context") + 6).alias("end"), F.lit("PERSON").alias("type"), F.lit("").alias("text"))
    return tables.clip(found).select(*AT, "start", "end", "type", "text")


def _decided(c: DataFrame) -> DataFrame:
    return c.where("row > 0 and row % 3 = 0 and col < 2").select(*AT, (F.col("row") % 2 == 0).alias("value"))


def cell_decisions(spark, sf):
    c, types = _context(spark, sf)
    return review.cell_decisions(c, tables.structural_spans(c, types), _decided(c), types).select(*AT, "start", "end", "type", "text", "source")


def column_decisions(spark, sf):
    c = cells(spark, sf)
    return review.column_decisions(c, c.where("row = 0 and col <> 1").select("doc_id", "sheet", "col", (F.col("col") == 0).alias("value")))


def redact_table(spark, sf):
    c, types = _context(spark, sf)
    live = write_table(tables.resolve_cells(_cell_candidates(c, types), ALL), "cell-spans")
    return tables.redact_cells(c.select(*AT, "value"), live)


def pivot_back(spark, sf):
    done = redact_table(spark, sf).where("sheet = 0")
    return tables.pivot_back(done, ["name", "account", "segment", "balance"])


def apply_to_runs(spark, sf):
    """Documents cut into runs of seven characters, with their findings put in."""
    t = texts(spark, sf).where("text <> ''")
    runs = t.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("run_no", "text"))  # in one pass: substr counts from the start each time
    runs = runs.select("doc_id", "run_no", (F.col("run_no") * 7).alias("start"), (F.col("run_no") * 7 + F.length("text")).alias("end"), "text")
    found = api.detect(t, ALL).select("doc_id", "start", "end", F.concat(F.lit("["), "type", F.lit("]")).alias("new"))
    return tables.apply_to_runs(runs, found).select("doc_id", "run_no", "text")


# Quality, layout and scalars ---------------------------------------------------------------------


def eval_spans(spark, sf):
    """All rules as truth, the rules without phones as prediction."""
    gold = found_once(spark, sf)
    return metrics.eval_spans(gold, gold.where("type <> 'PHONE' and start % 7 <> 0")).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def eval_chars(spark, sf):
    t = texts(spark, sf)
    gold = found_once(spark, sf)
    return metrics.eval_chars(t, gold, gold.where("start % 3 <> 0").withColumn("end", F.col("end") - 1))


def name_coverage(spark, sf):
    """Every capitalised word of six letters or more a name, and every place of one found, without its first letter at odd places."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text"))
    word = r"[A-Z][a-z]{5,}"
    cases = d.withColumn("names", F.regexp_extract_all("text", F.lit(word), F.lit(0)))
    found = rules.span_rows(d, rules.located(F.col("text"), word), "case_id")
    found = found.select("case_id", (F.col("start") + F.col("start") % 2).alias("start"), (F.col("start") + F.length("t")).alias("end"), F.lit("PERSON").alias("type"), F.lit(0.9).alias("score"))
    return metrics.name_coverage(cases, found)


def passes_gate(spark, sf):
    gold = found_once(spark, sf)
    base = metrics.eval_spans(gold, gold)
    return metrics.passes_gate(base, metrics.eval_spans(gold, gold.where("type <> 'PHONE'"))).withColumns({"base_f1": F.round("base_f1", 9), "f1": F.round("f1", 9)})


def _items(spark, sf) -> DataFrame:
    """Line items laid out on pages, an order a page, four items a line."""
    k = F.col("l_linenumber") - 1
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (k % 4 * 50.0).alias("x"), (700.0 - F.floor(k / 4) * 20.0).alias("y"), F.when(k % 2 == 0, 49.5).otherwise(20.0).alias("w"), F.lit(10.0).alias("h"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"))


def page_lines(spark, sf):
    return layout.lines(_items(spark, sf)).select("doc_id", "page", "line", "x", "text")


def page_text(spark, sf):
    return layout.page_text(_items(spark, sf))


def page_needs_ocr(spark, sf):
    return layout.needs_ocr(_items(spark, sf))


def _name_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Runs of every customer's name on lines of ten characters, and a span over it."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    runs = c.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("c_name") - 1) / 10).cast("int")), lambda i: F.col("c_name").substr(i * 10 + 1, F.lit(10)))).alias("k", "text"))
    runs = runs.select("doc_id", (F.col("k") * 10).alias("start"), F.lit(1).alias("page"), F.lit(100.0).alias("x"), (F.col("k") * 15.0).alias("y"), (F.length("text") * 6.0).alias("w"), F.lit(12.0).alias("h"), "text", F.lit(None).cast("array<double>").alias("weights"))
    return runs, c.select("doc_id", F.lit(2).alias("start"), F.length("c_name").alias("end"))


def rectangles(spark, sf):
    runs, found = _name_runs(spark, sf)
    return layout.rectangles_of_runs(found, runs).withColumns({x: F.round(x, 6) for x in ("x", "y", "w", "h")})


def rectangles_of_characters(spark, sf):
    """The same from a box for each character."""
    runs, found = _name_runs(spark, sf)
    return layout.rectangles(found, layout.char_boxes(runs)).withColumns({x: F.round(x, 6) for x in ("x", "y", "w", "h")})


FRACTIONS = (0.0, 0.25, 0.5, 0.1234567, 0.999999, 0.000001, 0.99999999, 0.75)


def excel_serial_date(spark, sf):
    """Days of both systems and days of the first months, whole, with odd fractions, and with some that round up."""
    o = table(spark, sf, "orders")
    part = F.get(F.array(*map(F.lit, FRACTIONS)), (F.col("o_orderkey") % len(FRACTIONS)).cast("int"))
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1899-12-30"))) + part
    early = (F.col("o_orderkey") % 120).cast("double") + part
    return o.select("o_orderkey", fx.excel_serial_date(serial, F.lit(False)).alias("d1900"), fx.excel_serial_date(serial - 1462, F.lit(True)).alias("d1904"), fx.excel_serial_date(early, F.lit(False)).alias("early"))


def zero_pad(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fx.zero_pad(F.col("o_orderkey"), F.lit("00000000")).alias("padded"), fx.keeps_text(F.concat(F.lit("9007199254"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))).alias("keeps_text"))


def cell_address(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", fx.cell_address(F.concat(fx.column_label(F.col("p_partkey") % 17000), (F.col("p_partkey") + 1).cast("string"))).alias("a"))
    return p.select("p_partkey", "a.row", "a.col")


def scrub_office_xml(spark, sf):
    named = F.concat(F.lit('<w:ins w:author="'), "c_name", F.lit('" w:initials="CN" w15:userId="u1"><w:t>x</w:t></w:ins><dc:creator>'), "c_name")
    c = table(spark, sf, "customer").select("c_custkey", F.concat(named, F.lit("</dc:creator><vt:lpwstr>"), "c_name", F.lit("</vt:lpwstr>")).alias("xml"))
    return c.select("c_custkey", fx.scrub_office_xml(F.col("xml")).alias("xml"))


CODES = ("General", "0.00", "yyyy-mm-dd", '"day" 0', "[Red]0", "h:mm", "0\\d", "i", "@")


def date_formats(spark, sf):
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("o_orderkey") % len(CODES)).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", fx.is_date_format((F.col("o_orderkey") % 60).cast("int"), code).alias("is_date"))


def xml_texts(spark, sf):
    """Escapes of spreadsheets decoded, and what XML does not allow escaped."""
    raw = F.concat(F.lit("<"), "c_name", F.lit('_x0026_"_x00E9_" _x00G0_>'))
    return table(spark, sf, "customer").select("c_custkey", fx.decode_x(raw).alias("decoded"), fx.escape_xml(fx.decode_x(raw)).alias("escaped"))


def score_digits(spark, sf):
    return table(spark, sf, "events").select("event_id", fx.rounded_score(F.col("value") / 64).alias("score"))


def csv_lines(spark, sf):
    return writers.csv_lines(cells(spark, sf), ";")


def csv_round_trip(spark, sf):
    """Every sheet as a file, with a mark, and read again in ranges of a kilobyte, with its dialect found."""
    path = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    writers.write_csv(cells(spark, sf), path, ";", "\r\n", bom=True)
    file = lambda k: F.regexp_extract("doc_id", r"(\d+)-(\d+)\.redacted-data", k)
    got, _ = delimited.read_large_tables(spark, path, range_bytes=1 << 10)
    return got.select(file(1).cast("bigint").alias("doc_id"), file(2).cast("int").alias("sheet"), F.col("row").cast("int").alias("row"), "col", "value")


def redacted_files(spark, sf):
    """Every text redacted into a file of its own, `<base>.redacted.txt`, and the files read again."""
    path = f"{shared_folder(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    writers.write_texts(api.redact(texts(spark, sf), config=ALL).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), path)
    back = readers.read_text_files(spark, path)
    return back.select(F.regexp_extract("name", r"(\d+)\.redacted\.txt$", 1).cast("bigint").alias("doc_id"), "text")


def key_files(spark, sf):
    """The key of every document as a file, read again in ranges of a kilobyte."""
    path = f"{shared_folder(spark).rstrip('/')}/keys-{uuid.uuid4().hex}"
    writers.write_key(replace.reid_key(found_once(spark, sf)), path)
    got, _ = delimited.read_large_tables(spark, path, range_bytes=1 << 10)
    wide = got.groupBy("doc_id", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("value"))).alias(c) for k, c in enumerate(("type", "original", "replacement"))))
    return wide.where("row > 0").select(F.regexp_extract("doc_id", r"(\d+)\.key\.csv$", 1).cast("bigint").alias("doc_id"), F.col("row").cast("int").alias("position"), "type", "original", "replacement")


def clean_table(spark, sf):
    """Redacted cells as a clean workbook; balances that did not change stay numbers."""
    c = cells(spark, sf).select(*AT, "value")
    original = c.select(*AT, "value", F.when(F.col("value").rlike(r"^-?\d+\.\d\d$"), F.col("value").cast("double")).alias("scalar_num"), F.lit(None).cast("boolean").alias("scalar_bool"))
    return writers.clean_table(redact_table(spark, sf), original)


def align_tokens(spark, sf):
    """The words of records, in small letters, put back in place."""
    t = rare_texts(spark, sf)
    found = t.select("doc_id", F.posexplode(model.align_tokens(F.col("text"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("i", "p"))
    return found.select("doc_id", "i", "p.start", "p.end")


def widen_pieces(spark, sf):
    """The inner part of each word of four characters or more, grown to the word."""
    w = rules.span_rows(rare_texts(spark, sf), rules.located(F.col("text"), r"[\p{L}\p{N}]{4,}"), "doc_id", "text")
    grown = model.widen(F.col("text"), F.col("start") + 1, F.col("start") + F.length("t") - 1)
    return w.select("doc_id", F.col("start").alias("place"), grown.alias("w")).select("doc_id", "place", "w.start", "w.end")


def symbols_text(spark, sf):
    """A page for each nation, a paragraph for each market segment's customers, a line each."""
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("c_custkey") % 5).alias("paragraph"), F.col("c_custkey").alias("line"),
        F.posexplode(F.split("c_name", "#")).alias("word", "w"),
    )
    s = c.select("doc_id", "page", "paragraph", "line", "word", F.posexplode(F.split("w", "")).alias("pos", "text")).where("text <> ''")
    return layout.symbols_text(s).select("doc_id", "page", "line", "word", "pos", "part", "idx")


def blacked_out(spark, sf):
    areas = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), *(F.lit(v).alias(c) for c, v in zip("xywh", (1.0, 2.0, 30.0, 4.0), strict=True)))
    return layout.with_areas(rectangles(spark, sf), areas)


def stale_exports(spark, sf):
    """Exports of all findings, after some findings of every third document were switched off."""
    found = found_once(spark, sf)
    exports, today = review.review_fingerprints(found), review.review_fingerprints(found.where("doc_id % 3 <> 0 or start % 2 = 0"))
    fresh, rejected = review.current_exports(exports, today)
    return fresh.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("doc_id", "reason"))


def scan_samples(spark, sf):
    """A model over the distinct values of tables, packed, with its findings placed in the values."""
    c, types = _context(spark, sf)
    plan = tables.scan_plan(c, tables.covered_cells(c, tables.structural_spans(c, types)))

    def load():
        return model.dictionary_annotator({"BUILDING": "ORG", "MACHINERY": "ORG", "Total": "PERSON"})

    return model.annotate_samples(plan.select("doc_id", "sheet", "col", "context", "value"), load)


def model_states(spark, sf):
    """A model that fails on some texts: the others are done, and these say so."""
    def load():
        def run(texts_):
            if any("Que" in t for t in texts_):
                raise ValueError("no such language")
            return [[] for _ in texts_]

        return run

    return model.annotate(table(spark, sf, "documents").select("doc_id", "text"), load)[1].select("doc_id", "ml_state", "ml_error")


def file_kinds(spark, sf):
    """Names with endings of every kind, some in capitals, and what is said of them."""
    endings = F.array(*map(F.lit, ("txt", "MD", "csv", "tsv", "xls", "xlsm", "doc", "pdf", "JSON", "tar.gz")))
    name = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("."), F.get(endings, (F.col("doc_id") % 10).cast("int")))
    return readers.dispatch(table(spark, sf, "documents").select("doc_id", name.alias("path")))


def file_notes(spark, sf):
    """What is said of files by their encoding and mark."""
    encoding = F.get(F.array(*map(F.lit, ("UTF-8", "windows-1252", "UTF-16LE"))), (F.col("doc_id") % 3).cast("int"))
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), encoding.alias("encoding"), (F.col("doc_id") % 2 == 0).alias("bom"))
    return readers.coverage_notes(files).select("path", F.array_join("notes", "; ").alias("notes"))


def sheets_union(spark, sf):
    """Customers and suppliers as sheets of one document each, in the order given."""
    c = cells(spark, sf)
    one, two = (c.where(F.col("sheet") == k).drop("sheet") for k in (0, 1))
    return readers.union_sheets(two, one).select(*AT, "value")


def header_choices(spark, sf):
    """Header rows as detected, but where people chose otherwise."""
    found = tables.detect_header(cells(spark, sf))
    return review.header_flags(found, found.where("doc_id % 3 = 0").select("doc_id", "sheet", (F.col("doc_id") % 2 == 0).alias("has_header")))


def _through(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream gives of all that is there now."""
    path = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


def stream_redacted(spark, sf):
    return _through(streams.redact_stream(_stream(spark, sf, "documents").select("doc_id", "text"), ALL), spark)


def stream_labelled(spark, sf):
    """Conversations, each with its own numbers, kept in state."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, streams.ROCKSDB)
    try:
        return _through(streams.labelled_stream(_stream(spark, sf, "conversations"), ALL), spark)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


QUERIES = {
    "detect_rules": _rule_query(),
    "rule_email": _rule_query("EMAIL"), "rule_card": _rule_query("CREDIT_CARD"), "rule_ip": _rule_query("IP_ADDRESS"), "rule_phone": _rule_query("PHONE"), "rule_url": rule_url,
    "rule_ssn": _rule_query("SSN"), "rule_iban": _rule_query("IBAN"), "rule_date": _rule_query("DATE"), "rule_address": _rule_query("ADDRESS"), "rule_zip": _rule_query("ZIP"), "rule_id": _rule_query("ID_NUMBER"),
    "redact_label": redact_label, "redact_mask": redact_mask, "redact_fake": redact_fake, "active_spans": active,
} | {
    f.__name__: f
    for f in (
        rule_ipv6, candidates, custom_rules, custom_rules_sql, finalize, deny_list, occurrences, filter_spans, resolve_overlaps, resolve_one_document, label_one_document, redact_conversations, value_keys, label_map, reid_key, reidentify, neutralise_cells, decisions_asof, decisions_in_force, value_decisions, manual_terms, anti_overlap,
        final_view, export_gate, findings_by_value, findings_rollup, top_values, doc_summary, findings_by_label, needs_model, normalise_caps, name_variants, propagate_names, plausible_spans, merge_spans, type_scores,
        dictionary_spans, chunk_cover, chunk_rows, classify_columns, detect_header, unpivot_cells, column_label, structural_spans, covered_cells, scan_plan, scan_stats, scan_observed, project_findings, clip_to_cells, cell_decisions, column_decisions,
        redact_table, pivot_back, apply_to_runs, eval_spans, eval_chars, name_coverage, passes_gate, page_lines, page_text, page_needs_ocr, rectangles, rectangles_of_characters, excel_serial_date, zero_pad, cell_address, scrub_office_xml,
        date_formats, xml_texts, score_digits, csv_lines, csv_round_trip, redacted_files, key_files, clean_table, align_tokens, widen_pieces, symbols_text, blacked_out, stale_exports,
        scan_samples, model_states, file_kinds, file_notes, sheets_union, header_choices, stream_redacted, stream_labelled,
    )
}
