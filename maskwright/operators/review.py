"""Review decisions as tables: keys, manual terms, keep or redact, cells, undo, export gate.

Decisions are a log (doc_id, seq, kind, key, value); rows of one seq are one action. Undo and redo are actions of the log
too; `in_force` leaves what they leave, and the state is the latest of that."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.config import DENY
from maskwright.functions.text import value_key
from maskwright.operators.propagate import occurrences
from maskwright.operators.spans import resolve_overlaps, without_overlap


def occurrence_key() -> Column:
    return F.concat_ws(":", F.col("start"), F.col("end"))


def as_of(log: DataFrame, seq: int | None = None, doc: str = "doc_id") -> DataFrame:
    """The latest decision of each (document, kind, key), up to seq."""
    some = log if seq is None else log.where(F.col("seq") <= seq)
    latest = Window.partitionBy(doc, "kind", "key").orderBy(F.desc("seq"))
    return some.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


#: Actions that can be undone, counted back from the last.
UNDO_STEPS = 20


def in_force(log: DataFrame, doc: str = "doc_id", steps: int = UNDO_STEPS) -> DataFrame:
    """The decisions that undo and redo (kind) leave: an undo takes back the last action in force, of the last `steps` at
    most; a redo brings back the last one taken back; a new decision forgets those. An undo or redo of nothing does nothing.

    A document's actions, one small row each, are read in order of seq; what is kept of them meanwhile are the last `steps`."""
    step = F.max(F.when(F.col("kind") == "undo", 1).when(F.col("kind") == "redo", 2).otherwise(0)).cast("int")
    actions = log.groupBy(doc, "seq").agg(step.alias("step"))
    kinds = {c: log.schema[c].dataType.simpleString() for c in (doc, "seq")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, past, undone = None, deque(), deque()
        for b in batches:
            kept: list[tuple] = []
            for d, seq, what in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if d != of:
                    kept += [(of, s) for s in past]
                    of, past, undone = d, deque(), deque()
                if what == 0:
                    past.append(seq)
                    undone.clear()
                elif what == 1 and past:
                    undone.append(past.pop())
                elif what == 2 and undone:
                    past.append(undone.pop())
                if len(past) > steps:
                    kept.append((of, past.popleft()))
            yield batch(kept, b.schema)
        if past:
            yield batch([(of, s) for s in past], b.schema)

    def batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, like.field(k).type) for k, c in enumerate(columns)], names=["doc", "seq"])

    # An action without a document belongs to none.
    ordered = actions.where(F.col(doc).isNotNull()).repartition(doc).sortWithinPartitions(doc, "seq").select(doc, "seq", "step")
    left = ordered.mapInArrow(run, f"doc {kinds[doc]}, seq {kinds['seq']}").withColumnRenamed("doc", doc)
    return log.where(~F.col("kind").isin("undo", "redo")).join(left, [doc, "seq"], "left_semi")


def flips(log: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, start, end, flipped: occurrences toggled an odd number of times since the last decision on
    their value, which resets them."""
    values = log.where("kind = 'value'").groupBy(doc, F.col("key").alias("__vkey")).agg(F.max("seq").alias("__reset"))
    toggles = log.where("kind = 'occurrence'").select(doc, F.col("key").alias("__okey"), "seq")
    s = spans.select(doc, "start", "end", occurrence_key().alias("__okey"), value_key(F.col("type"), F.col("text")).alias("__vkey"))
    met = s.join(toggles, [doc, "__okey"]).join(values, [doc, "__vkey"], "left").where("__reset is null or seq > __reset")
    return met.groupBy(doc, "start", "end").agg((F.count("*") % 2 == 1).alias("flipped"))


def value_states(log: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, key, excluded: the latest keep (true) or redact (false) of each value."""
    return as_of(log.where("kind = 'value'"), doc=doc).select(doc, "key", F.col("value").alias("excluded"))


def active_spans(spans: DataFrame, log: DataFrame, doc: str = "doc_id") -> DataFrame:
    """spans with `active`: off if the value is excluded or the occurrence flipped, but not both; manual ones stay on."""
    s = spans.withColumn("__vkey", value_key(F.col("type"), F.col("text")))
    v = value_states(log, doc).withColumnRenamed("key", "__vkey")
    s = s.join(v, [doc, "__vkey"], "left").join(flips(log, spans, doc), [doc, "start", "end"], "left")
    off = F.coalesce("excluded", F.lit(False)) != F.coalesce("flipped", F.lit(False))
    return s.withColumn("active", (F.col("source") == "manual") | ~off).select(*spans.columns, "active")


def manual_terms(texts: DataFrame, picked: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The picked spans (doc, start, end, text) and every occurrence of their text in the document."""
    own = picked.select(doc, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit("CUSTOM").alias("type"), "text", F.lit("manual").alias("source"), F.lit(1.0).alias("score"), (F.lit(DENY << 40) + F.col("start")).cast("bigint").alias("ord"))
    more = occurrences(texts, picked.select(doc, F.col("text").alias("term")).distinct(), doc, text)
    return own.unionByName(more).dropDuplicates([doc, "start", "end"])


def final_view(detected: DataFrame, manual: DataFrame, log: DataFrame, doc: str = "doc_id") -> DataFrame:
    """What will be redacted: detections that no manual span overlaps, the resolved manual ones, less what is kept."""
    both = without_overlap(detected, manual, doc).unionByName(resolve_overlaps(manual, doc))
    return active_spans(both, log, doc).where("active").drop("active")


def cell_decisions(cells: DataFrame, spans: DataFrame, decided: DataFrame, types: DataFrame) -> DataFrame:
    """Spans of cells after decisions (doc_id, sheet, row, col, value): true makes the whole cell a
    manual span of its column's type (or CUSTOM), false leaves nothing in it."""
    at = ["doc_id", "sheet", "row", "col"]
    rest = spans.join(decided.select(at), at, "left_anti")
    whole = cells.join(decided.where("value").select(at), at).where("value <> ''").join(types.select("doc_id", "sheet", "col", F.col("type").alias("__t")), ["doc_id", "sheet", "col"], "left")
    made = whole.select(*at, F.lit(0).alias("start"), F.length("value").alias("end"), F.coalesce("__t", F.lit("CUSTOM")).alias("type"), F.col("value").alias("text"), F.lit("manual").alias("source"), F.lit(1.0).alias("score"), F.lit(DENY << 40).cast("bigint").alias("ord"))
    return rest.select(made.columns).unionByName(made)


def column_decisions(cells: DataFrame, columns: DataFrame, header_rows: int = 1) -> DataFrame:
    """Decisions of whole columns (doc_id, sheet, col, value) as decisions of their non-empty body cells."""
    body = cells.where((F.col("row") >= header_rows) & (F.trim("value") != "")).select("doc_id", "sheet", "row", "col")
    return body.join(columns.select("doc_id", "sheet", "col", "value"), ["doc_id", "sheet", "col"]).select("doc_id", "sheet", "row", "col", "value")


def header_flags(detected: DataFrame, override: DataFrame) -> DataFrame:
    """doc_id, sheet, has_header: what people chose, else what was detected."""
    o = override.select("doc_id", "sheet", F.col("has_header").alias("__o"))
    return detected.join(o, ["doc_id", "sheet"], "left").select("doc_id", "sheet", F.coalesce("__o", "has_header").alias("has_header"))


def export_gate(docs: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """docs (doc_id, kind, ml_state) with `allowed`: not while the model is pending; after a failed model, or
    for a workbook, only when acknowledged."""
    a = acknowledged.select("doc_id", F.lit(True).alias("__ack")).distinct()
    needs = (F.col("ml_state") == "failed") | (F.col("kind") == "xlsx")
    allowed = (F.col("ml_state") != "pending") & (~needs | F.coalesce("__ack", F.lit(False)))
    return docs.join(a, "doc_id", "left").withColumn("allowed", allowed).drop("__ack")


def fingerprint(*parts: Column) -> Column:
    """Of what an export was made from; a result whose fingerprint differs from today's is stale."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def current_exports(exports: DataFrame, today: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, rejected) of exports (doc_id, fingerprint, ...): one made from other findings, decisions or settings than
    today's (doc_id, fingerprint), or of a document that is gone, is stale and rejected with a reason."""
    t = today.select("doc_id", F.col("fingerprint").alias("__now")).dropDuplicates(["doc_id"])
    both = exports.join(t, "doc_id", "left")
    same = F.coalesce(F.col("fingerprint") == F.col("__now"), F.lit(False))
    reason = F.when(F.col("__now").isNull(), "the document is gone").otherwise("review choices changed during the export")
    return both.where(same).drop("__now"), both.where(~same).withColumn("reason", reason).drop("__now")


def review_fingerprints(active: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, fingerprint of what an export of each document would put in. Spans are summed as hashes, so that no
    document's spans are gathered."""
    h = F.xxhash64("start", "end", "type", "text")
    made = active.groupBy(doc).agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(h, 24)).alias("a"), F.bit_xor(h).alias("b"))
    return made.select(doc, fingerprint(F.col("n"), F.col("a"), F.col("b")).alias("fingerprint"))
