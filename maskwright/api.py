"""The library's front: detect, decide, redact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.config import RedactionConfig
from maskwright.operators.replace import apply_spans, redacted, reid_key
from maskwright.operators.rules import RULES, Rule, deny_spans, detect_rules, span_rows
from maskwright.operators.spans import filter_spans, keep_span, resolve, resolve_overlaps


def candidate_spans(text: Column, config: RedactionConfig, rules: tuple[Rule, ...] = RULES) -> Column:
    """Rule and always-list candidates, in that order."""
    return F.concat(detect_rules(text, config.enabled, rules), deny_spans(text, config.deny))


def active_spans(text: Column, config: RedactionConfig, rules: tuple[Rule, ...] = RULES) -> Column:
    """The resolved spans of a text, in the row."""
    return resolve(F.filter(candidate_spans(text, config, rules), lambda s: keep_span(config, s)))


def with_spans(df: DataFrame, config: RedactionConfig | None = None, text: str = "text", into: str = "spans") -> DataFrame:
    """df with its resolved spans as an array; works on streams as on tables."""
    return df.withColumn(into, active_spans(F.col(text), config or RedactionConfig()))


def rules_spans(df: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every match of some rules as a table, before settings and overlaps."""
    return span_rows(df, detect_rules(F.col(text), {r.type for r in rules}, rules), id_col)


def detect(df: DataFrame, config: RedactionConfig | None = None, id_col: str = "doc_id", text: str = "text", ner: Callable[[DataFrame], DataFrame] | None = None, extra: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The resolved spans of every text as a table. ner: texts to spans of a model (see operators.model), widened to repeats of
    its names; extra: more candidates, such as header spans; rules: other rules than the built-in ones, or those and more
    (operators.table_functions.rules_of takes them from a table)."""
    config = config or RedactionConfig()
    if ner is None and extra is None:
        return span_rows(df, active_spans(F.col(text), config, rules), id_col)
    found = span_rows(df, candidate_spans(F.col(text), config, rules), id_col)
    if extra is not None:
        found = found.unionByName(extra)
    if ner is not None:
        from maskwright.operators.propagate import with_propagation

        found = found.unionByName(with_propagation(df, ner(df), id_col, text))
    return resolve_overlaps(filter_spans(found, config), id_col)


def redact(df: DataFrame, active: DataFrame | None = None, config: RedactionConfig | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its findings replaced: those of a table, or those that the settings find, in one pass."""
    config = config or RedactionConfig()
    if active is not None:
        return apply_spans(df, active, config.mode, id_col, text)
    spans = "__spans"
    return with_spans(df, config, text, spans).withColumn(text, redacted(F.col(text), F.col(spans), config.mode)).drop(spans)


def preview(df: DataFrame, found: DataFrame, doc: object, log: DataFrame | None = None, manual: DataFrame | None = None, config: RedactionConfig | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The text of one document as its current choices leave it: found (all candidates) by today's settings, manual spans and
    the decisions of the log that undo and redo leave. The id reaches every scan as a filter."""
    from maskwright.operators.review import final_view, in_force

    config = config or RedactionConfig()
    only = lambda t: t.where(F.col(id_col) == F.lit(doc))
    spans = resolve_overlaps(filter_spans(only(found), config), id_col)
    if manual is None:
        manual = found.limit(0)
    decided = df.sparkSession.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, seq int, kind string, key string, value boolean") if log is None else in_force(only(log), id_col)
    return apply_spans(only(df), final_view(spans, only(manual), decided, id_col), config.mode, id_col, text)


__all__ = ["RULES", "RedactionConfig", "Rule", "active_spans", "candidate_spans", "detect", "preview", "redact", "reid_key", "rules_spans", "with_spans"]
