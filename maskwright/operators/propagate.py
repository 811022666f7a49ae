"""Names found once, found again: variants, dictionary search and occurrences.

A document's few terms are put beside its text by one join, so a text moves once at most and never once a hit.
The search reads a text's words once and looks each up among the first words of the terms, so its work is the
words and the hits, not terms times texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.config import DENY, MODEL
from maskwright.functions.terms import TermIndex, is_word
from maskwright.functions.text import trimmed
from maskwright.operators.spans import plausible

# Which types spread, what a part of a name looks like, and how much score a repeat keeps.
SPREADING = ("PERSON", "ORG", "LOCATION")
NAME_PART = r"^[A-Z][a-z'-]{2,}\z"
REPEAT_SCORE = 0.95
# End of fixed values.

WORD = r"[\p{L}\p{N}_]+"


def name_variants(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, type, term, score: each name and, of persons, its parts; the first of equal ones."""
    some = spans.where(F.col("type").isin(*SPREADING))
    parts = F.when(F.col("type") == "PERSON", F.filter(F.split(F.col("text"), r"[\s]+"), lambda p: p.rlike(NAME_PART))).otherwise(F.array().cast("array<string>"))
    terms = some.select(doc, "type", "score", "ord", F.posexplode(F.concat(F.array(trimmed(F.col("text"))), parts)).alias("k", "term")).where(F.length("term") >= 3)
    first = Window.partitionBy(doc, "type", "term").orderBy("ord", "k")
    return terms.withColumn("n", F.row_number().over(first)).where("n = 1").select(doc, "type", "term", "score", "ord", "k")


def _hits(text: str, terms: list[dict], known: set[tuple[str, int, int]]) -> list[tuple[int, int, str, str, float, int]]:
    """start, end, type, term, score and number of the term of every whole-word occurrence of terms that is not
    known; of several terms at one place (and of one type) the first."""
    by_word: dict[str, list[tuple[int, int]]] = {}
    for k, term in enumerate(terms):
        first = re.search(r"\w+", term["term"])
        if first:
            by_word.setdefault(first[0], []).append((first.start(), k))
    out = []
    for m in re.finditer(r"\w+", text):
        for lead, k in by_word.get(m[0], ()):
            term, start = terms[k]["term"], m.start() - lead
            end = start + len(term)
            if start < 0 or not text.startswith(term, start) or (terms[k]["type"], start, end) in known:
                continue
            if (start and is_word(text[start - 1])) or (end < len(text) and is_word(text[end])):
                continue
            known.add((terms[k]["type"], start, end))
            out.append((start, end, terms[k]["type"], term, terms[k]["score"], k))
    return out


def with_propagation(texts: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Plausible model spans and, at a lower score, every case-sensitive whole-word repeat of their names that
    was not found yet, overlapping ones included."""
    own = spans.where(plausible(F.col("type"), F.col("text")))
    names = name_variants(own, doc).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ord", "k", "type", "term", "score"))).alias("terms"))
    places = own.groupBy(doc).agg(F.collect_list(F.struct("type", "start", "end")).alias("known"))
    kind = texts.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, terms, known in zip(*(b.column(c) for c in ("doc", "text", "terms", "known")), strict=True):
                if t.is_valid:
                    have = {(x["type"], x["start"], x["end"]) for x in known.as_py() or ()}
                    rows += [(i.as_py(), *hit) for hit in _hits(t.as_py(), terms.as_py(), have)]
            columns = list(zip(*rows, strict=True)) or [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    met = texts.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(names.withColumnRenamed(doc, "doc"), "doc").join(places.withColumnRenamed(doc, "doc"), "doc", "left")
    found_schema = f"doc {kind}, start int, end int, type string, text string, score double, k int"
    shape = to_arrow_schema(texts.sparkSession.createDataFrame([], found_schema).schema)
    new = met.select("doc", "text", "terms", "known").mapInArrow(run, found_schema)
    repeats = new.select(
        F.col("doc").alias(doc), "start", "end", "type", "text", F.lit("ml").alias("source"), (F.col("score") * REPEAT_SCORE).alias("score"),
        (F.lit((MODEL << 40) + (1 << 36)) + F.col("start")).cast("bigint").alias("ord"),
    )
    return own.select(repeats.columns).unionByName(repeats)


def occurrences(texts: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole-word occurrence of terms in any case, as manual spans. terms: column term, and doc if they belong
    to documents. Terms of a list meet the texts that hold their first word, in small letters, by an equi-join of
    words; each text then gets its terms beside it and is searched for all of those in one pass over its words. Terms without
    a letter, digit or underscore are searched for in every text."""
    t = terms.withColumn("term", trimmed(F.col("term"))).where("term <> ''")
    if doc in t.columns:
        per = t.select(doc, "term").distinct().groupBy(doc).agg(F.collect_list("term").alias("__terms"))
    else:
        folded = lambda c: F.lower(F.upper(c))
        keyed = t.select("term", folded(F.regexp_extract("term", WORD, 0)).alias("__w")).distinct()
        words = texts.select(doc, F.explode(F.array_distinct(F.split(folded(F.col(text)), r"[^\p{L}\p{N}_]+"))).alias("__w"))
        met = words.join(keyed.where("__w <> ''"), "__w").select(doc, "term")
        marks = keyed.where("__w = ''").groupBy().agg(F.collect_list("term").alias("m"))  # one row: a list that people typed
        met = met.unionByName(texts.crossJoin(F.broadcast(marks)).select(doc, F.explode("m").alias("term")))
        per = met.distinct().groupBy(doc).agg(F.collect_list("term").alias("__terms"))
    kind = texts.schema[doc].dataType.simpleString()
    here = texts.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL").join(per.select(F.col(doc).alias("doc"), F.array_sort("__terms").alias("terms")), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = TermIndex([]), None
        for b in batches:
            rows = []
            for i, t, some in zip(*(b.column(c) for c in ("doc", "text", "terms")), strict=True):
                own = some.as_py()
                if own != of:  # texts with the same terms share their index
                    index, of = TermIndex(own), own
                whole = t.as_py()
                rows += [(i.as_py(), start, end, whole[start:end]) for start, end, _ in index.hits(whole)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [b.schema.field("doc").type, pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "start", "end", "text"])

    hits = here.mapInArrow(run, f"doc {kind}, start int, end int, text string")
    made = hits.select(
        F.col("doc").alias(doc), "start", "end", F.lit("CUSTOM").alias("type"), "text",
        F.lit("manual").alias("source"), F.lit(1.0).alias("score"), (F.lit(DENY << 40) + F.col("start")).cast("bigint").alias("ord"),
    )
    return made.distinct()
