"""Many terms in one pass over a text."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from maskwright import api
from maskwright.config import RedactionConfig
from maskwright.functions.terms import TermIndex
from maskwright.operators import propagate, rules


def by_patterns(text, terms):
    edge = r"[\p{L}\p{N}_]"
    return [(m.start(), m.end(), k) for k, t in enumerate(terms) for m in regex.finditer(rf"(?i)(?<!{edge}){regex.escape(t)}(?!{edge})", text)]


def test_hits_are_those_of_a_pattern_for_each_term():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", "é", "É", "_", "1", " ", "-", "+", "#", "ab", "\n"]) for _ in range(rng.randrange(0, 60)))
        terms = ["".join(rng.choice("abé1 -+#_") for _ in range(rng.randrange(1, 5))).strip() or "a" for _ in range(rng.randrange(1, 9))]
        assert TermIndex(terms).hits(text) == by_patterns(text, terms), (text, terms)


def test_edges_and_overlaps():
    text = "Falcon FALCON nest, falconry; C++ c++ a a a a"
    terms = ["falcon", "Falcon nest", "c++", "++", "a a", "nest, falconry"]
    assert [(text[s:e], k) for s, e, k in TermIndex(terms).hits(text)] == [("Falcon", 0), ("FALCON", 0), ("FALCON nest", 1), ("C++", 2), ("c++", 2), ("a a", 4), ("a a", 4), ("nest, falconry", 5)]
    assert TermIndex([]).hits("x") == TermIndex(["x"]).hits("") == []


def test_a_long_list_finds_what_a_short_one_does(spark):
    docs = spark.createDataFrame([(1, "Project Falcon and FALCON nest, falconry; C++"), (2, None), (3, ""), (4, "ÉCLAIR éclair")], "doc_id long, text string")
    terms = ("falcon", " Project Falcon ", "", "c++", "éclair")
    rows = lambda list_: sorted(map(tuple, rules.span_rows(docs, rules.deny_spans(F.col("text"), list_), "doc_id").collect()))
    short = rows(terms)
    assert len(short) == 6 and rows(terms + tuple(f"absent{k}" for k in range(5000))) == short
    out = api.redact(docs, config=RedactionConfig(deny=terms + tuple(f"absent{k}" for k in range(100))))
    assert {r["doc_id"]: r["text"] for r in out.collect()}[4] == "[CUSTOM_1] [CUSTOM_1]"


@pytest.mark.parametrize("n", [250, 4000])
def test_terms_of_a_document_in_one_pass(spark, n):
    words = [f"w{k}" for k in range(12_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 W2")], "doc_id int, text string")
    terms = spark.createDataFrame([(1, f"W{k}") for k in range(n)] + [(2, "w2")], "doc_id int, term string")
    start = time.time()
    got = propagate.occurrences(docs, terms).collect()
    assert len(got) == n + 1 and time.time() - start < 30
    assert {(r["start"], r["text"]) for r in got if r["doc_id"] == 2} == {(3, "W2")}
