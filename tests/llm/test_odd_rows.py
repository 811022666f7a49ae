"""Long texts made of words, for each operator, and the pipeline on null ids, repeated rows, clashing names and empty tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm import brute_groups, brute_lines, brute_substrings, docs, words

from maskwright.llm import bpe, fuzzy_passages, jaccard_join, line_dedup, maxent_lm, quality_rules, substring_dedup
from maskwright.llm.queries import vocabulary_path

LETTERS = str.maketrans("0123456789", "abcdefghij")


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n)).translate(LETTERS)


@pytest.fixture(scope="module")
def long_texts():
    """A text of 7,000 words in lines, its near copy, one that shares its second half, an exact copy, and another one."""
    rng = random.Random(21)
    lines = [prose(rng, 50, 50_000) for _ in range(140)]
    edited = [x + " edited" if i % 40 == 7 else x for i, x in enumerate(lines)]
    half = [prose(rng, 50, 50_000) for _ in range(70)] + lines[70:]
    other = [prose(rng, 7_000, 50_000)]  # one line of more than 30,000 characters
    return ["\n".join(x) for x in (lines, edited, half, lines, other)]


def test_long_texts_of_words_against_brute_force(spark, long_texts):
    d = docs(spark, long_texts)
    assert min(map(len, long_texts)) > 30_000
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digests(substring_dedup.dedup(d)).collect()}
    assert [got[i] for i in range(5)] == brute_substrings(long_texts, 200)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d).collect()}
    assert [got[i] for i in range(5)] == brute_groups(long_texts, 3, 90) and got[1][1] == got[3][1] == 0
    got = {r["doc_id"]: (r["__removed"]["n_lines"], r["__removed"]["n_removed"], r["text"]) for r in line_dedup.dedup(d).collect()}
    assert [got[i] for i in range(5)] == brute_lines(long_texts) and got[3][2] == ""
    got = {r["doc_id"]: r for r in quality_rules.ledger_rows(d).collect()}
    assert all((got[i]["n_words"], got[i]["word_chars"]) == (len(words(t)), sum(map(len, words(t)))) for i, t in enumerate(long_texts))


def test_long_texts_of_words_encoded_scored_and_chained(spark, long_texts):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path())
    d = docs(spark, long_texts)
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(bpe.encode(d, vocabulary_path())).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long_texts)}
    got = {r["doc_id"]: r for r in maxent_lm.run(d).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(words(t)) + 1 for i, t in enumerate(long_texts)}
    assert got[0]["score"] == pytest.approx(got[3]["score"], rel=1e-9) and got[0]["base_score"] == pytest.approx(got[3]["base_score"], rel=1e-9)
    n = len(words(long_texts[0]))
    whole = {(r["doc_id"], r["match_doc_id"]): r["n_words"] for r in fuzzy_passages.passages(d).collect()}
    assert whole[3, 0] == n and whole[1, 0] >= n and n // 2 <= whole[2, 0] <= n // 2 + 60 and not any(4 in pair for pair in whole)


def test_values_of_null_ids_and_repeated_rows(spark):
    """A row without an id comes first in the order of lines; rows of one id and text fare alike."""
    rng = random.Random(1)
    t = "\n".join(prose(rng, 60) for _ in range(3))
    rows = [(None, t, "en", "s", 1), (1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t + " more", "en", "s", 1), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_words", F.lit(1))
    key = lambda r: (r[0] is not None, r)
    got = sorted(((r["doc_id"], r["__removed"]["n_lines"], r["__removed"]["n_removed"]) for r in line_dedup.dedup(d).collect()), key=key)
    assert got == [(None, 3, 0), (1, 3, 3), (1, 3, 3), (2, 3, 2), (3, 0, 0)]
    got = sorted(((r["doc_id"], r["n_words"]) for r in quality_rules.ledger_rows(d).collect()), key=key)
    assert got == [(None, 180), (1, 180), (1, 180), (2, 181), (3, 0)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.join(d).where("doc_id is not null").collect()), key=key)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in maxent_lm.run(d).collect()), key=key)
    assert got == [(None, 181), (1, 181), (1, 181), (2, 182), (3, 1)]


def test_pipeline_on_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    copied, single, near = ("\n".join(prose(rng, 40) for _ in range(4)) for _ in range(3))
    edited = " ".join(near.split()) + " edited"  # one line, so that only the join finds it
    rows = [(None, copied), (1, copied), (1, copied), (5, single), (5, single), (6, near), (7, edited), (8, None), (9, ""), (10, "few words")]
    clashing = "doc_id long, text string, n_words long, fail_bits long, kept boolean, th long, i long, component_id long, n_tokens long"
    d = spark.createDataFrame([(*r, 1, 2, True, 3, 4, 5, 6) for r in rows], clashing)
    d.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for name in ("odd", "empty"):
        benchmark.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path())
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert got == [(-1, size(copied)), (5, size(single)), (5, size(single)), (6, size(near))]
    d.where("false").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    left = corpus_pipeline.run(spark, str(tmp_path / "empty"))
    assert left.count() == 0 and {"doc_id", "n_tokens"} <= set(left.columns)
