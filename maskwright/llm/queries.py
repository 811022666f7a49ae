"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The public vocabulary file that op10 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import fuzzy_passages

    return fuzzy_passages.passages(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import maxent_lm

    return maxent_lm.run(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import decontaminate

    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import substring_dedup

    return substring_dedup.digests(substring_dedup.dedup(_table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import url_filter

    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import jaccard_join

    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from maskwright.llm import line_dedup

    done = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "__removed.n_lines", "__removed.n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import quality_rules

    return quality_rules.ledger_rows(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import bpe

    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary_path()))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import filter_audit

    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from maskwright.llm import byte_bpe

    return byte_bpe.digests(byte_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm import resample

    done = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_fuzzy_passages, op3_lm_scoring, op4_decontamination, op5_suffix_array_dedup, op6_url_filter,
        op7_jaccard_join, op8_line_dedup, op9_quality_rules, op10_bpe, op11_filter_audit, op12_byte_bpe, op13_importance_resampling,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op6_url_filter"] = r"""
WITH r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rest),
fit AS (SELECT p.n, r.rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule) DESC) AS k
        FROM p JOIN r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
                     AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN regexp_matches(p.host, '(^|[.-])(ads|adult|bets|casino|pills|porn|spam|warez)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.n = p.n AND fit.k = 1
"""

ORACLES["op9_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
             length(t) - length(replace(t, '!', '')) AS n_exclamations
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_upper > n_letters THEN 8 ELSE 0 END)
             + (CASE WHEN n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END)
             + (CASE WHEN word_chars < 2.5 * n_words OR word_chars > 12.0 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END) + (CASE WHEN 10 * n_exclamations > n_words THEN 128 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM f
"""

ORACLES["op4_decontamination"] = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
si AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""

ORACLES["op8_line_dedup"] = r"""
WITH l AS (SELECT doc_id, text, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, x AS raw, j
           FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents)),
p AS (SELECT doc_id, j, line, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, lead(line) OVER (PARTITION BY doc_id ORDER BY j) AS after FROM l WHERE line <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k1, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) AS k2 FROM p),
gone AS (SELECT doc_id, i FROM f WHERE k1 > 1 AND length(line) >= 120
         UNION SELECT doc_id, i + d FROM f, (VALUES (0), (1)) v(d) WHERE k2 > 1 AND after IS NOT NULL),
g AS (SELECT p.doc_id, p.j, p.i - row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i) AS run FROM p JOIN gone USING (doc_id, i)),
r AS (SELECT doc_id, min(j) AS s, max(j) AS e, count(*) AS n FROM g GROUP BY doc_id, run),
kept AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.j) AS t FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND l.j BETWEEN r.s AND r.e) GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM p GROUP BY doc_id),
x AS (SELECT doc_id, sum(n) AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(x.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(prefix, before, bit, step) AS (
  SELECT '', 0, 0, 0
  UNION ALL
  SELECT prefix || f.letter, before | p.bit, f.bit, step + 1 FROM p, f WHERE (before | p.bit) & f.bit = 0),
x AS (SELECT part, prefix, p.bit, step, sum(CASE WHEN mask & (before | p.bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & p.bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & p.bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = p.bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & p.bit <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & p.bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, p WHERE step > 0 GROUP BY part, prefix, p.bit, step),
o AS (SELECT x.*, full_order.prefix AS filter_order FROM x JOIN p AS full_order ON full_order.step = 5 AND starts_with(full_order.prefix, x.prefix)),
s AS (SELECT part, bit, sum(removed) AS shapley FROM o GROUP BY part, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM o JOIN s USING (part, bit)
"""
