"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and one failure bit a
rule. Policies are versioned sets of rules, applied to the ledger alone, and ablations are bitwise
aggregations of it: no text is read again. Row-local but for the ablation, which shuffles one
partial count for each distinct mask.

Defined results: a null or empty text has no words and fails `few_words`; null ids and repeated
rows pass through as they are; other columns of the input are kept, also with names used here,
as the ledger is one struct column; one named `__ledger` is an error. An empty table gives no rows, and texts of any
length are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import WORD_BREAK, text_column

#: Bit of each rule, in order; the order is part of stored ledgers and only ever grows.
RULES = ("few_words", "repeated_words", "symbols", "upper_case", "duplicate_lines", "word_length", "no_letters", "exclamations")
LEDGER = "__ledger"


@dataclass(frozen=True)
class Policy:
    """A named version of the rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, RULES)


def _let(value: Column, body) -> Column:
    """Bind value once, so that a lambda over it does not evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        def marked(s: Column) -> Column:
            n = F.size(s)
            same = lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k + 1 < n) & (F.get(s, k + 1)["h"] == e["h"]))
            at = F.filter(F.transform(s, lambda e, k: F.when(same(e, k), e["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ranked, marked))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, 0).otherwise(_let(_let(words, windows), covered))


def evaluate_rules(docs: DataFrame, text: str = "text", min_words: int = 50, min_mean_chars: float = 2.5, max_mean_chars: float = 12.0) -> DataFrame:
    """docs with a struct column LEDGER: measurements and fail_bits (bit k: RULES[k] failed)."""
    if LEDGER in docs.columns:
        raise ValueError(f"a column is named {LEDGER}")
    body = text_column(text)
    w = f"{LEDGER}_w"
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    measured = docs.withColumns({w: F.array_remove(F.split(body, WORD_BREAK), ""), f"{LEDGER}_l": counted}).withColumn(
        LEDGER,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.col(f"{LEDGER}_l")["dup"].cast("long").alias("n_dup_lines"),
            F.col(f"{LEDGER}_l")["n"].cast("long").alias("n_lines"),
            _repeat_words(F.col(w)).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(body, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.regexp_count(body, F.lit("!")).cast("long").alias("n_exclamations"),
        ),
    ).drop(w, f"{LEDGER}_l")
    m = lambda name: F.col(f"{LEDGER}.{name}")
    failed = (
        m("n_words") < min_words,
        100 * m("n_repeat_words") > 50 * m("n_words"),
        10 * m("n_symbols") > m("n_words"),
        2 * m("n_upper") > m("n_letters"),
        (m("n_dup_lines") > 3) & (10 * m("n_dup_lines") > 3 * m("n_lines")),
        (m("word_chars") < min_mean_chars * m("n_words")) | (m("word_chars") > max_mean_chars * m("n_words")),
        2 * m("n_letters") < m("word_chars"),
        10 * m("n_exclamations") > m("n_words"),
    )
    bits = sum((F.when(bad, F.lit(1 << k)).otherwise(F.lit(0)) for k, bad in enumerate(failed)), F.lit(0)).cast("long")
    return measured.withColumn(LEDGER, F.col(LEDGER).withField("fail_bits", bits))


def passes(policy: Policy, bits: Column | None = None) -> Column:
    return (F.col(f"{LEDGER}.fail_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The rows that pass, without the ledger."""
    return ledger.where(passes(policy)).drop(LEDGER)


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else, and that are
    kept without it. Masks are counted first, so one row a distinct mask is shuffled by each task."""
    masks = ledger.groupBy(F.col(f"{LEDGER}.fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules)))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return (
        masks.select("bits", "n", rules.alias("r"))
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def ledger_rows(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """One row a document: measurements, base_failed, fail_bits and the policy's verdict."""
    m = lambda name: F.col(f"{LEDGER}.{name}")
    base_failed = ~passes(BASE)
    return evaluate_rules(docs).select(
        "doc_id", *(m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed.alias("base_failed"), (~base_failed & passes(policy)).alias("kept"), m("fail_bits").alias("fail_bits"),
    )
