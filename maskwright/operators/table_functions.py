"""Table functions for SQL: rules that are rows of a table, and models, over the rows of another table.

    register(spark)
    SELECT * FROM find_by_rules(TABLE(SELECT d.doc_id, d.text, r.rules FROM docs d JOIN rules_in_one_row r) PARTITION BY doc_id)

Their schema is planned from the table's (the id keeps its type). A rule is a row (type, pattern, score, group, flags,
valid), as `Rule` has it; `one_row` puts a rules table into one row, whose size is checked, as every text is searched
with all of them. The same rules as Column expressions, without Python, come from `rules_of`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from maskwright.functions.text import dialect
from maskwright.operators import rules

#: A rules table of more rows is refused.
MOST_RULES = 1_000
#: Checks that a rule may name, as Column functions.
VALID = {"luhn": rules.luhn_valid, "iban": rules.iban_valid, "ssn": rules.ssn_valid, "digit": rules.has_digit}
RULE_FIELDS = ("type", "pattern", "score", "group", "flags", "valid")


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _luhn(text: str) -> bool:
    d = [int(c) for c in _digits(text)][::-1]
    return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ssn(text: str) -> bool:
    d = _digits(text)
    return d[:3] not in ("000", "666") and d[:1] != "9" and d[3:5] != "00" and d[5:] != "0000"


_CHECKS: dict[str, Callable[[str], bool]] = {"luhn": _luhn, "iban": _iban, "ssn": _ssn, "digit": lambda t: bool(_digits(t))}


def checked(rows: Sequence[Row]) -> Sequence[Row]:
    """Rules with types, patterns and checks that are known; else an error that names the rule."""
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    for r in rows:
        if not r["type"] or not r["pattern"]:
            raise ValueError(f"a rule without type or pattern: {r}")
        if r["valid"] and r["valid"] not in VALID:
            raise ValueError(f"unknown check {r['valid']!r}; there are {sorted(VALID)}")
        if set(r["flags"] or "") - set("i"):
            raise ValueError(f"unknown flags {r['flags']!r}; there is i")
    return rows


def rules_of(table: DataFrame) -> tuple[rules.Rule, ...]:
    """The rules of a table (of MOST_RULES rows at most, in order of type and pattern) for `detect_rules`."""
    rows = checked(table.select(*(F.col(f"`{c}`") for c in RULE_FIELDS)).orderBy("type", "pattern").limit(MOST_RULES + 1).collect())
    return tuple(rules.Rule(r["type"], r["pattern"], float(r["score"]), VALID.get(r["valid"] or ""), int(r["group"] or 0), r["flags"] or "", hint="") for r in rows)


def one_row(table: DataFrame) -> DataFrame:
    """rules: all rows of a rules table as an array, to be put beside texts."""
    listed = table.agg(F.sort_array(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in RULE_FIELDS)))).alias("rules"))
    return listed.select(F.when(F.size("rules") <= MOST_RULES, F.col("rules")).otherwise(F.raise_error(F.lit(f"more than {MOST_RULES} rules"))).alias("rules"))


@lru_cache(MOST_RULES)
def _compiled(pattern: str, flags: str) -> regex.Pattern:
    shown = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: regex.escape(chr(int(m[1], 16))), dialect(pattern, flags=flags))
    return regex.compile(shown, regex.ASCII | regex.VERSION0)


def _planned(table: AnalyzeArgument, needed: Sequence[str]) -> AnalyzeResult:
    """The schema of spans, with the id as the table has it."""
    if not table.isTable:
        raise ValueError("the argument has to be a table: TABLE(...)")
    have = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in ("doc_id", *needed) if c not in have]:
        raise ValueError(f"the table needs the columns {missing}")
    texts = [StructField(c, t()) for c, t in (("start", IntegerType), ("end", IntegerType), ("type", StringType), ("text", StringType), ("score", DoubleType))]
    return AnalyzeResult(StructType([StructField("doc_id", have["doc_id"]), *texts]))


class FindByRules:
    """doc_id, start, end, type, text, score of every match of a row's rules in its text; a null text has none."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _planned(table, ("text", "rules"))

    def eval(self, row: Row) -> Iterator[tuple]:
        text = row["text"] or ""
        for rule in checked(row["rules"] or ()):
            check = _CHECKS.get(rule["valid"] or "")
            for m in _compiled(rule["pattern"], rule["flags"] or "").finditer(text):
                found = re.sub(r"[.,;:]+\Z", "", m[int(rule["group"] or 0)] or "")
                whole = m[int(rule["group"] or 0)] or ""
                if whole and (check is None or check(found)):
                    start = m.end() - len(whole)  # a group ends the match
                    yield row["doc_id"], start, start + len(found), rule["type"], found, float(rule["score"])


def annotator(load: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str, float]]]]]):
    """A table function around a model: load gives, once in a worker, a function of texts to their spans (start, end, type,
    score). Register it under a name: spark.udtf.register(name, annotator(load))."""

    class Annotate:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            return _planned(table, ("text",))

        def __init__(self):
            self.model = load()

        def eval(self, row: Row) -> Iterator[tuple]:
            text = row["text"] or ""
            for start, end, kind, score in self.model([text])[0] if text else ():
                yield row["doc_id"], int(start), int(end), kind, text[start:end], float(score)

    return udtf(Annotate)


def register(spark: SparkSession) -> None:
    """find_by_rules for this session's SQL."""
    spark.udtf.register("find_by_rules", udtf(FindByRules))
