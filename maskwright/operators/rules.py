"""Detection rules: arrays of spans as Column expressions, so that a text is scanned where it is.

Offsets are code points. A rule's matches and the text between them give each match's place, so no
UDF is needed; a cheap test decides first whether the rule can match at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.config import DENY, RULE, TYPES
from maskwright.functions.terms import TermIndex
from maskwright.functions.text import NO_WORD_AFTER, NO_WORD_BEFORE, WHITE_SPACE, bound, dialect, digits, let, let_sql, mapped, running

# Patterns, scores and their order.
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Ter|Parkway|Pkwy|Circle|Cir|Highway|Hwy|Square|Sq|Trail|Trl"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"""\b(?:https?:\/\/|www\.)[^\s<>"')\]]+"""
SSN = r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"
CREDIT_CARD = r"\b(?:\d[ -]?){12,18}\d\b"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{3}\)\s?|\b\d{3}[\s.-])\d{3}[\s.-]\d{4}\b"
PHONE_INTERNATIONAL = r"\+\d{1,3}(?:[\s.-]?\d{2,4}){2,5}\b"
DATE = r"\b(?:\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})|\d{4}-\d{2}-\d{2})\b"
DATE_WORDS = rf"\b(?:(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\s*,?\s*\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\.?,?\s+\d{{4}})\b"
ADDRESS = rf"\b\d{{1,6}}\s+(?:[NSEW]\.?\s+)?(?:[A-Z][A-Za-z0-9'-]*\s+){{1,4}}(?:{STREETS}|{STREETS.upper()})\b\.?(?:,?\s+(?:Apt|Suite|Ste|Unit|#)\.?\s*[A-Za-z0-9-]+)?"
PO_BOX = r"\bP\.?\s?O\.?\s+Box\s+\d+\b"
ZIP = r"\b[A-Z]{2}\s+(\d{5}(?:-\d{4})?)\b"
ID_NUMBER = (
    r"\b(?:MRN|Medical Record(?: Number| No\.?)?|Patient ID|Account(?: Number| No\.?| #)?|Acct\.?(?: #)?|Policy(?: Number| No\.?)?|(?:Insurance |Health Plan )?Member(?: ID| Number| No\.?| #)"
    r"|Insurance(?: ID| Number| No\.?)|License(?: Number| No\.?)?|Passport(?: Number| No\.?)?|Employee ID|DOB"
    r"|(?:Web|PPD|CCD|ACH|Customer|Client|Transaction|Trans|Reference|Ref|Confirmation|Conf|Trace|Case|Claim|Order|Invoice)\.?\s*(?:ID|#|No\.?|Number))\s*[:#]?\s*([A-Z0-9][A-Z0-9-]{3,})"
)
# End of fixed values.


def luhn_valid(text: Column) -> Column:
    d = digits(text)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def iban_valid(text: Column) -> Column:
    """Mod 97 of the text with its first four characters at the end, letters as 10 to 35, is 1."""
    s = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    moved = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.length(s).between(15, 34) & (F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1)


def ssn_valid(text: Column) -> Column:
    d = digits(text)
    area = d.substr(1, 3)
    return ~area.isin("000", "666") & (d.substr(1, 1) != "9") & (d.substr(4, 2) != "00") & (d.substr(F.lit(6), F.length(d)) != "0000")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\d")


@dataclass(frozen=True)
class Rule:
    """A pattern (browser dialect) whose matches, or their closing group 1, are spans of a type.

    hint: a literal or regex that every match holds, cheap to test before the pattern."""

    type: str
    pattern: str
    score: float
    valid: Callable[[Column], Column] | None = None
    group: int = 0
    flags: str = ""
    hint: str = r"\d"


# What every match holds, as white space of any script counts: a month before or after a number, a number before a
# capital or N, S, E or W, a state before five digits, and a label's word.
MONTH_HINT = rf"(?i)\d(?:st|nd|rd|th)?[{WHITE_SPACE}]+(?:{{m}})|(?:{{m}})[a-z]*\.?[{WHITE_SPACE}]+\d".replace("{m}", "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")
STREET_HINT = rf"\d[{WHITE_SPACE}]+[A-Z]"
ZIP_HINT = rf"[A-Z]{{2}}[{WHITE_SPACE}]+\d{{5}}"
LABEL_HINT = (
    r"(?i)mrn|medical record|patient id|ac(?:coun|c)t|policy|member|insurance|license|passport|employee id|dob"
    r"|(?:web|ppd|ccd|ach|customer|client|trans|ref|conf|trace|case|claim|order|invoice)[a-z]*\.?[^a-z0-9]*(?:id|#|no|number)"
)

RULES = (
    Rule("EMAIL", EMAIL, 0.99, hint="@"),
    Rule("URL", URL, 0.95, flags="i", hint="(?i)www\\.|://"),
    Rule("SSN", SSN, 0.95, ssn_valid, hint=r"\d{3}[- ]\d{2}[- ]\d{4}"),
    Rule("CREDIT_CARD", CREDIT_CARD, 0.95, luhn_valid, hint=r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"),
    Rule("IBAN", IBAN, 0.95, iban_valid, hint=r"[A-Z]{2}\d{2}"),
    Rule("IP_ADDRESS", IPV4, 0.9, hint=r"\d\.\d"),
    Rule("IP_ADDRESS", IPV6, 0.9, hint=r"[0-9a-fA-F]:[0-9a-fA-F]"),
    Rule("PHONE", PHONE, 0.9, hint=r"\d{4}"),
    Rule("PHONE", PHONE_INTERNATIONAL, 0.8, hint=r"\+\d"),
    Rule("DATE", DATE, 0.85, hint=r"\d[/.-]\d"),
    Rule("DATE", DATE_WORDS, 0.9, flags="i", hint=MONTH_HINT),
    Rule("ADDRESS", ADDRESS, 0.85, hint=STREET_HINT),
    Rule("ADDRESS", PO_BOX, 0.85, flags="i", hint="(?i)box"),
    Rule("ZIP", ZIP, 0.85, group=1, hint=ZIP_HINT),
    Rule("ID_NUMBER", ID_NUMBER, 0.85, has_digit, group=1, flags="i", hint=LABEL_HINT),
)


#: Marks around a match; they are control characters that texts hardly hold, and no text with them takes that way.
OPEN, BETWEEN, CLOSE = "\x01", "\x02", "\x03"
_ADD = lambda a, b: f"{a} + {b}"
_NONE = "cast(array() AS array<struct<start:int,t:string>>)"
#: Pieces v (what lies between and matches, in turns) to places: sizes z, places at.
_MARKED = bound("z", f"transform(v, p -> named_struct('n', length(split(p, '{BETWEEN}')[0]), 't', element_at(split(p, '{BETWEEN}'), -1)))", bound(
    "at", running("transform(z, x -> x.n)", _ADD, "0"),
    "transform(sequence(1, size(z) - 2, 2), i -> named_struct('start', at[i] + z[i].n - length(z[i].t), 't', z[i].t))",
))
#: The same of v.gap, v.m and v.t: what lies between, the matches and what is shown of them.
_APART = bound("z", "transform(v.m, (m, i) -> named_struct('n', length(v.gap[i]) + length(m), 't', v.t[i]))", bound(
    "at", running("transform(z, x -> x.n)", _ADD, "0"),
    "transform(z, (x, i) -> named_struct('start', at[i] + x.n - length(x.t), 't', x.t))",
))


def located(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """array<struct<start, t>> of a pattern's matches (or their group, which ends the match).

    The matches are marked in one pass over the text, which is then split at the marks. A text that holds
    such marks itself is searched twice instead, for matches and for what lies between."""
    re = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(text, re, F.lit(f"{OPEN}$0{BETWEEN}${group}{CLOSE}"))
    fast = let_sql(F.split(marked, f"[{OPEN}{CLOSE}]", -1), f"CASE WHEN size(v) <= 1 THEN {_NONE} ELSE {_MARKED} END")
    parts = F.call_function("split", text, re, F.lit(-1)).alias("gap")
    slow = let_sql(F.struct(parts, F.regexp_extract_all(text, re, F.lit(0)).alias("m"), F.regexp_extract_all(text, re, F.lit(group)).alias("t")), _APART)
    return F.when(text.rlike(f"[{OPEN}-{CLOSE}]"), slow).otherwise(fast)


def _spans(found: Column, type_: str, source: str, score: float, stage: int, number: int) -> Column:
    """Spans of places (start, t); candidates keep the order of stage, rule and place."""
    made = f"'type', '{type_}', 'text', m.t, 'source', '{source}', 'score', {score}D, 'ord', {(stage << 40) + (number << 32)}L + m.start"
    return mapped(found, f"m -> named_struct('start', m.start, 'end', m.start + length(m.t), {made})")


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,type:string,text:string,source:string,score:double,ord:bigint>>")


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """The spans of one rule."""
    found = located(text, dialect(rule.pattern, flags=rule.flags), rule.group)
    end_marks = "m -> named_struct('start', m.start, 't', regexp_replace(m.t, r'[.,;:]+\\z', ''))"
    cut = mapped(F.call_function("filter", found, F.expr("m -> m.t <> ''")), end_marks)
    valid = F.filter(cut, lambda m: rule.valid(m["t"])) if rule.valid else cut
    return F.when(text.rlike(rule.hint), _spans(valid, rule.type, "rule", rule.score, RULE, number)).otherwise(no_spans())


def detect_rules(text: Column, enabled: Iterable[str] = TYPES, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of all rules of enabled types, rule after rule; others are not even scanned for. A text that is itself
    computed is computed once, not for each rule."""
    on = [(k, r) for k, r in enumerate(rules) if r.type in set(enabled)]
    if not on:
        return no_spans()
    return F.coalesce(let(text, lambda t: F.concat(*(rule_spans(t, r, k) for k, r in on))), no_spans())


def term_spans(text: Column, term: str, number: int) -> Column:
    """Every whole-word occurrence of a term, in any case."""
    pattern = rf"(?iu){NO_WORD_BEFORE}\Q{term}\E{NO_WORD_AFTER}"
    found = _spans(located(text, pattern), "CUSTOM", "manual", 1.0, DENY, number)
    return F.when(F.contains(F.lower(text), F.lit(term.lower())), found).otherwise(no_spans())


#: Lists of more terms are searched for in one pass over a text's words, in Python; shorter ones by a pattern each.
FEW_TERMS = 16


def _many_term_spans(text: Column, terms: list[tuple[int, str]]) -> Column:
    shape = pa.list_(pa.struct([("start", pa.int32()), ("t", pa.string()), ("k", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,t:string,k:int>>")
    def find(texts: pa.Array) -> pa.Array:
        index = TermIndex([t for _, t in terms])
        hits = ((t, index.hits(t)) if t is not None else None for t in texts.to_pylist())
        return pa.array([None if h is None else [{"start": s, "t": h[0][s:e], "k": terms[k][0]} for s, e, k in h[1]] for h in hits], shape)

    made = "'type', 'CUSTOM', 'text', m.t, 'source', 'manual', 'score', 1D"
    ord_ = f"'ord', {DENY << 40}L + shiftleft(cast(m.k AS bigint), 32) + m.start"
    return mapped(find(text), f"m -> named_struct('start', m.start, 'end', m.start + length(m.t), {made}, {ord_})")


def deny_spans(text: Column, terms: Iterable[str]) -> Column:
    """Spans of terms that are always redacted."""
    some = [(k, t.strip()) for k, t in enumerate(terms) if t.strip()]
    if len(some) > FEW_TERMS:
        return F.coalesce(_many_term_spans(text, some), no_spans())
    found = [term_spans(text, t, k) for k, t in some]
    return F.coalesce(F.concat(*found), no_spans()) if found else no_spans()


def span_rows(df: DataFrame, spans: Column, *keys: str | Column) -> DataFrame:
    """One row a span (or place), after the key columns. The outer form with a filter on its rows, as the plain
    one makes Spark evaluate the spans once more, in a filter before it."""
    return df.select(*keys, F.inline_outer(spans)).where(F.col("start").isNotNull())
