"""Detection, resolution and replacement, on examples."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright import api
from maskwright.config import RedactionConfig
from maskwright.functions import text as fx
from maskwright.operators import replace, rules, spans


def found(spark, text, config=None):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["type"], r["text"]) for r in api.detect(df, config).orderBy("start").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("mail a.b@x.org.", [("EMAIL", "a.b@x.org")]),
        ("écrire à éa@b.co", [("EMAIL", "a@b.co")]),
        ("call (555) 123-4567 or +44 20 7946 0958", [("PHONE", "(555) 123-4567"), ("PHONE", "+44 20 7946 0958")]),
        ("SSN 123-45-6789, not 000-12-3456 or 666-12-3456", [("SSN", "123-45-6789")]),
        ("4111 1111 1111 1111 and 4111 1111 1111 1112", [("CREDIT_CARD", "4111 1111 1111 1111")]),
        ("GB82 WEST 1234 5698 7654 32 / GB82 WEST 1234 5698 7654 33", [("IBAN", "GB82 WEST 1234 5698 7654 32")]),
        ("10.0.0.255 and 256.1.1.1x", [("IP_ADDRESS", "10.0.0.255")]),
        ("fe80:0:0:0:1:2:3:4", [("IP_ADDRESS", "fe80:0:0:0:1:2:3:4")]),
        ("see https://x.org/a?b=1, www.y.org.", [("URL", "https://x.org/a?b=1"), ("URL", "www.y.org")]),
        ("Jan 5, 2024; 5th March 2024; 2024-01-05; 1/2/24", [("DATE", "Jan 5, 2024"), ("DATE", "5th March 2024"), ("DATE", "2024-01-05"), ("DATE", "1/2/24")]),
        ("12 Main Street, Apt 4 and P.O. Box 77", [("ADDRESS", "12 Main Street, Apt 4"), ("ADDRESS", "P.O. Box 77")]),
        ("CA 90210-1234", [("ZIP", "90210-1234")]),
        ("MRN: A12345, Account settings, Policy No. ZX-99", [("ID_NUMBER", "A12345"), ("ID_NUMBER", "ZX-99")]),
        ("", []),
        ("📞 a@b.co", [("EMAIL", "a@b.co")]),
    ],
)
def test_rules(spark, text, expected):
    assert found(spark, text) == expected


def test_offsets_are_exact(spark):
    text = "x@y.zz 📞 +1 (212) 555-1234, 10.0.0.1; x@y.zz é 4111-1111-1111-1111"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.inline(rules.detect_rules(F.col("text")))).collect()
    assert rows and all(text[r["start"] : r["end"]] == r["text"] for r in rows)


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert api.detect(df).count() == 0
    assert [r["text"] for r in api.redact(df).orderBy("doc_id").collect()] == [None, "", "x"]


def test_modes_and_lists(spark):
    df = spark.createDataFrame([(1, "Project Falcon: a@b.co, c@d.ee, A@B.CO. project falconry")], "doc_id long, text string")
    config = RedactionConfig(deny=("project falcon", " "), allow=("C@D.ee ",))
    assert api.redact(df, config=config).first()["text"] == "[CUSTOM_1]: [EMAIL_1], c@d.ee, [EMAIL_1]. project falconry"
    assert api.redact(df, config=RedactionConfig(mode="redact")).first()["text"] == "Project Falcon: [REDACTED], [REDACTED], [REDACTED]. project falconry"
    assert api.redact(df, config=RedactionConfig(mode="pseudonymize")).first()["text"].count("user1@example.com") == 2


def test_deny_list_has_unicode_edges(spark):
    assert found(spark, "José Joséé Jos", RedactionConfig(deny=("Jos",))) == [("CUSTOM", "Jos")]


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-{"manual": 3, "rule": 2, "ml": 1}[r[4]], r[0] - r[1], -r[5], r[6])):
        if all(r[0] >= k[1] or k[0] >= r[1] for k in kept):
            kept.append(r)
    return sorted(kept)


def test_resolution_in_rows_and_tables_equals_the_greedy_choice(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(40):
        for k in range(rng.randint(0, 25)):
            s = rng.randint(0, 60)
            rows.append((doc, s, s + rng.randint(1, 12), "X", "t", rng.choice(["manual", "rule", "ml"]), rng.choice([0.5, 0.9]), k))
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, type string, text string, source string, score double, ord long")
    want = {(d, *r) for d in range(40) for r in greedy([r[1:] for r in rows if r[0] == d])}
    assert {tuple(r) for r in spans.resolve_overlaps(df).collect()} == want
    packed = df.groupBy("doc_id").agg(F.collect_list(F.struct(*df.columns[1:])).alias("s"))
    assert {tuple(r) for r in packed.select("doc_id", F.inline(spans.resolve(F.col("s")))).collect()} == want


def test_redaction_and_back(spark):
    df = spark.createDataFrame([(1, "a@b.co x a@b.co y 10.0.0.1"), (2, "nothing")], "doc_id long, text string")
    active = api.detect(df)
    out = replace.apply_spans(df, active, "label")
    assert {r["text"] for r in out.collect()} == {"[EMAIL_1] x [EMAIL_1] y [IP_ADDRESS_1]", "nothing"}
    assert {r["text"] for r in api.redact(df).collect()} == {r["text"] for r in out.collect()}
    back = replace.reidentify(out, replace.reid_key(active))
    assert {r["text"] for r in back.collect()} == {r["text"] for r in df.collect()}
    assert replace.reid_key(active, "redact").count() == 0


def test_merge(spark):
    text = "J. Smith-Jones met Ann. Bob"
    pieces = [(0, 1), (3, 8), (9, 14), (19, 22), (24, 27)]
    df = spark.createDataFrame([(1, s, e, "PERSON", text[s:e], 0.5 + s / 100) for s, e in pieces], "doc_id long, start int, end int, type string, text string, score double")
    out = spans.merge_spans(df, spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [r["text"] for r in out] == ["J. Smith-Jones", "Ann", "Bob"]


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    assert [val(fx.column_label(F.lit(n))) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert tuple(val(fx.cell_address(F.lit("BC12")))) == (11, 54)
    assert val(fx.excel_serial_date(F.lit(45292.0), F.lit(False))) == "2024-01-01"
    assert val(fx.zero_pad(F.lit("123"), F.lit("00000"))) == "00123"
    assert val(fx.decode_x(F.lit("a_x000D_b"))) == "a\rb"
    assert val(fx.keeps_text(F.lit("12345678901234567890"))) is True
    cells = ["=1+1", "-5", "+1,000.5e3", "  @x", "\tabc", "", "-x"]
    assert [val(fx.neutralised(F.lit(c))) for c in cells] == ["'=1+1", "-5", "+1,000.5e3", "'  @x", "'\tabc", "", "'-x"]
    assert val(fx.normalise_caps(F.lit("MARIA O'BRIEN-LÓPEZ\tsmall Text\nABC"))) == "Maria O'Brien-López\tsmall Text\nABC"


def test_many_spans_and_matches_take_time_in_proportion(spark):
    import time

    rows = [(1, 3 * i, 3 * i + (4 if i % 5 == 0 else 3), "X", "t", "rule", 0.9, i) for i in range(50_000)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, type string, text string, source string, score double, ord long").coalesce(1)
    packed = df.groupBy("doc_id").agg(F.collect_list(F.struct(*df.columns[1:])).alias("s")).cache()
    text = spark.createDataFrame([(1, " ".join(f"w{i % 977}" for i in range(50_000)))], "doc_id long, text string")
    assert packed.count() == 1
    start = time.time()
    assert packed.select(F.inline(spans.resolve(F.col("s")))).count() == 40_000
    found = text.select(F.inline(rules.located(F.col("text"), r"\w+"))).agg(F.count("*"), F.max("start"), F.sum("start")).first()
    assert time.time() - start < 30  # seconds; 10 on an idle machine
    places = [0]
    for i in range(50_000 - 1):
        places.append(places[-1] + len(f"w{i % 977}") + 1)
    assert tuple(found) == (50_000, places[-1], sum(places))


def test_located_in_a_text_with_control_characters(spark):
    text = "\x01ab \x02 ab\x03x ab"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [tuple(r) for r in df.select(F.inline(rules.located(F.col("text"), "ab"))).collect()]
    assert got == [(1, "ab"), (6, "ab"), (11, "ab")]
    grouped = [tuple(r) for r in df.select(F.inline(rules.located(F.lit("CA 90210, NY 10001"), r"[A-Z]{2} (\d{5})", 1))).collect()]
    assert grouped == [(3, "90210"), (13, "10001")]


SPANS = "doc_id long, start int, end int, type string, text string, score double"


@pytest.mark.parametrize(
    "text, pieces, expected",
    [
        ("x" * 60, [(0, 50, "PERSON"), (10, 20, "ORG"), (40, 45, "ORG")], [(0, 50), (10, 20), (40, 45)]),
        ("Ann Lee", [(0, 3, "PERSON"), (4, 7, "PERSON")], [(0, 7)]),
        ("name– x", [(0, 5, "PERSON")], [(0, 4)]),
        ("@ann_", [(0, 5, "PERSON")], [(0, 5)]),
        ("3X. Smith", [(0, 2, "PERSON"), (4, 9, "PERSON")], [(0, 9)]),
        ("4J. Smith", [(1, 2, "PERSON"), (4, 9, "PERSON")], [(1, 9)]),
        ("AJ. Smith", [(0, 2, "PERSON"), (4, 9, "PERSON")], [(0, 2), (4, 9)]),
        ("12 - x", [(0, 4, "ID_NUMBER")], [(0, 2)]),
        ("a b", [(0, 1, "PERSON")], []),
    ],
)
def test_merge_follows_the_piece_before(spark, text, pieces, expected):
    df = spark.createDataFrame([(1, s, e, t, text[s:e], 0.5) for s, e, t in pieces], SPANS)
    out = spans.merge_spans(df, spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(r["start"], r["end"]) for r in out.orderBy("start").collect()] == expected


def test_scalars_of_spreadsheets_and_xml(spark):
    val = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert val(fx.excel_serial_date(F.lit(45292.5), F.lit(False))) == "2024-01-01 12:00:00"
    assert [val(fx.is_date_format(F.lit(n), F.lit(c))) for n, c in ((14, "x"), (0, "i"), (0, '"day"0'), (0, "[Red]0"), (0, "h:mm"), (23, "0"))] == [True, True, False, False, True, False]
    assert val(fx.escape_xml(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    xml = '<w:ins w:author="Ann" w:initials="A" w:date="d"/><w15:person w15:author="Ann" w15:userId="u"/><Company>X</Company><vt:lpwstr>secret</vt:lpwstr>'
    want = '<w:ins w:author="Redacted" w:initials="R" w:date="d"/><w15:person w15:author="Redacted" w15:userId=""/><Company></Company><vt:lpwstr></vt:lpwstr>'
    assert val(fx.scrub_office_xml(F.lit(xml))) == want
    assert [val(fx.rounded_score(F.lit(x))) for x in (0.94999998, 0.12345, 0.5)] == [0.95, 0.1235, 0.5]


def test_key_is_in_order_of_first_appearance(spark):
    df = spark.createDataFrame([(1, "10.0.0.1 a@b.co 10.0.0.2 a@b.co")], "doc_id long, text string")
    key = replace.reid_key(api.detect(df)).orderBy("position").collect()
    assert [(r["type"], r["original"]) for r in key] == [("IP_ADDRESS", "10.0.0.1"), ("EMAIL", "a@b.co"), ("IP_ADDRESS", "10.0.0.2")]


def test_finalize_reads_stored_candidates_again(spark):
    df = spark.createDataFrame([(1, "+44 20 7946 0958 and a@b.co")], "doc_id long, text string")
    stored = df.select("doc_id", F.inline(rules.detect_rules(F.col("text"))))
    assert {r["type"] for r in spans.finalize(stored, RedactionConfig()).collect()} == {"PHONE", "EMAIL"}
    assert {r["type"] for r in spans.finalize(stored, RedactionConfig(min_score=0.9)).collect()} == {"EMAIL"}
