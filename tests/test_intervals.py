"""Interval joins, running values over ranges, sweeps, numbering and merging, against brute-force versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskwright import api
from maskwright.config import RedactionConfig
from maskwright.functions import text as fx
from maskwright.operators import layout, metrics, replace, spans, tables
from maskwright.operators.intervals import Ranged, overlap_join

SPAN = "doc_id long, start int, end int, type string, text string, source string, score double, ord long"


def rows_made(df):
    """The most rows that any join or generator of the finished plan gave."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined() and re.search("Join|Generate", name):
            found.append(metric.get().value())
        inner = node.children() if not name.endswith("QueryStage") else None
        if inner is None:
            return walk(node.plan())
        for k in range(inner.size()):
            walk(inner.apply(k))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


def test_overlap_join_is_brute_force(spark):
    rng = random.Random(1)
    some = lambda n: [(rng.randrange(3), s, s + rng.choice([0, 1, 5, 40, 300, 5000])) for s in (rng.randrange(0, 20_000) for _ in range(n))]
    a, b = list(enumerate(some(300))), list(enumerate(some(300)))
    a += [(300, (0, 2**31 - 50, 2**31 - 1)), (301, (None, 0, 9))]
    b += [(300, (0, 0, 2**31 - 1)), (301, (None, 0, 9))]
    x = spark.createDataFrame([(i, *r) for i, r in a], "i int, d int, start int, end int")
    y = spark.createDataFrame([(i, *r) for i, r in b], "j int, d int, __s int, __e int")
    got = [(r["i"], r["j"]) for r in overlap_join(x, y, ["d"]).collect()]
    want = {(i, j) for i, (d, s, e) in a for j, (f, t, u) in b if d is not None and d == f and s < u and t < e}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_rows_follow_spans_and_hits(spark):
    """20,000 spans in one document, each over one of the other side: no row for each pair, nor for each character."""
    n = 20_000
    a = spark.range(n).select(F.lit(1).alias("d"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 30).alias("end"))
    b = spark.range(n).select(F.lit(1).alias("d"), (F.col("id") * 50 + 10).alias("__s"), (F.col("id") * 50 + 20).alias("__e"))
    pairs = overlap_join(a, b, ["d"])
    assert pairs.count() == n and rows_made(pairs) <= 12 * n
    long = spark.createDataFrame([(1, 0, 50 * n)], "d int, __s int, __e int")
    assert rows_made(overlap_join(a, long, ["d"])) <= 12 * n


def test_anti_overlap_and_runs(spark):
    rng = random.Random(3)
    some = [(rng.randrange(2), s, s + rng.randrange(0, 60), "X", "", "rule", 1.0, k) for k, s in enumerate(rng.randrange(0, 3000) for _ in range(120))]
    other = [(rng.randrange(2), s, s + rng.randrange(1, 30), "Y", "", "rule", 1.0, k) for k, s in enumerate(rng.randrange(0, 3000) for _ in range(60))]
    got = spans.without_overlap(spark.createDataFrame(some, SPAN), spark.createDataFrame(other, SPAN))
    assert sorted(r["ord"] for r in got.collect()) == sorted(a[-1] for a in some if not any(a[0] == b[0] and a[1] < b[2] and b[1] < a[2] for b in other))
    text = "".join(rng.choice("abcdef") for _ in range(2000))
    cuts = sorted(rng.sample(range(1, 2000), 80))
    runs = [(0, k, s, e, text[s:e]) for k, (s, e) in enumerate(zip([0, *cuts], [*cuts, 2000], strict=True))]
    found = [(0, s, s + 25, f"<{s}>") for s in range(5, 1950, 40)]
    done = tables.apply_to_runs(spark.createDataFrame(runs, "doc_id int, run_no int, start int, end int, text string"), spark.createDataFrame(found, "doc_id int, start int, end int, new string"))
    want, at = "", 0
    for _, s, e, new in found:
        want, at = want + text[at:s] + new, e
    assert "".join(r["text"] for r in done.orderBy("run_no").collect()) == want + text[at:]


@pytest.fixture(scope="module")
def crowded():
    """Spans of one large document and of small ones, with ties and repeats."""
    rng = random.Random(9)
    out = []
    for k in range(3000):
        doc = rng.choice([7, None]) if rng.random() < 0.9 else rng.randrange(20)
        s = rng.randrange(0, 9000)
        e = s + rng.choice([1, 2, 4, 9, 30])
        out.append((doc, s, e, rng.choice(["EMAIL", "PHONE", "DATE"]), f"Value {rng.randrange(400)}", rng.choice(["rule", "ml", "manual"]), rng.choice([0.5, 0.9]), k))
    return out


@pytest.mark.parametrize("parts", [1, 20])
def test_one_document_over_many_partitions(spark, crowded, parts):
    df = spark.createDataFrame(crowded, SPAN)
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=lambda r: (r[0] is not None, *r[0 if r[0] is not None else 1 :]))
    assert key(spans.resolve_overlaps_in_ranges(df, parts=parts)) == key(spans.resolve_overlaps(df))
    columns = ["doc_id", "type", "value", "n"]  # of two texts of a value at one place either may be the first
    assert key(replace.label_map_in_ranges(df, parts=parts).select(columns)) == key(replace.label_map(df).select(columns))


def test_running_values(spark, crowded):
    df = spark.createDataFrame(crowded, SPAN)
    ranged = Ranged(df, ["doc_id"], [F.col("start"), F.col("ord")], 13)
    assert ranged.rows.select("__part").distinct().count() > 5
    rows = ranged.sum_before(ranged.greatest_before(ranged.rows, "top", F.col("end")), "n", F.lit(1)).collect()
    before = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["start"], r["ord"])):
        ends = before.setdefault(r["doc_id"], [])
        assert r["n"] == len(ends) and r["top"] == (max(ends) if ends else None)
        ends.append(r["end"])
    none = Ranged(df.where("false"), ["doc_id"], [F.col("start")])
    assert none.sum_before(none.rows, "n", F.lit(1)).count() == 0


def test_sweep_counts_characters(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab \n\té😀") for _ in range(2000 if i == 9 else rng.randrange(0, 80)))) for i in range(60)]
    some = lambda: [(i, s, min(len(t), s + rng.randrange(0, 12))) for i, t in texts for s in (rng.randrange(0, len(t) + 1) for _ in range(90 if i == 9 else rng.randrange(4)))]
    gold, found = some(), some()
    gold += gold[:5]
    shape = "doc_id int, start int, end int"
    df = metrics.eval_chars(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(gold, shape), spark.createDataFrame(found, shape))
    want = {}
    for i, t in texts:
        g, p = ({k for d, s, e in x if d == i for k in range(s, e) if not re.match(r"\s", t[k])} for x in (gold, found))
        if g or p:
            want[i] = (len(g), len(g & p), len(p))
    assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == want
    assert "Generate" not in df._jdf.queryExecution().toString()  # no row for a character or an event


def test_name_coverage(spark):
    cases = [(1, "Ann Lee and J. Roe", ["Ann Lee", "J. Roe", "Max", "Ann Lee", ". "]), (2, "Zoe", None), (3, "Bo Li", ["Bo Li"])]
    found = [(1, 0, 3, "PERSON", 0.9), (1, 4, 7, "PERSON", 0.9), (1, 12, 13, "PERSON", 0.9), (1, 15, 17, "PERSON", 0.9), (1, 17, 18, "PERSON", 0.2), (1, 17, 18, "ORG", 0.9), (3, 0, 99, "PERSON", 0.5)]
    df = metrics.name_coverage(spark.createDataFrame(cases, "case_id int, text string, names array<string>"), spark.createDataFrame(found, "case_id int, start int, end int, type string, score double"))
    assert {(r["case_id"], r["name"]): r["covered"] for r in df.collect()} == {(1, "Ann Lee"): True, (1, "J. Roe"): False, (1, "Max"): False, (3, "Bo Li"): True}


def test_numbering_in_the_row(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 300):
        some = [(10 * k, 10 * k + 3, rng.choice(["EMAIL", "PHONE", "DATE"]), rng.choice(["A  b", "a b", "c", f"v{rng.randrange(90)}"]), "rule", 1.0, k) for k in range(n)]
        df = spark.createDataFrame([(some,)], f"s array<struct<{SPAN.removeprefix('doc_id long, ').replace(' ', ':').replace(',:', ',')}>>")
        got = [(x["s"]["ord"], x["n"]) for x in df.select(replace.numbered(F.col("s")).alias("n")).first()["n"]]
        seen, want = {}, []
        for x in some:
            values = seen.setdefault(x[2], {})
            want.append((x[6], values.setdefault(" ".join(x[3].lower().split()), len(values) + 1)))
        assert got == want


def test_many_values_in_one_text_take_their_time_once(spark):
    """Replacing four times the values takes hardly more than four times as long; it was sixteen."""
    took = []
    for n in (2_000, 8_000):
        df = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('u', i, '@mail.example.org and')), ' ')").alias("text"))
        done = api.redact(df, config=RedactionConfig())
        done.first()
        start = time.time()
        out = done.first()["text"]
        took.append(time.time() - start)
        assert out.startswith("[EMAIL_1] and [EMAIL_2] and") and out.endswith(f"[EMAIL_{n}] and")
    assert took[1] < 8 * took[0] + 2


def naive_merge(pieces, text):
    """The merging rule, piece by piece."""
    out = []
    for s, e, kind, score in sorted(pieces):
        if out and out[-1][2] == kind:
            reach = out[-1][1]
            gap = text[reach:s]
            if s <= reach or (re.fullmatch(r"[ \-./:@_]{1,2}", gap) and (gap != ". " or re.search(r"(?:^|[^a-zA-Zé])[a-zA-Zé]$", text[max(0, reach - 2) : reach]))):
                out[-1] = (out[-1][0], max(reach, e), kind, max(out[-1][3], score))
                continue
        out.append((s, e, kind, score))
    marks = " -–—.,:;/\n\t"
    cut = [(s + len(text[s:e]) - len(text[s:e].lstrip(marks)), text[s:e].strip(marks), kind, score) for s, e, kind, score in out]
    return sorted((s, s + len(t), kind, t, score) for s, t, kind, score in cut if len(t) >= 2)


def test_merging_is_the_rule(spark):
    rng = random.Random(6)
    texts, pieces = [], []
    for i in range(40):
        t = "".join(rng.choice(["a", "bc", "é", " ", ". ", "-", ".", "@", "😀", "J"]) for _ in range(rng.choice([5, 60, 900])))
        texts.append((i, t))
        at = 0
        while at < len(t) - 4:
            at += rng.randrange(0, 4)
            e = min(len(t), at + rng.randrange(1, 5))
            pieces.append((i, at, e, rng.choice(["PERSON", "PERSON", "ORG"]), t[at:e], rng.choice([0.5, 0.8])))
            at = e
    df = spans.merge_spans(spark.createDataFrame(pieces, "doc_id int, start int, end int, type string, text string, score double"), spark.createDataFrame(texts, "doc_id int, text string"))
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["type"], r["text"], r["score"]))
    for i, t in texts:
        assert sorted(got.get(i, [])) == naive_merge([(s, e, k, x) for d, s, e, k, _, x in pieces if d == i], t), i


def test_rectangles_of_runs_are_those_of_characters(spark):
    rng = random.Random(7)
    runs, at = [], 0
    for k in range(30):
        t = "x" * rng.randrange(1, 9)
        runs.append((1, at, 1 + k // 15, 10.0 * (k % 3), 20.0 * (k // 3), 7.0 * len(t), 12.0, t, [rng.random() + 0.1 for _ in t] if k % 2 else None))
        at += len(t) + k % 2
    df = spark.createDataFrame(runs, "doc_id int, start int, page int, x double, y double, w double, h double, text string, weights array<double>")
    found = spark.createDataFrame([(1, s, s + rng.randrange(1, 40)) for s in range(0, at, 7)], "doc_id int, start int, end int")
    key = lambda d: sorted(tuple(round(v, 9) for v in r) for r in d.collect())
    assert key(layout.rectangles_of_runs(found, df)) == key(layout.rectangles(found, layout.char_boxes(df)))


@pytest.mark.parametrize(
    ("serial", "date1904", "text"),
    [
        (45292.1234567, False, "2024-01-01 02:57:46"), (45292.999999, False, "2024-01-01 23:59:59"), (45292.000001, False, "2024-01-01 00:00:00"), (45292.0, False, "2024-01-01"),
        (59.0, False, "1900-02-28"), (60.0, False, "1900-02-28"), (61.0, False, "1900-03-01"), (59.5, False, "1900-02-28 12:00:00"), (1.0, False, "1900-01-01"), (0.0, True, "1904-01-01"), (45292.9999999999, False, "2024-01-02 00:00:00"),
    ],
)
def test_serial_dates_are_cut_to_seconds(spark, serial, date1904, text):
    assert spark.range(1).select(fx.excel_serial_date(F.lit(serial), F.lit(date1904))).first()[0] == text
