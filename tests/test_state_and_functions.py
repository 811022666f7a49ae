"""Undo and redo, keyed stream state, table functions, custom rules and observed statistics."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright import api
from maskwright.config import TYPES, RedactionConfig
from maskwright.operators import review, tables
from maskwright.operators import table_functions as tf
from maskwright.streaming import detect as streaming

LOG = "doc_id long, seq int, kind string, key string, value boolean"


# Undo and redo -------------------------------------------------------------------------------------


def by_stacks(log, steps=20):
    """The rows that are in force, by the stacks of one document after another."""
    kept = []
    for doc in {r[0] for r in log if r[0] is not None}:
        past, future, fixed = [], [], []
        own = [r for r in log if r[0] == doc]
        for seq in sorted({r[1] for r in own}):
            kinds = {r[2] for r in own if r[1] == seq}
            if "redo" in kinds:
                if future:
                    past.append(future.pop())
            elif "undo" in kinds:
                if past:
                    future.append(past.pop())
            else:
                past.append(seq)
                future = []
            if len(past) > steps:
                fixed.append(past.pop(0))
        kept += [r for r in own if r[1] in {*fixed, *past} and r[2] not in ("undo", "redo")]
    return kept


@pytest.mark.parametrize("steps", [20, 3])
def test_undo_and_redo_are_two_stacks(spark, steps):
    rng = random.Random(steps)
    log = []
    for doc in range(40):
        for seq in range(rng.choice([0, 1, 9, 70, 200])):
            kind = rng.choices(["value", "occurrence", "undo", "redo"], [4, 2, rng.choice([1, 6]), 2])[0]
            log += [(doc, seq, kind, f"k{rng.randrange(9)}", rng.random() < 0.5) for _ in range(1 if kind in ("undo", "redo") else rng.choice([1, 1, 3]))]
    log += [(None, 1, "value", "k", True)]
    df = spark.createDataFrame(log, LOG)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(review.in_force(df.repartition(5), steps=steps).collect()) == key(by_stacks(log, steps))
    assert review.in_force(df.where("false")).count() == 0


def test_undo_of_nothing_and_forgotten_redo(spark):
    rows = [(1, k, kind, f"v{k}", True) for k, kind in enumerate(["undo", "value", "undo", "undo", "redo", "value", "undo", "value", "redo"])]
    got = review.in_force(spark.createDataFrame(rows, LOG)).orderBy("seq").collect()
    assert [r["key"] for r in got] == ["v1", "v7"]  # the redo after v7 has nothing left to bring back
    state = review.value_states(review.in_force(spark.createDataFrame(rows[:4], LOG)))
    assert state.count() == 0


# Streams -------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, text string"


class Conversations:
    """A folder that a stream reads, run after run, with one checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.new = spark, folder, options, 0
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKSDB)
        (folder / "in").mkdir()

    def add(self, *rows):
        self.new += len(rows)
        self.spark.createDataFrame(list(rows), TURNS).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self):
        stream = self.spark.readStream.schema(TURNS).parquet(str(self.folder / "in"))
        done = streaming.labelled_stream(stream, **self.options).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "cp"))
        q = done.outputMode("append").trigger(processingTime="1 second").start()  # with timers it never ends by itself
        try:
            until = time.time() + 60
            while sum(p["numInputRows"] for p in q.recentProgress) < self.new:
                assert time.time() < until and q.exception() is None
                time.sleep(0.2)
        finally:
            q.stop()
        self.new = 0
        return {(r["conv_id"], r["turn"]): r["text"] for r in self.spark.read.parquet(str(self.folder / "out")).collect()}


def test_numbers_outlive_a_restart(spark, tmp_path):
    c = Conversations(spark, tmp_path)
    c.add((1, 0, "a@b.co"), (2, 0, "c@d.ee 10.0.0.1"))
    assert c.run() == {(1, 0): "[EMAIL_1]", (2, 0): "[EMAIL_1] [IP_ADDRESS_1]"}
    c.add((1, 2, "A@B.co"), (1, 1, "c@d.ee and a@b.co"), (2, 1, "10.0.0.2, 10.0.0.1"))
    got = c.run()  # a new query over the same checkpoint
    assert (got[1, 1], got[1, 2], got[2, 1]) == ("[EMAIL_2] and [EMAIL_1]", "[EMAIL_1]", "[IP_ADDRESS_2], [IP_ADDRESS_1]")
    c.add((1, 3, None), (1, 4, ""))
    got = c.run()
    assert got[1, 3] is None and got[1, 4] == ""


def test_idle_conversations_are_forgotten(spark, tmp_path):
    c = Conversations(spark, tmp_path, idle_ms=4_000)
    c.add((1, 0, "a@b.co"), (2, 0, "x@y.zz"))
    c.run()
    time.sleep(6)
    c.add((2, 1, "new@y.zz"))  # its batch lets the timers of both fire
    c.run()
    c.add((1, 1, "c@d.ee"))
    got = c.run()
    assert got[1, 1] == "[EMAIL_1]" and got[1, 0] == "[EMAIL_1]"


def test_single_values_expire(spark, tmp_path):
    c = Conversations(spark, tmp_path, ttl_ms=4_000)
    c.add((1, 0, "a@b.co c@d.ee"))
    assert c.run()[1, 0] == "[EMAIL_1] [EMAIL_2]"
    time.sleep(6)
    c.add((1, 1, "c@d.ee"))
    assert c.run()[1, 1] == "[EMAIL_1]"  # all that was known is gone


# Table functions -----------------------------------------------------------------------------------

RULES = [
    ("ID_NUMBER", r"\bTK-(\d{4})", 0.8, 1, "i", None),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 0.95, 0, None, "luhn"),
    ("CUSTOM", r"\bproject\s+[a-z]+", 0.7, 0, "i", None),
]
SHAPE = "type string, pattern string, score double, group int, flags string, valid string"


def test_rules_of_a_table_in_sql_and_as_columns(spark):
    tf.register(spark)
    texts = [(1, "tk-1234, TK-99999. 4111 1111 1111 1111; 4111 1111 1111 1112 Project  Falcon. éTK-7777 projet"), (2, None), (3, ""), (4, "nothing here")]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(RULES, SHAPE)
    beside = docs.crossJoin(F.broadcast(tf.one_row(table)))  # one row
    in_sql = spark.sql("SELECT * FROM find_by_rules(TABLE({d}) PARTITION BY doc_id)", d=beside)
    assert dict(in_sql.dtypes) == {"doc_id": "bigint", "start": "int", "end": "int", "type": "string", "text": "string", "score": "double"}
    found = api.rules_spans(docs, tf.rules_of(table)).select(*in_sql.columns)
    key = lambda d: sorted(map(tuple, d.collect()))
    t = texts[0][1]
    place = lambda s, kind, score: (1, t.index(s), t.index(s) + len(s), kind, s, score)
    want = [place("1234", "ID_NUMBER", 0.8), place("9999", "ID_NUMBER", 0.8), place("7777", "ID_NUMBER", 0.8), place("4111 1111 1111 1111", "CREDIT_CARD", 0.95), place("Project  Falcon", "CUSTOM", 0.7)]
    assert key(in_sql) == key(found) == sorted(want)
    assert spark.sql("SELECT * FROM find_by_rules(TABLE({d}))", d=beside.where("false")).count() == 0


@pytest.mark.parametrize("bad", [("X", None, 1.0, 0, None, None), ("X", "a", 1.0, 0, "q", None), ("X", "a", 1.0, 0, None, "md5")])
def test_rules_that_cannot_be_are_refused(spark, bad):
    with pytest.raises(ValueError, match="rule|flags|check"):
        tf.rules_of(spark.createDataFrame([bad], SHAPE))


def test_a_table_function_plans_its_schema(spark):
    tf.register(spark)
    with pytest.raises(Exception, match="columns"):
        spark.sql("SELECT * FROM find_by_rules(TABLE(SELECT 1 AS doc_id))").schema
    text_ids = spark.sql("SELECT * FROM find_by_rules(TABLE(SELECT 'a' AS doc_id, 'x' AS text, array(named_struct('type', 'CUSTOM', 'pattern', 'x', 'score', 1D, 'group', 0, 'flags', '', 'valid', '')) AS rules))")
    assert dict(text_ids.dtypes)["doc_id"] == "string" and text_ids.first()["text"] == "x"


def test_a_model_as_a_table_function(spark):
    def load():
        return lambda texts: [[(t.index("Ann"), t.index("Ann") + 3, "PERSON", 0.9)] if "Ann" in t else [] for t in texts]

    spark.udtf.register("names_of", tf.annotator(load))
    docs = spark.createDataFrame([(1, "so Ann said"), (2, None), (3, "none")], "doc_id int, text string")
    assert [tuple(r) for r in spark.sql("SELECT * FROM names_of(TABLE({d}))", d=docs).collect()] == [(1, 3, 6, "PERSON", "Ann", 0.9)]


# Observed statistics -------------------------------------------------------------------------------


def test_observed_statistics_are_those_of_a_second_pass(spark):
    rng = random.Random(3)
    cells = [(d, 0, r, c, "head", rng.choice(["", " ", "a@b.co", "note one", "note two", "--", "x"])) for d in range(3) for r in range(30) for c in range(3)]
    df = spark.createDataFrame(cells, "doc_id long, sheet int, row int, col int, context string, value string")
    covered = df.where("value = 'a@b.co'").select(tables.AT)
    plan, stats = tables.observed_scan_plan(df, covered)
    old = tables.scan_plan(df, covered)
    assert sorted(map(tuple, plan.select(old.columns).collect())) == sorted(map(tuple, old.collect()))
    sums = tables.scan_stats(df, covered, old).agg(*(F.sum(c).alias(c) for c in ("cells", "unique_values", "reused_cells", "rule_covered_cells"))).first()
    assert stats == sums.asDict()
    assert tables.observed_scan_plan(df.where("false"), covered)[1] == dict.fromkeys(stats, 0)


def test_custom_rules_in_the_row(spark):
    """Rules of a table beside the built-in ones, resolved together."""
    own = tf.rules_of(spark.createDataFrame(RULES, SHAPE))
    docs = spark.createDataFrame([(1, "Project Falcon, tk-1234, a@b.co")], "doc_id long, text string")
    found = {(r["type"], r["text"]) for r in api.detect(docs, RedactionConfig(), rules=own).collect()}
    assert found == {("CUSTOM", "Project Falcon"), ("ID_NUMBER", "1234")}
    both = {(r["type"], r["text"]) for r in api.detect(docs, RedactionConfig(), rules=api.RULES + own).collect()}
    assert both == found | {("EMAIL", "a@b.co")}


def test_preview_of_one_document_with_its_choices(spark):
    docs = spark.createDataFrame([(1, "a@b.co, 10.0.0.1 and Falcon; a@b.co"), (2, "a@b.co")], "doc_id long, text string")
    found = api.detect(docs, RedactionConfig(enabled=frozenset(TYPES)))
    log = [(1, 1, "value", "EMAIL:a@b.co", True), (1, 2, "value", "IP_ADDRESS:10.0.0.1", True), (1, 3, "undo", None, None), (2, 1, "value", "EMAIL:a@b.co", False)]
    manual = [(1, 21, 27, "CUSTOM", "Falcon", "manual", 1.0, 0)]
    decided, own = spark.createDataFrame(log, LOG), spark.createDataFrame(manual, "doc_id long, start int, end int, type string, text string, source string, score double, ord long")
    assert api.preview(docs, found, 1, decided, own).first()["text"] == "a@b.co, [IP_ADDRESS_1] and [CUSTOM_1]; a@b.co"
    assert api.preview(docs, found, 2).first()["text"] == "[EMAIL_1]" and api.preview(docs, found, 3).count() == 0
    assert api.preview(docs, found, 1, config=RedactionConfig(enabled=frozenset({"EMAIL"}))).first()["text"] == "[EMAIL_1], 10.0.0.1 and Falcon; [EMAIL_1]"
