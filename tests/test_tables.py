"""Tables, propagation, review, model, layout, files and streams, on examples."""

import pytest
from pyspark.sql import functions as F

from maskwright import api
from maskwright.config import RedactionConfig
from maskwright.operators import layout, metrics, model, propagate, replace, review, tables
from maskwright.sources import readers, writers
from maskwright.streaming import detect as streaming


@pytest.mark.parametrize("header, type_", [("Email Address", "EMAIL"), ("firstName", "PERSON"), ("Date of Birth", "DATE"), ("user_name", "ID_NUMBER"), ("Company", "ORG"), ("street", "ADDRESS"), ("Postal Code", "ZIP"), ("Amount", None), ("c_name", None), ("", None)])
def test_headers(spark, header, type_):
    assert spark.range(1).select(tables.classify_column(F.lit(header)).alias("t")).first()["t"] == type_


def cells(spark, rows):
    return spark.createDataFrame([(1, 0, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "doc_id long, sheet int, row int, col int, value string")


def test_header_detection(spark):
    has = lambda rows: tables.detect_header(cells(spark, rows)).first()["has_header"]
    assert has([["Email", "x"], ["a", "b"]])
    assert has([["Day", "Description", "Amount"], ["1", "x", "2.50"]])
    assert not has([["Ann", "Bob"], ["Eve", "Dan"]])
    assert not has([["Ann", "Ann"], ["1", "2"]])


def test_table_redaction(spark):
    c = cells(spark, [["Name", "Notes"], ["Ann Lee", "mail a@b.co"], ["Bob", "a@b.co, Ann Lee"], ["Ann Lee", ""]])
    headers = tables.detect_header(c)
    ctx, types = tables.with_context(c, headers), tables.column_types(c, headers)
    config = RedactionConfig()
    live = tables.resolve_cells(tables.cell_spans(ctx, config).unionByName(tables.structural_spans(ctx, types)), config)
    out = {(r["row"], r["col"]): r["value"] for r in tables.redact_cells(ctx, live).collect()}
    assert [out[1, 0], out[2, 0], out[3, 0]] == ["[PERSON_1]", "[PERSON_2]", "[PERSON_1]"]
    assert out[1, 1] == "mail [EMAIL_1]" and out[2, 1] == "[EMAIL_1], Ann Lee" and out[0, 0] == "Name" and out[3, 1] == ""
    covered = tables.covered_cells(ctx, tables.structural_spans(ctx, types))
    plan = tables.scan_plan(ctx, covered)
    assert plan.count() == 4  # two headers, two notes
    assert tables.scan_stats(ctx, covered, plan).first().asDict() == {"doc_id": 1, "cells": 7, "unique_values": 4, "reused_cells": 0, "rule_covered_cells": 3}


def test_propagation(spark):
    text = "Maria Gonzalez met Ann. Gonzalez and maria left; Gonzalezes stayed."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 14, "PERSON", "Maria Gonzalez", "ml", 0.99, 0)], "doc_id long, start int, end int, type string, text string, source string, score double, ord long")
    out = propagate.with_propagation(docs, found).orderBy("start", "end").collect()
    assert [(r["start"], r["text"]) for r in out] == [(0, "Maria"), (0, "Maria Gonzalez"), (6, "Gonzalez"), (24, "Gonzalez")]
    assert round(out[-1]["score"], 4) == 0.9405


def test_review(spark):
    docs = spark.createDataFrame([(1, "a@b.co and a@b.co or c@d.ee")], "doc_id long, text string")
    found = api.detect(docs)
    log = spark.createDataFrame([(1, 1, "occurrence", "0:6", True), (1, 2, "value", "EMAIL:a@b.co", True), (1, 3, "occurrence", "11:17", True)], "doc_id long, seq int, kind string, key string, value boolean")
    state = {r["start"]: r["active"] for r in review.active_spans(found, log).collect()}
    assert state == {0: False, 11: True, 21: True}
    early = {r["start"]: r["active"] for r in review.active_spans(found, review.as_of(log, 1)).collect()}
    assert early == {0: False, 11: True, 21: True}


def test_chunks_cover_the_text():
    for text in ("word " * 700, "x" * 5000, "A: 9 | " * 160 + "Ann Lee", "\n".join(["line. " * 9] * 60), "😀" * 3000):
        got = model.chunk(text, 300)
        end = 0
        for offset, c in got:
            assert text[offset : offset + len(c)] == c and len(c) <= 1200 and offset <= end and model.count_words(c) <= 300
            end = offset + len(c)
        assert end == len(text)


def test_model_failure_keeps_the_rules(spark):
    docs = spark.createDataFrame([(1, "Ann a@b.co"), (2, "bad a@b.co")], "doc_id long, text string")

    def load():
        def run(texts):
            if "bad" in texts[0]:
                raise ValueError("no")
            return [[(0, 3, "PERSON", 0.9)]]

        return run

    found, states = model.annotate(docs, load)
    assert {r["doc_id"]: r["ml_state"] for r in states.collect()} == {1: "done", 2: "failed"}
    all_ = api.detect(docs, ner=lambda df: found)
    assert {(r["doc_id"], r["type"]) for r in all_.collect()} == {(1, "PERSON"), (1, "EMAIL"), (2, "EMAIL")}


def test_alignment_and_widening(spark):
    df = spark.createDataFrame([("Hello O'Brien", ["hel", "##lo", "o", "zzz"])], "t string, k array<string>")
    assert [tuple(x) if x else None for x in df.select(model.align_tokens(F.col("t"), F.col("k")).alias("a")).first()["a"]] == [(0, 3), (3, 5), (6, 7), None]
    assert tuple(df.select(model.widen(F.col("t"), F.lit(2), F.lit(6)).alias("w")).first()["w"]) == (0, 7)  # grown over letters on both sides first, then trimmed


def test_rectangles(spark):
    boxes = spark.createDataFrame([(1, i, 1, 10.0 * i, 0.0, 10.0, 12.0) for i in range(5)] + [(1, i, 1, 10.0 * (i - 5), 20.0, 10.0, 12.0) for i in range(5, 8)], "doc_id long, idx int, page int, x double, y double, w double, h double")
    out = layout.rectangles(spark.createDataFrame([(1, 3, 7)], "doc_id long, start int, end int"), boxes).orderBy("y").collect()
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in out] == [(27.0, -3.0, 26.0, 18.0), (-3.0, 17.0, 26.0, 18.0)]


def test_symbols(spark):
    rows = [(1, 1, 0, 0, 0, 0, "H"), (1, 1, 0, 0, 0, 1, "i"), (1, 1, 0, 0, 1, 0, "a"), (1, 1, 0, 1, 0, 0, "b"), (1, 1, 1, 0, 0, 0, "c")]
    out = layout.symbols_text(spark.createDataFrame(rows, "doc_id long, page int, paragraph int, line int, word int, pos int, text string")).orderBy("idx").collect()
    assert "".join(r["part"] for r in out) == "Hi a\nb\n\nc" and [r["idx"] for r in out] == [0, 1, 3, 5, 8]


def test_metrics(spark):
    s = "doc_id long, start int, end int, type string"
    gold, got = spark.createDataFrame([(1, 0, 3, "A"), (1, 5, 9, "B")], s), spark.createDataFrame([(1, 0, 3, "A"), (1, 5, 8, "B")], s)
    rows = {r["type"]: r for r in metrics.eval_spans(gold, got).collect()}
    assert (rows["A"]["f1"], rows["B"]["f1"], rows[None]["f1"]) == (1.0, 0.0, 0.5)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id;note\n007;"x\ny"\n\n8;"say ""hi"""\n'.encode())
    (tmp_path / "b.csv").write_bytes("name,zip\nRené,01234\n".encode("windows-1252"))
    (tmp_path / "c.tsv").write_bytes(b"\xff\xfe" + "a\tb\n1\t2\n".encode("utf-16-le"))
    (tmp_path / "d.csv").write_bytes(b'a,"b\n')
    got, rejects = readers.read_tables(spark, str(tmp_path))
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"][-5:], {})[r["row"], r["col"]] = r["value"]
    assert rows["a.csv"] == {(0, 0): "id", (0, 1): "note", (1, 0): "007", (1, 1): "x\ny", (2, 0): "", (3, 0): "8", (3, 1): 'say "hi"'}
    assert rows["b.csv"][1, 0] == "René" and rows["b.csv"][1, 1] == "01234" and rows["c.tsv"][1, 1] == "2"
    assert [r["path"][-5:] for r in rejects.collect()] == ["d.csv"]
    out = str(tmp_path / "out")
    writers.write_csv(cells(spark, [["a", "=1"], ['say "x"', "b,c"]]), out, newline="\r\n", bom=True)
    assert "".join(r["value"] for r in spark.read.text(out, wholetext=True).collect()) == '﻿a,\'=1\r\n"say ""x""","b,c"\r\n'
    kinds = {r["path"]: (r["kind"], r["reason"] is None) for r in readers.dispatch(spark.createDataFrame([("x/a.TXT",), ("b.xls",), ("c.csv",)], "path string")).collect()}
    assert kinds == {"x/a.TXT": ("text", True), "b.xls": (None, False), "c.csv": ("table", True)}


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.ROCKSDB)
    rows = [(1, 0, "a@b.co"), (1, 1, "c@d.ee and a@b.co"), (2, 0, "c@d.ee")]
    schema = "conv_id long, turn long, text string"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = streaming.labelled_stream(stream).writeStream.format("memory").queryName("labelled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("labelled").collect()} == {(1, 0, "[EMAIL_1]"), (1, 1, "[EMAIL_2] and [EMAIL_1]"), (2, 0, "[EMAIL_1]")}
    q = streaming.redact_stream(stream).writeStream.format("memory").queryName("redacted").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["text"] for r in spark.table("redacted").collect()} == {"[EMAIL_1]", "[EMAIL_1] and [EMAIL_2]"}


def test_propagation_of_several_names(spark):
    text = "José said José. Joséé left. A.B. Labs met A.B. Labs. Ana Ana Ana; Zyra met Zyra."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    hit = lambda t, kind: (1, text.index(t), text.index(t) + len(t), kind, t, "ml", 0.99, text.index(t))
    found = [hit("José", "PERSON"), hit("A.B. Labs", "ORG"), hit("Ana Ana", "PERSON"), hit("Zyra", "PERSON")]
    df = spark.createDataFrame(found, "doc_id long, start int, end int, type string, text string, source string, score double, ord long")
    out = {(r["start"], r["text"]) for r in propagate.with_propagation(docs, df).where("score < 0.99").collect()}
    assert out == {(10, "José"), (42, "A.B. Labs"), (53, "Ana"), (57, "Ana"), (61, "Ana"), (57, "Ana Ana"), (75, "Zyra")}


def test_occurrences_of_a_list_meet_by_words(spark):
    docs = spark.createDataFrame([(1, "Falcon and FALCON nest, falconry; C++ c++"), (2, "none"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("falcon nest",), (" Falcon ",), ("c++",), ("++",)], "term string")
    got = {(r["doc_id"], r["start"], r["text"]) for r in propagate.occurrences(docs, terms).collect()}
    assert got == {(1, 0, "Falcon"), (1, 11, "FALCON"), (1, 11, "FALCON nest"), (1, 34, "C++"), (1, 38, "c++")}


def test_chunks_break_where_they_should():
    text = "a" * 700 + "\n" + "b" * 300 + ". " + "c" * 400
    first = model.chunk(text, 10_000)[0][1]
    assert len(first) == 1003 and first.endswith(". ")  # one character after the last mark, which is the space
    assert model.chunk("x" * 1300, 10_000)[0][1] == "x" * 1200
    assert [len(c) for _, c in model.chunk("word " * 40, 10)][0] == 45  # 200 characters, 40 tokens: 200 * 10 / 40 * 0.9
    with pytest.raises(ValueError):
        model.chunk("xy", 1, lambda t: 2)


def test_samples_are_packed(spark):
    assert model.packed(["a" * 500, "b" * 500, "c" * 300, "d" * 2000, "e"], 1200) == [[0, 1], [2], [3], [4]]
    df = spark.createDataFrame([(k, "Name", v) for k, v in enumerate(["Ann Lee", "no one", "Bob x Ann"])], "id int, context string, value string")
    calls = model.annotate_samples(df.coalesce(1), lambda: model.dictionary_annotator({"Ann": "PERSON", "Name": "ORG"}))
    assert {(r["id"], r["start"], r["end"], r["type"]) for r in calls.collect()} == {(0, 0, 3, "PERSON"), (2, 6, 9, "PERSON")}


def test_annotator_gets_batches_and_runs_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string").coalesce(1)
    log = str(tmp_path / "calls")

    def load():
        def run(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return [[] for _ in texts]

        return run

    found, states = model.annotate(docs, load, batch=4)
    assert found.count() == 0 and states.count() == 10
    assert open(log).read().split() == ["4", "4", "2"]


def test_number_columns(spark):
    items = [(1, 1, 0.0, 10.0, 30.0, 10.0, "3,481"), (1, 1, 30.5, 10.0, 10.0, 10.0, "$5"), (1, 2, 0.0, 10.0, 30.0, 10.0, "12"), (1, 2, 20.0, 10.0, 10.0, 10.0, "34"), (1, 3, 0.0, 10.0, 30.0, 10.0, "12"), (1, 3, 30.5, 10.0, 5.0, 10.0, "x")]
    df = spark.createDataFrame(items, "doc_id long, page int, x double, y double, w double, h double, text string")
    assert {r["page"]: r["text"] for r in layout.page_text(df).collect()} == {1: "3,481 $5\n", 2: "1234\n", 3: "12x\n"}


def test_weighted_boxes_and_areas(spark):
    runs = spark.createDataFrame([(1, 5, 1, 10.0, 0.0, 60.0, 12.0, "abc", [1.0, 2.0, 3.0]), (1, 0, 1, 0.0, 0.0, 10.0, 12.0, "xy", None)], "doc_id long, start int, page int, x double, y double, w double, h double, text string, weights array<double>")
    got = {r["idx"]: (r["x"], r["w"]) for r in layout.char_boxes(runs).collect()}
    assert got == {5: (10.0, 10.0), 6: (20.0, 20.0), 7: (40.0, 30.0), 0: (0.0, 5.0), 1: (5.0, 5.0)}
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, x double, y double, w double, h double")
    assert layout.with_areas(boxes, boxes.unionByName(boxes.withColumn("page", F.lit(2)))).count() == 2


def test_stale_exports_are_rejected(spark):
    docs = spark.createDataFrame([(1, "a@b.co c@d.ee"), (2, "a@b.co"), (3, "10.0.0.1")], "doc_id long, text string")
    active = api.detect(docs)
    exports = review.review_fingerprints(active)
    today = review.review_fingerprints(active.where("not (doc_id = 1 and start = 0) and doc_id <> 3"))
    fresh, rejected = review.current_exports(exports, today)
    assert [r["doc_id"] for r in fresh.collect()] == [2]
    assert {r["doc_id"]: r["reason"] for r in rejected.collect()} == {1: "review choices changed during the export", 3: "the document is gone"}


def test_control_characters_and_malformed_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'x,"a\x02b"\n"\x05",y\n')
    (tmp_path / "b.csv").write_bytes(b'"a"b,c\n')
    got, rejects = readers.read_tables(spark, str(tmp_path))
    assert sorted((r["row"], r["col"], r["value"]) for r in got.collect()) == [(0, 0, "x"), (0, 1, "a\x02b"), (1, 0, "\x05"), (1, 1, "y")]
    assert [r["path"][-5:] for r in rejects.collect()] == ["b.csv"]


def test_csv_of_several_documents(spark, tmp_path):
    one = cells(spark, [["a", "=1"], ["b", "2"]])
    both = one.unionByName(one.withColumn("doc_id", F.lit(2).cast("long")))
    writers.write_csv(both, str(tmp_path / "out"), bom=True)
    files = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out"), wholetext=True).collect()
    assert [r["value"] for r in files if r["value"]] == ["﻿a,'=1\nb,2\n"] * 2
    key = replace.reid_key(api.detect(spark.createDataFrame([(1, "10.0.0.1 a@b.co")], "doc_id long, text string")))
    writers.write_key(key, str(tmp_path / "key"))
    lines = [r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "key")).collect()]
    assert lines == ["type,original,replacement", '"IP_ADDRESS","10.0.0.1","[IP_ADDRESS_1]"', '"EMAIL","a@b.co","[EMAIL_1]"']


def test_other_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.bin").write_text("no")
    assert [r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    (tmp_path / "terms").write_text(" x \n\ny\nx\n")
    assert {r["term"] for r in readers.read_terms(spark, str(tmp_path / "terms")).collect()} == {"x", "y"}
    (tmp_path / "gold").write_text('{"text": "Ann", "spans": [{"start": 0, "end": 3, "label": "PERSON"}]}\n')
    texts, gold = readers.read_annotated(spark, str(tmp_path / "gold"))
    assert texts.join(gold, "doc_id").first()["type"] == "PERSON"
    c = cells(spark, [["1", "x"]])
    assert readers.union_sheets(c, c).groupBy("sheet").count().count() == 2
    writers.write_texts_table(spark.createDataFrame([("d/a.txt", "t")], "name string, text string"), str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).first()["name"] == "d/a.redacted.txt"
    original = c.withColumns({"scalar_num": F.lit(1.0), "scalar_bool": F.lit(None).cast("boolean")})
    clean = {r["col"]: (r["sheet"], r["scalar_num"]) for r in writers.clean_table(c.withColumn("value", F.regexp_replace("value", "x", "y")), original).collect()}
    assert clean == {0: ("Sheet 1", 1.0), 1: ("Sheet 1", None)}
    notes = readers.coverage_notes(spark.createDataFrame([("p", "windows-1252", False)], "path string, encoding string, bom boolean")).first()["notes"]
    assert notes == ["read as Windows-1252"]
    headers = review.header_flags(spark.createDataFrame([(1, 0, True)], "doc_id long, sheet int, has_header boolean"), spark.createDataFrame([(1, 0, False)], "doc_id long, sheet int, has_header boolean"))
    assert headers.first()["has_header"] is False
