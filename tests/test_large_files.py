"""Delimited files in byte ranges."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from maskwright.sources import delimited, files, readers, writers

CASES = {
    "plain.csv": 'a,b\r\n"x, ""y""\r\nz",2\n\n,\n007,"\n\n"\n',
    "no_end.csv": 'a,b\n"1\n2",',
    "returns.csv": 'a;b\rc;"d\re"\r\r\nf;g',
    "inner.csv": 'a"b,c\n5" pipe,"q"\n"""",""\n',
    "tabs.tsv": 'a\tb\n"x\ty"\t,\n',
    "wide.csv": "é,ü\n日本語,😀\n\"ß\n\",ç\n",
    "blank.csv": "\n\n\n",
    "empty.csv": "",
}


def parts(data: bytes, cuts, name):
    """Records and reasons of data cut at some places."""
    open_ = lambda _: io.BytesIO(data)
    edges = [0, *cuts, len(data)]
    some = [delimited.summary(open_, name, len(data), a, b) for a, b in zip(edges, edges[1:], strict=False)]
    out, reason = [], None
    for _, path, start, end, skip, encoding, delimiter, state, row, reason in delimited.carry(some):
        out += [] if reason else list(delimited.records(open_, path, start, end, skip, encoding, delimiter, state, row))
    return out, reason


@pytest.mark.parametrize("name", CASES)
def test_a_file_cut_anywhere_gives_the_same_records(name):
    text = CASES[name]
    for encoding, mark in (("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        data = mark + text.encode(encoding)
        delimiter = delimited.layout_of(name, data).delimiter
        want = list(enumerate(readers.parsed(text, delimiter)))
        step = 2 if "16" in encoding else 1
        for k in range(0, len(data) + 1, step):
            assert parts(data, [k], name) == (want, None), (name, encoding, k)
        assert parts(data, range(step, len(data), step), name) == (want, None)


def test_random_files(tmp_path):
    rng = random.Random(1)
    for n in range(150):
        text = "".join(rng.choice('ab,"\n\r é') for _ in range(rng.randrange(1, 60)))
        data = text.encode()
        delimiter = delimited.layout_of("x.csv", data).delimiter
        try:
            want = list(enumerate(readers.parsed(text, delimiter)))
        except csv.Error:
            want = None
        for cuts in ([], [len(data) // 2], range(1, len(data))):
            got, reason = parts(data, cuts, "x.csv")
            assert (reason is not None) if want is None else (got == want and reason is None), (n, text)


def test_broken_encodings():
    assert parts("a,b\n".encode("utf-16-le").join([b"\xff\xfe", b"\x00"]), [], "x.csv")[1] == "broken UTF-16"
    lone = b"\xff\xfe" + "a".encode("utf-16-le") + b"\x00\xd8" + "b".encode("utf-16-le")
    assert parts(lone, [4, 6], "x.csv")[1] == "broken UTF-16"
    old = "caf\xe9,1\nna\xefve,2\n".encode("cp1252")
    for k in range(len(old)):
        assert parts(old, [k], "x.csv")[0] == [(0, ["café", "1"]), (1, ["naïve", "2"])]
    good = "é,日\n😀,x\n".encode()
    for k in range(len(good)):
        assert parts(good, [k], "x.csv")[0] == [(0, ["é", "日"]), (1, ["😀", "x"])]


def test_a_long_block_of_symbols(monkeypatch):
    monkeypatch.setattr(delimited, "_BLOCK", 64)
    rng = random.Random(2)
    text = "".join(rng.choice(['a,b\n', '"x\n""y"\n', "\r\n", "é,\n"]) for _ in range(400))
    want = list(enumerate(readers.parsed(text, ",")))
    assert parts(text.encode(), [500, 1000], "x.csv") == (want, None)


def test_ranges_in_spark(spark, tmp_path):
    for name, text in CASES.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.csv").write_text('a,b\n"never closed\n')
    for name, data in (("odd.csv", b"a,b"), ("lone.csv", "x,".encode("utf-16-le") + b"\x00\xd8" + "y\n".encode("utf-16-le")), ("pair.csv", "x,😀\n".encode("utf-16-le"))):
        (tmp_path / name).write_bytes(b"\xff\xfe" + data)
    (tmp_path / "big.csv").write_bytes(b"\xfe\xff" + "x,😀\n".encode("utf-16-be"))
    (tmp_path / "swapped.csv").write_bytes(b"\xfe\xff" + b"\xdc\x00\xd8\x00")
    (tmp_path / "note.txt").write_text("no table")
    cells, rejects = delimited.read_large_tables(spark, tmp_path.as_uri(), range_bytes=6)
    small, small_rejects = readers.read_tables(spark, str(tmp_path))
    rows = lambda df: sorted((r["doc_id"].rsplit("/", 1)[1], r["row"], r["col"], r["value"]) for r in df.collect())
    assert rows(cells) == rows(small) and rows(cells)
    reasons = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["reason"].split(":")[0]) for r in df.collect())
    broken = [("bad.csv", "malformed quoting"), ("lone.csv", "broken UTF-16"), ("odd.csv", "broken UTF-16"), ("swapped.csv", "broken UTF-16")]
    assert reasons(rejects) == reasons(small_rejects) == broken
    assert {r[3] for r in rows(cells) if r[0] in ("pair.csv", "big.csv")} == {"x", "😀"}


# Named files --------------------------------------------------------------------------------------


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes().decode() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_texts_become_files(spark, tmp_path):
    rows = [(1, "d/a.txt", "one"), (2, "b.md", None), (3, "same.txt", "x"), (4, "same.log", "y"), (5, "Pasted text", "p\nq")]
    writers.write_texts(spark.createDataFrame(rows, "doc_id long, name string, text string").repartition(3), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"d/a.redacted.txt": "one", "b.redacted.txt": "", "same.3.redacted.txt": "x", "same.4.redacted.txt": "y", "Pasted text.redacted.txt": "p\nq"}
    assert not (tmp_path / "out/_staging").exists()


def test_a_large_table_is_written_in_parts_and_read_as_one(spark, tmp_path):
    cells = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("sheet"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"))
    cells = cells.withColumn("value", F.when(F.col("row") % 5 == 0, F.concat(F.lit('say "x",\n'), F.col("row"))).otherwise(F.concat(F.lit("v"), F.col("row") * F.col("col"))))
    writers.write_csv(cells.repartition(4), str(tmp_path / "out"), newline="\r\n", bom=True, parts=6)
    parts = sorted((tmp_path / "out").iterdir())
    assert len(parts) > 1 and [p.name for p in parts] == [f"7-0.redacted-data.part-{k:05d}.csv" for k in range(len(parts))]
    assert [p.read_bytes().startswith(b"\xef\xbb\xbf") for p in parts] == [True] + [False] * (len(parts) - 1)
    back, rejects = delimited.read_large_tables(spark, (tmp_path / "out").as_uri(), range_bytes=5000)
    key = lambda df: sorted((r["row"], r["col"], r["value"]) for r in df.collect())
    assert key(back) == key(cells) and rejects.count() == 0
    assert {r["doc_id"].rsplit("/", 1)[1] for r in back.select("doc_id").distinct().collect()} == {"7-0.redacted-data.csv"}


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    def broken(batches):
        for b in batches:
            if "c" in b.column(0).to_pylist():
                raise RuntimeError("lost on the way")
            yield b

    rows = spark.createDataFrame([("a", 0, b"1"), ("b", 0, b"2"), ("c", 0, b"3")], files.ROWS)
    spark.dataSource.register(files.NamedFiles)
    with pytest.raises(Exception, match="lost on the way"):
        rows.repartition(3, "name").mapInArrow(broken, files.ROWS).write.format("named_files").mode("append").save(str(tmp_path / "out"))
    assert tree(tmp_path) == {}
    files.write_named_files(rows, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"a": "1", "b": "2", "c": "3"}


def test_attempts_that_are_not_committed_leave_no_doubles(tmp_path):
    """A retried and a speculative task write the same rows again; what one attempt of each reports is named."""
    import pyarrow as pa

    w = files.NamedFilesWriter(str(tmp_path / "out"), overwrite=False)
    batch = lambda *rows: iter([pa.RecordBatch.from_pylist([dict(zip(("name", "part", "content"), r, strict=True)) for r in rows])])
    first = w.write(batch(("t.csv", 0, b"one\n"), ("t.csv", 1, b"two\n")))
    w.write(batch(("t.csv", 0, b"one\n"), ("t.csv", 1, b"two\n")))
    w.write(batch(("t.csv", 0, b"one")))
    second = w.write(batch(("t.csv", 2, b"three\n"), ("u.csv", 0, b"")))
    w.commit([second, None, first])
    assert tree(tmp_path / "out") == {"t.part-00000.csv": "one\ntwo\n", "t.part-00001.csv": "three\n", "u.csv": ""}
    again = files.NamedFilesWriter(str(tmp_path / "out"), overwrite=False)
    with pytest.raises(FileExistsError):
        again.commit([again.write(batch(("u.csv", 0, b"new"))), again.write(batch(("v.csv", 0, b"new")))])
    assert tree(tmp_path / "out") == {"t.part-00000.csv": "one\ntwo\n", "t.part-00001.csv": "three\n", "u.csv": ""}
    over = files.NamedFilesWriter(str(tmp_path / "out"), overwrite=True)
    over.commit([over.write(batch(("u.csv", 0, b"new")))])
    assert tree(tmp_path / "out")["u.csv"] == "new"


@pytest.mark.parametrize("name", ["", "/etc/x", "../x", "a/../b", "a//b", "_staging/x"])
def test_names_stay_in_the_folder(name):
    with pytest.raises(ValueError, match="file name"):
        files.safe_name(name)
