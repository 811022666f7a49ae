"""Plans and memory of queries over larger tables: what may grow, and where."""

import io
import random
import time

from pyspark.sql import functions as F

from maskwright.operators import layout, tables
from maskwright.operators.intervals import overlap_join, points_in
from maskwright.sources import delimited, files, readers, writers
from maskwright.storage import _CLEANUP, shuffles_dropped, write_table


def broadcasts(df):
    """Whether the plan has a join that sends one side to the driver and from there to all tasks."""
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def name_runs(spark, n):
    """A run of ten characters and one of six on the next line for each document, and a span from the third character on."""
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    runs = ids.select("doc_id", F.posexplode(F.array(F.lit("Customer#0"), F.lit("123456"))).alias("k", "text"))
    runs = runs.select("doc_id", (F.col("k") * 10).alias("start"), F.lit(1).alias("page"), F.lit(100.0).alias("x"), (F.col("k") * 15.0).alias("y"), (F.length("text") * 6.0).alias("w"), F.lit(12.0).alias("h"), "text", F.lit(None).cast("array<double>").alias("weights"))
    return runs, ids.select("doc_id", F.lit(2).alias("start"), F.lit(16).alias("end"))


def test_rectangles_of_characters_are_never_broadcast(spark):
    """Spark takes a side's size before its rows are copied, and is wrong by the factor of the copies."""
    runs, found = name_runs(spark, 50)
    df = layout.rectangles(found, layout.char_boxes(runs))
    assert not broadcasts(df)
    assert sorted((r["doc_id"], r["x"], r["y"], r["w"]) for r in df.collect())[:2] == [(0, 109.0, -3.0, 54.0), (0, 97.0, 12.0, 42.0)][::-1]


def test_points_in_intervals(spark):
    rng = random.Random(5)
    points = [(rng.randrange(2), rng.randrange(2000), k) for k in range(300)]
    ends = [(rng.randrange(2), s, s + rng.choice([0, 1, 5, 127, 128, 129, 900])) for s in [0, 127, 128, 255, *(rng.randrange(2000) for _ in range(40))]]
    got = points_in(spark.createDataFrame(points, "d int, at int, k int"), spark.createDataFrame(ends, "d int, __s int, __e int"), ["d"], "at")
    assert sorted(map(tuple, got.select("d", "at", "k", "__s", "__e").collect())) == sorted((d, a, k, s, e) for d, a, k in points for f, s, e in ends if d == f and s <= a < e)


def test_rectangles_of_runs_are_never_broadcast(spark):
    runs, found = name_runs(spark, 50)
    df = layout.rectangles_of_runs(found, runs)
    assert not broadcasts(df)
    assert sorted((r["doc_id"], r["x"], r["y"], r["w"]) for r in df.collect())[:2] == [(0, 97.0, 12.0, 42.0), (0, 109.0, -3.0, 54.0)]
    a = spark.range(3).selectExpr("id AS d", "1 AS start", "5 AS end")
    assert not broadcasts(overlap_join(a, a.selectExpr("d", "start AS __s", "end AS __e"), ["d"]))


def test_blacked_out_is_never_broadcast(spark, tmp_path):
    """The query as it is registered, over a table whose size Spark guesses as small."""
    from maskwright.plans.queries import QUERIES

    names = spark.range(50).selectExpr("id AS c_custkey", "concat('Customer#', lpad(id, 9, '0')) AS c_name")
    names.write.parquet((tmp_path / "customer.parquet").as_uri())
    df = QUERIES["blacked_out"](spark, tmp_path.as_uri())
    assert not broadcasts(df)
    assert df.count() == 50 * 2 + 17


def test_texts_are_listed_by_tasks(spark, tmp_path):
    """Reading them, the driver knows no file: the plan has no list of files, and the rows are those of Spark's own reader, with empty texts."""
    (tmp_path / "in/_staging").mkdir(parents=True)
    (tmp_path / "in/b").mkdir()
    for name, data in (("a 50%.txt", "é\r\n".encode()), ("c.log", b""), ("b/d.txt", b"in"), ("d.bin", b"x"), ("_staging/e.txt", b"x"), (".f.txt", b"x"), ("g.md", b"\xff\x00")):
        (tmp_path / "in" / name).write_bytes(data)
    path = str(tmp_path / "in")
    got = readers.read_text_files(spark, path)
    assert got.inputFiles() == []
    key = lambda df: sorted((r["name"].rsplit("/", 1)[1].replace("%20", " ").replace("%25", "%"), bytes(r["text"])) for r in df.withColumn("text", F.col("text").cast("binary")).collect())
    top = [("a 50%.txt", "é\r\n".encode()), ("c.log", b""), ("g.md", b"\xff\x00")]
    assert key(readers.read_texts(spark, path)) == [x for x in top if x[1]]  # Spark leaves out empty files
    assert key(got) == sorted([*top, ("d.txt", b"in")])  # with the folders in it


def test_what_a_task_reports_does_not_grow_with_its_files(tmp_path):
    """And the commit names all of them, those of several tasks in one order."""
    import pickle

    import pyarrow as pa

    w = files.NamedFilesWriter(str(tmp_path / "out"), overwrite=False)
    batch = lambda ids: iter([pa.RecordBatch.from_pydict({"name": [f"{k:05d}.txt" for k in ids], "part": [0] * len(ids), "content": [str(k).encode() for k in ids]})])
    told = [w.write(batch(range(3, 4))), w.write(batch(range(4, 3000))), w.write(batch([3, 1, 2]))]
    assert len(pickle.dumps(told[1])) == len(pickle.dumps(told[0]))
    w.commit(told)
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"{k:05d}.txt": str(k) for k in (1, 2, *range(4, 3000))} | {"00003.part-00000.txt": "3", "00003.part-00001.txt": "3"}


def test_texts_are_made_once_to_be_written(spark, tmp_path):
    """No sampling of the texts before they are dealt out, which would make all of them twice."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") - F.col("id") % 39, F.lit(".txt")).alias("name"), F.udf(seen, "string")(F.col("id").cast("string")).alias("text"))
    writers.write_texts(texts, str(tmp_path / "out"))
    assert made.value == 40
    assert len(list((tmp_path / "out").iterdir())) == 40 and (tmp_path / "out/t39.redacted.txt").read_text() == "39" and (tmp_path / "out/t0.7.redacted.txt").read_text() == "7"


def test_small_ranges_share_tasks(spark, tmp_path):
    """However many files and ranges there are, tasks are as many as a shuffle has, or one for RANGE_BYTES."""
    for k in range(40):
        (tmp_path / f"{k}.csv").write_text("a,b\n" * 30 + '"x\ny",c\n')
    cells, rejects = delimited.read_large_tables(spark, tmp_path.as_uri(), range_bytes=50)
    assert cells.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert cells.count() == 40 * 31 * 2 and rejects.count() == 0
    assert cells.where("row = 30 and col = 0 and value = 'x\ny'").count() == 40


def test_a_small_range_reads_little():
    """The end of a record that an earlier range began is looked for nearby first, and a known layout is not read again."""
    data = ('a,b\n' + "v" * 20 + ",w\n") * 100_000
    read = 0

    class Counted(io.BytesIO):
        def read(self, n=-1):
            nonlocal read
            out = super().read(n)
            read += len(out)
            return out

        read1 = read

    open_ = lambda _: Counted(data.encode())
    got = list(delimited.records(open_, "x.csv", 1030, 2054, 0, "UTF-8", ",", delimited.PLAIN, 7))
    assert got[0][0] == 7 and len(got) in range(70, 80) and read < 50_000
    read = 0
    how = delimited.layout_of("x.csv", data[:1000].encode())
    assert delimited.summary(open_, "x.csv", len(data), 1024, 2048, how=how)[:4] == ("x.csv", len(data), 1024, 2048) and read < 5_000


def test_runs_are_packed_to_move(spark):
    """Runs in any order, with gaps, nulls, text of all widths, long ones, and spans over bins, against a brute-force version."""
    rng = random.Random(9)
    runs, spans, want = [], [], {}
    for doc in (0, 1, 2, None):
        at = rng.randrange(5)
        own = []
        for k in range(400):
            n = rng.choice([0, 1, 7, 7, 7, 200]) if doc != 2 else rng.choice([7, 900])
            n = 70_000 if doc == 1 and k in (3, 200) else n
            t = "".join(rng.choices("abé日😀 " if doc != 2 else "xyz ", k=n))
            own.append((doc, k, at, at + n, t if k % 50 or not n else None, f"s{k % 3}" if k % 5 else None))
            at += n + (k % 4 == 0)
        runs += own
        s, found = 0, []
        while s < at:
            e = min(at, s + rng.choice([0, 1, 5, 20, 400]))
            if rng.random() < 0.6 and doc != 2 or rng.random() < 0.02:
                found.append((doc, s, e, rng.choice(["", "[é]", "<x>"])))
            s = e + 1 + rng.randrange(40)
        spans += found
        for _, k, a, b, t, _ in own:
            for _, s, e, new in reversed(found if doc is not None and t is not None else []):
                if a < e and s < b:
                    t = t[: max(s, a) - a] + (new if s >= a else "") + t[min(e, b) - a :]
            want[doc, k] = t
    df = spark.createDataFrame(rng.sample(runs, len(runs)), "doc_id int, run_no int, start int, end long, text string, style string").repartition(3)
    done = tables.apply_to_runs(df, spark.createDataFrame(spans, "doc_id int, start int, end int, new string").repartition(2))
    got = done.collect()
    assert done.columns == ["doc_id", "run_no", "start", "end", "text", "style"]
    assert {(r["doc_id"], r["run_no"]): r["text"] for r in got} == want and len(got) == len(runs)
    assert sorted((r["doc_id"] or -1, r["run_no"], r["start"], r["end"], r["style"] or "") for r in got) == sorted((r[0] or -1, r[1], r[2], r[3], r[5] or "") for r in runs)


def test_runs_meet_spans_in_few_rows(spark):
    """What is shuffled grows with documents and spans, not with runs."""
    runs = spark.range(20).select(F.col("id").alias("doc_id"), F.posexplode(F.sequence(F.lit(0), F.lit(499))).alias("run_no", "k")).select("doc_id", "run_no", (F.col("k") * 7).alias("start"), (F.col("k") * 7 + 7).alias("end"), F.lit("seven c").alias("text"))
    done = tables.apply_to_runs(runs, spark.range(20).selectExpr("id AS doc_id", "3 AS start", "9 AS end", "'[x]' AS new"))
    done.write.format("noop").mode("overwrite").save()
    assert done.where("run_no = 0 and text = 'sev[x]' or run_no = 1 and text = 'ven c' or run_no > 1 and text = 'seven c'").count() == 20 * 500
    assert "Generate posexplode" in done._jdf.queryExecution().executedPlan().toString()
    exchanged = done._jdf.queryExecution().optimizedPlan().toString()
    assert exchanged.count("MapInArrow") == 2 and "__level" not in exchanged


def test_written_tables_leave_no_shuffle_files(spark):
    """Without waiting for the driver's garbage collection; the setting is as it was before."""
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    ours = lambda: {b for b in blocks().split() if b.startswith("shuffle_")}
    before, setting = ours(), spark.conf.get(_CLEANUP, None)
    with shuffles_dropped(spark):
        df = spark.range(5000).repartition(3, "id")
        held = write_table(df, "dealt")
        assert held.count() == 5000
    for _ in range(40):
        if not ours() - before:
            break
        time.sleep(0.25)
    assert not ours() - before and spark.conf.get(_CLEANUP, None) == setting
