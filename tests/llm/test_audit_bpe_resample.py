"""Filter audit, byte-level BPE and importance resampling, against brute-force versions and on odd inputs."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import byte_bpe, filter_audit, resample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LONG_TEXT = " ".join(f"w{i % 977}" for i in range(12_000))
ODD = [None, "", " \n\t ", "one", "x" * 30_000, "é " * 400, "SHOUT # " * 30, LONG_TEXT, LONG_TEXT]


def rows_of(rng, n=160):
    """doc_id, text, source: copies, ties, repeated rows and nulls in every column."""
    base = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d%", "eta", f"u{rng.randrange(900)}"]) for _ in range(rng.choice([3, 30, 70, 120]))) for _ in range(40)]
    out = [(i, rng.choice(base), rng.choice(["s0", "s0", "s1", None])) for i in range(n)]
    out += [(n + i, t, "s2") for i, t in enumerate(ODD)]
    return out + [out[0], out[5], (None, base[0], "s1"), (None, base[0], None), (None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA).repartition(3)


# Filter audit --------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in range(2))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    cells = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        cells[s or ""].append(({f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part, docs in cells.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = docs
            for k, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[0]]
                alive = [d for d in alive if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                shapley[f] += len(gone)
                out[part, order, k] = [len(alive), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def test_audit_is_brute_force(spark):
    rows = rows_of(random.Random(5))
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (9999, 1, 1)]
    got = filter_audit.audit(frame(spark, rows).withColumn("mask", F.lit("mine")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): list(r[c] for c in (*filter_audit.METRICS, "shapley")) for r in got.collect()} == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, rows_of(random.Random(1))).where("false"), none).count() == 0
    assert filter_audit.audit(frame(spark, [(1, None, None)]), none).count() == 600


def test_audit_of_more_parts_than_the_usual_recursion_holds(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        cells = spark.range(20).select(F.col("id").cast("string").alias("part"), F.expr("array(named_struct('mask', 3, 'n', 2L, 'good', 1L, 'toxic', 0L))").alias("cells"))
        assert filter_audit.prefixes(cells).count() == 20 * 325
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert filter_audit.orders(filter_audit.prefixes(cells, "AB"), "AB").where("filter_order = 'BA' and step = 1 and removed = 2 and shapley = 2").count() == 20
    with pytest.raises(ValueError, match="filters"):
        filter_audit.prefixes(cells, "AA")


# Byte-level BPE ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange(rng):
    out = ["ab" * 9000, "日本語" * 300, "😀" * 500, "a\x1cb \x1d\x85c　d", " " * 5000, "\n" * 700, "it's I'LL they're 123abc ½", "=-" * 300 + "a", "<|endoftext|>"]
    out += ["".join(chr(rng.randrange(32, 1000)) for _ in range(3000)), "".join(rng.choice("ACGT") for _ in range(20_000))]
    return out + ["".join(rng.choice("aeioutnsrlhd") for _ in range(rng.randrange(1, 600))) for _ in range(60)]


def test_byte_bpe_is_the_library(spark, public):
    path, pattern, library = public
    texts = ODD + strange(random.Random(3)) + ["one", "one"]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "null id", None)]).withColumn("ids", F.lit("mine"))
    rows = byte_bpe.encode(df, path, pattern).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = "null id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(t) and bytes(r["decoded"]) == t.encode(), t[:40]
    for r in byte_bpe.digests(byte_bpe.encode(df, path, pattern)).where("doc_id is not null").collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    assert byte_bpe.digests(byte_bpe.encode(df.where("false"), path, pattern)).count() == 0


def test_long_pieces_merge_as_short_ones(public):
    v = byte_bpe.Vocabulary.load(*public[:2])
    rng = random.Random(8)
    for _ in range(200):
        s = "".join(rng.choice("aeioutnsrlhd-") for _ in range(rng.randrange(2, 250))).encode()
        assert byte_bpe.merge_long(s, v).astype("<i4").tobytes() == byte_bpe.merge_matrix([s], v, 256)[0]


def test_a_lower_pair_made_on_the_way_goes_first():
    """With ranks ab < aba, merging both ab of abab at once would be wrong where aba has the lower rank."""
    single = np.arange(256, dtype=np.int32)
    left, right, made = np.array([97, 301]), np.array([98, 97]), np.array([301, 300])  # ab is 301, (ab)a is 300
    v = byte_bpe.Vocabulary("", {}, byte_bpe.PairTable(left, right, made), single, np.zeros(0, np.uint8), np.zeros(0, np.int64))
    assert byte_bpe.merge_long(b"abababab", v).tolist() == np.frombuffer(byte_bpe.merge_matrix([b"abababab"], v, 8)[0], "<i4").tolist() == [300, 98, 300, 98]


def test_pair_table_finds_all_and_nothing_else():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 400, (3000, 2)), axis=0)
    t = byte_bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    known = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    l, r = (x.ravel() for x in np.meshgrid(np.arange(-1, 400), np.arange(-1, 400)))
    assert t(l, r).tolist() == [known.get(p, int(byte_bpe._NEVER)) for p in zip(l.tolist(), r.tolist(), strict=True)]


def test_ids_outside_the_vocabulary_are_an_error(public):
    v = byte_bpe.Vocabulary.load(*public[:2])
    with pytest.raises(ValueError, match="vocabulary"):
        byte_bpe.decode(np.array([50256]), np.array([0, 1]), v)


# Importance resampling -----------------------------------------------------------------------------


def brute_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()
    return [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute_features(t, buckets=10_000):
    w = brute_words(t)
    return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, percent, min_words):
    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(brute_features(text))
    for text in target:
        t.update(brute_features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text, _ in rows:
        f = brute_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(brute_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    some = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(some[: percent * len(some) // 100]):
        r[5] = k + 1
    return out


def test_resampling_is_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, t and t.replace("u", rng.choice("uvw-")), s) for i, t, s in rows_of(rng)]
    target = [" ".join(f"u{rng.randrange(300)} eta" for _ in range(60)) for _ in range(5)] + [None, "", "x" * 700]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    clash = frame(spark, rows).withColumns({"score": F.lit("mine"), "n_words": F.lit("mine"), "rank": F.lit("mine")})
    for percent in (5, 40, 100):
        got = resample.resample(clash, bench, percent=percent).collect()
        want = brute_resample(rows, target, percent, 20)
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    assert resample.resample(clash.where("false"), bench).count() == 0
    assert resample.resample(clash, bench.where("false")).count() == len(rows)


def test_equal_scores_go_by_id(spark):
    scored = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(7).cast("long").alias("score")).repartition(7)
    assert {(r["doc_id"], r["rank"]) for r in resample.draw(scored, percent=20).where("rank is not null").collect()} == {(i, i + 1) for i in range(10)}


def test_substring_crcs_are_those_of_zlib():
    rng = np.random.default_rng(4)
    for n in (1, 255, 256, 257, 1000, 70_000):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        ends = np.sort(rng.integers(0, n + 1, (2, 100)), axis=0)
        assert resample.substring_crcs(resample.prefix_registers(data), *ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in ends.T]


def test_normalised_words():
    texts = [None, "", "  ", "Hello, World 42!", "é è-É x", "--a--", "x" * 3000 + " y", " lead", "trail ", "ÀB", LONG_TEXT]
    t = resample.Normalised(pa.array(texts))
    for i, text in enumerate(texts):
        at = range(t.first[i], t.first[i + 1])
        assert [t.data[t.start[k] : t.end[k]].tobytes() for k in at] == brute_words(text)
