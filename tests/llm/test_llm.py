"""Each training-data operator against a brute-force version, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.llm import bpe, decontaminate, fuzzy_passages, jaccard_join, line_dedup, maxent_lm, quality_rules, substring_dedup, toxicity, url_filter
from maskwright.llm.graph import components
from maskwright.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "two words", "x" * 30_000, "é " * 400, "same line\n" * 5]


@pytest.fixture(scope="module")
def family():
    """Texts with exact copies, near copies, shared passages and odd ones."""
    rng = random.Random(11)
    out = list(ODD) + [ODD[4], ODD[5]]
    passage = prose(rng, 70)
    for _ in range(12):
        base = [prose(rng, rng.choice([20, 60, 200])) for _ in range(rng.randint(1, 5))]
        for _ in range(rng.choice([1, 2, 9])):
            lines = list(base)
            if rng.random() < 0.5:
                w = lines[0].split()
                w[rng.randrange(len(w))] = "edited"
                lines[0] = " ".join(w)
            if rng.random() < 0.3:
                lines.insert(rng.randrange(len(lines) + 1), passage)
            out.append("\n".join(lines))
    return out


def test_quality_rules(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    texts = [clean, "short", "a b c " * 40, clean.upper(), clean + " ###" * 20, (clean + "\n") * 1, None, "x " * 60]
    rows = {r["doc_id"]: r for r in quality_rules.ledger_rows(docs(spark, texts)).collect()}
    assert [rows[i]["kept"] for i in range(8)] == [True, False, False, False, False, True, False, False]
    assert rows[2]["n_repeat_words"] == 120 and rows[2]["base_failed"] and rows[6]["n_words"] == 0
    ledger = quality_rules.evaluate_rules(docs(spark, texts))
    a = {r["rule"]: r for r in quality_rules.ablation(ledger, quality_rules.STRICT).collect()}
    assert a["upper_case"]["n_failed"] == 1 and a["upper_case"]["n_only"] == 1 and a["upper_case"]["n_kept_without"] == 3
    named = docs(spark, texts).withColumn("n_words", F.lit("mine"))
    assert quality_rules.apply_policy(quality_rules.evaluate_rules(named), quality_rules.STRICT).columns == named.columns


def test_repeat_words_brute_force(spark, family):
    for r, t in zip(quality_rules.ledger_rows(docs(spark, family)).orderBy("doc_id").collect(), family, strict=True):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len({i + d for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for d in range(3)})


def test_bpe_is_the_library(spark, family):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    texts = family + ["<|endoftext|>hi <|startoftext|> x", "ΟΔΟΣ Σ É é İstanbul", "a\x1cb\x85c　d", "it's we're ''s 123 ½ ①", "日本語 😀", "Å ﬁ", "aaaaaaaaa aaaa"]
    for r, text in zip(bpe.encode(docs(spark, texts), vocabulary_path()).orderBy("doc_id").collect(), texts, strict=True):
        e = t.encode(text or "", add_special_tokens=False)
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in e.ids) and r["decoded"] == t.decode(e.ids, skip_special_tokens=False)
    d = bpe.digests(bpe.encode(docs(spark, ["hi"]), vocabulary_path())).first()
    assert d["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in t.encode("hi", add_special_tokens=False).ids)).hexdigest()


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "https://b.example.net/fr/?x", "http://X.ORG/fr/2", "http://x.org/de/", "http://notexample.com/de/", "http://example.com/de/#t", "http://x.net", None, "no scheme", "http://free-bets.example.org/", "http://a.b.c.example.com/de/x/y", "http://?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert out[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and out[1][2:] == ("net/", "block")
    assert out[2] == ("x.org", "/fr/2", "org/fr/", "allow") and out[3][2:] == (None, "allow") and out[4][2:] == (None, "allow")
    assert out[5][2:] == ("example.com/de/", "block") and out[6] == ("x.net", "", None, "allow") and out[7] == out[8] == ("", "", None, "allow")
    assert out[9][2:] == (None, "block") and out[10][3] == "block" and out[11][0] == ""
    assert url_filter.judge(pages.where("false")).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", "id").alias("h2"), (F.col("id") % 5 == 0).alias("listed"))
    c = url_filter.build_cascade(keys, bits=3, hashes=2)
    p = keys.toPandas()
    assert len(c.levels) > 2 and (c.member(p["h1"].to_numpy(), p["h2"].to_numpy()) == p["listed"].to_numpy()).all()


def test_toxicity(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.25
        w = prose(rng, 60).split()
        if bad:
            w[5], w[20] = rng.sample(["moron", "scum", "trash"], 2)
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    d, l = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(d, toxicity.train(d, l)).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.95 * len(held)
    odd = toxicity.score(docs(spark, ODD), toxicity.train(d, l)).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.score(d, toxicity.train(d, l.where("false")))
    assert none.agg(F.max("predicted")).first()[0] == 0


def test_lm_scores(spark, family):
    rng = random.Random(2)
    texts = family + [" ".join(rng.choice(["the cat", "a dog"]) for _ in range(50)) for _ in range(60)]
    d = docs(spark, texts)
    rows = {r["doc_id"]: r for r in maxent_lm.run(d).collect()}
    import zlib

    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        tokens = [*words(t), None]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[x] > 0 for x in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_probabilities_add_up(spark):
    import numpy as np

    w = np.random.default_rng(0).normal(size=((1 << maxent_lm.FEATURE_BITS) + 1, maxent_lm.CLASSES)).astype(np.float32)
    p = np.exp(maxent_lm.log_softmax(w, np.array([[1, 2, 3], [4, 4, 4]])))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_lm_score_by_hand(spark, family):
    """The whole score, each token's three factors in plain Python, with weights that are anything."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    texts = [*family, *(prose(rng, 60) for _ in range(20)), "", "one", "never seen zzqx zzqy", None]
    d = docs(spark, texts)
    counts = maxent_lm.count_words(d.where("doc_id % 3 <> 1"))
    v = maxent_lm.vocabulary(counts)
    draw = np.random.default_rng(1)
    weights = [draw.normal(size=w.shape).astype(np.float32) for w in maxent_lm.first_weights(v)]
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(d, counts, v, weights).collect()}
    seen = {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in counts.collect()}

    streams = [maxent_lm.Stream.of(pa.array([t], pa.string())) for t in texts]
    place = {}  # word -> class, cell
    for t in streams:
        cls = v.classes(t.hash, t.suffix)
        place.update(zip(t.hash.tolist(), zip(cls.tolist(), maxent_lm.cell_of(t.hash, cls).tolist(), strict=True), strict=True))
    size = Counter({p: 1 for p in place.values()})
    for w, n in seen.items():
        size[place[w]] += n + 1

    def share(table, rows, target):
        s = [sum(float(table[r][c]) for r in rows) for c in range(table.shape[1])]
        return s[target] - math.log(sum(map(math.exp, s)))

    for i, t in enumerate(streams):
        total, ctx = 0.0, t.contexts()
        for j, w in enumerate(t.hash.tolist()):
            c, cell = place[w]
            total += share(weights[0], maxent_lm.class_rows(ctx[j : j + 1])[0], c)
            if c >= maxent_lm.TOP_WORDS:
                total += share(weights[1], maxent_lm.cell_rows(ctx[j : j + 1], np.array([c]))[0], cell)
            total += math.log((seen.get(w, 0) + 1) / size[c, cell])
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-4), i


def test_lm_row_sums():
    import numpy as np

    draw = np.random.default_rng(3)
    rows = np.stack([draw.integers(0, 4, 500), draw.integers(0, 300, 500), np.full(500, 9)], 1).astype(np.int32)
    g = draw.normal(size=(500, 5)).astype(np.float32)
    plain, number = {}, Counter()
    for r, x in zip(rows, g, strict=True):
        for q in r.tolist():
            plain[q] = plain.get(q, 0) + x.astype(float)
            number[q] += 1
    named, size, total = maxent_lm.row_sums(rows, g)
    assert dict(zip(named.tolist(), size.tolist(), strict=True)) == number
    assert all(np.allclose(plain[q], t, atol=1e-3) for q, t in zip(named.tolist(), total, strict=True))


def test_lm_shares_of_small_and_large_weights():
    """Scores are shifted only where powers of e would leave the range of floats; shares are the same, and finite, in both cases."""
    import numpy as np

    draw = np.random.default_rng(8)
    n = 1 << maxent_lm.FEATURE_BITS
    rows = np.append(draw.integers(0, n, (300, 3)), np.full((300, 1), n), 1).astype(np.int32)
    target = draw.integers(0, maxent_lm.CLASSES, 300)
    for size, far in ((0.5, False), (40, True)):
        w = (draw.normal(size=(n + 1, maxent_lm.CLASSES)) * size).astype(np.float32)
        assert maxent_lm._far_from_zero(w, 4) == far
        s = w.astype(float)[rows].sum(axis=1)
        s -= s.max(axis=1, keepdims=True)
        want = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        assert np.allclose(maxent_lm.log_share(w, rows, target), want[np.arange(300), target], atol=1e-3)


def test_lm_learns_the_same_in_every_run(spark, tmp_path):
    rng = random.Random(4)
    docs(spark, [prose(rng, 80) for _ in range(60)]).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    scores = [{r["doc_id"]: r["score"] for r in maxent_lm.run(d).collect()} for _ in range(2)]
    assert scores[0].keys() == scores[1].keys() and all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-9) for i in scores[0])


def test_lm_scores_do_not_follow_the_files(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(maxent_lm, "TASK_TOKENS", 1000)  # several learners a round
    d = docs(spark, [*ODD, *(prose(rng, 80) for _ in range(120))])
    scores = []
    for name, laid in (("one", d.coalesce(1)), ("seven", d.repartition(7)), ("turned", d.orderBy(F.desc("doc_id")))):
        laid.write.parquet(str(tmp_path / name))
        scores.append({r["doc_id"]: r["score"] for r in maxent_lm.run(spark.read.parquet(str(tmp_path / name))).collect()})
    assert all(s.keys() == scores[0].keys() for s in scores)
    assert all(math.isclose(s[i], scores[0][i], rel_tol=1e-9) for s in scores[1:] for i in s)


def test_decontamination(spark, family):
    rng = random.Random(9)
    item = prose(rng, 30)
    near = item.split()
    near[0] = "changed"
    far = item.split()
    far[7] = far[14] = far[21] = "changed"
    texts = family + [prose(rng, 400) + " " + item.upper() + ". " + prose(rng, 300), " ".join(near), " ".join(far), "two words"]
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "Two, words!"), (4, prose(rng, 12))], "item_id long, text string")
    n = len(family)
    out = {(r["doc_id"], r["item_id"]): round(r["containment"], 3) for r in decontaminate.leaks(docs(spark, texts), items).collect()}
    assert out == {(n, 0): 1.0, (n + 1, 0): round(25 / 26, 3), (n + 3, 3): 1.0, (4, 3): 1.0, (len(ODD), 3): 1.0}
    kept = decontaminate.clean(docs(spark, texts), items)
    assert kept.count() == len(texts) - 5 and kept.columns == docs(spark, []).columns


def brute_substrings(texts, k):
    raw, count = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        count.update(b[i : i + k] for i in range(len(b) - k + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = [True] * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), len(b) - len(kept), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("k", [200, 40])
def test_substring_dedup(spark, family, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 6 * k))) for _ in range(8)]
    texts = list(family) if k == 200 else []
    for _ in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            x = rng.randint(0, len(b))
            t += b[x : x + rng.randint(0, 4 * k)] + rng.choice(["", "z"])
        texts.append(t)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digests(substring_dedup.dedup(docs(spark, texts), k)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts, k)


def test_suffix_buckets_meet_across_boundaries(spark):
    """One gram holds half of all suffixes and one stretch a third, so both lie in several buckets."""
    rng = random.Random(8)
    rows = [(rng.randrange(400), rng.randrange(50), 1, rng.choice([7, 7, 8, 9])) for _ in range(1500)]
    rows += [(rng.randrange(400), rng.randrange(50), 2 + rng.randrange(900), rng.randrange(2)) for _ in range(1500)]
    rows += rows[:20]
    table = spark.createDataFrame([(k, a, g // 3, g, c) for k, a, g, c in rows], "key long, at long, lead long, g long, c long").repartition(5)
    stretches, places = {}, {}
    for k, a, g, c in rows:
        stretches.setdefault(g, set()).add(c)
        places.setdefault((g, c), set()).add((k, a))
    want = Counter()
    for k, a, g, c in set(rows):
        mixed, twice = len(stretches[g]) > 1, len(places[g, c]) > 1
        if mixed or twice:
            want[k, a, mixed, twice, min(places[g, c]) == (k, a)] += 1
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = substring_dedup.repeated_suffixes(table).select("key", "at", "mixed", "twice", "leads").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert Counter(tuple(r) for r in found) == want
    assert substring_dedup.repeated_suffixes(table.where("false")).count() == 0


def test_multikey_order_is_the_sorted_one():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 700):
        keys = [rng.integers(0, 4, n) for _ in range(5)]
        order = substring_dedup.multikey_order(keys)
        rows = list(zip(*(x[order].tolist() for x in keys), strict=True))
        assert rows == sorted(rows)


def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, family, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs(spark, family), k, percent).collect()}
    want = brute_groups(family, k, percent)
    assert [got[i] for i in range(len(family))] == want
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs(spark, family), k, percent).collect()}
    assert kept == {i for i, (n, c) in enumerate(want) if n == 0 or c == i}
    assert jaccard_join.join(docs(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    out = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[103] == out[101] == 100


def test_components_of_a_shuffled_path(spark):
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (2000, 3000), (3000, 2500)], "a long, b long")
    out = {r["node"]: r["component"] for r in components(links).collect()}
    assert out == dict.fromkeys(range(1000), 0) | dict.fromkeys((2000, 2500, 3000), 2000)


def brute_lines(texts, min_chars=120):
    strip = " \t\n\x0b\x0c\r"
    first_one, first_two, out = {}, {}, []
    seq = [[(j, x.strip(strip)) for j, x in enumerate((t or "").split("\n")) if x.strip(strip)] for t in texts]
    for d, l in enumerate(seq):
        for i, (_, x) in enumerate(l):
            first_one.setdefault(x, (d, i))
            if i + 1 < len(l):
                first_two.setdefault((x, l[i + 1][1]), (d, i))
    for d, l in enumerate(seq):
        gone = set()
        for i, (_, x) in enumerate(l):
            if len(x) >= min_chars and first_one[x] < (d, i):
                gone.add(i)
            if i + 1 < len(l) and first_two[x, l[i + 1][1]] < (d, i):
                gone |= {i, i + 1}
        keep = set(range(len((texts[d] or "").split("\n"))))
        runs = []
        for i in sorted(gone):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        for a, b in runs:
            keep -= set(range(l[a][0], l[b][0] + 1))
        out.append((len(l), len(gone), None if texts[d] is None else "\n".join(x for j, x in enumerate(texts[d].split("\n")) if j in keep)))
    return out


def test_line_dedup(spark, family):
    texts = family + ["a\n\nb\n\nc", "x\na\n \nb \ny", "a\nb\nc"]
    got = {r["doc_id"]: (r["__removed"]["n_lines"], r["__removed"]["n_removed"], r["text"]) for r in line_dedup.dedup(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)
    kept = line_dedup.clean(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.where("doc_id < 3").collect()} == {0, 1, 2}
    longest = line_dedup.runs(*line_dedup.repeated(docs(spark, ["\n".join("abcdefghij"), "z\n" + "\n".join("abcdefghij")]))).first()
    assert (longest["doc_id"], longest["first_line"], longest["last_line"], longest["n_lines"], longest["depth"], longest["copy_of"]["i"]) == (1, 1, 10, 10, 8, 0)


def test_fuzzy_passages(spark):
    rng = random.Random(6)
    passage = prose(rng, 80, 5000).split()
    fuzzy = [("odd" if i in (20, 41, 60) else w) for i, w in enumerate(passage)]
    texts = ODD + [prose(rng, 200, 5000) + " " + " ".join(passage) + " " + prose(rng, 50, 5000), prose(rng, 90, 5000) + " " + " ".join(fuzzy) + " " + prose(rng, 10, 5000), prose(rng, 300, 5000), prose(rng, 15, 5000)]
    n = len(ODD)
    rows = [r for r in fuzzy_passages.passages(docs(spark, texts)).collect() if r["doc_id"] != r["match_doc_id"]]
    assert [(r["doc_id"], r["match_doc_id"]) for r in rows] == [(n + 1, n)]
    r = rows[0]
    assert abs(r["start_word"] - 90) <= 2 and abs(r["end_word"] - 170) <= 2 and abs(r["match_start"] - 200) <= 2 and 0.9 < r["identity"] < 1


def test_chaining_takes_the_best_order():
    import numpy as np

    at, to = np.array([0, 5, 10, 15, 20]), np.array([0, 5, 200, 15, 20])
    best = max(fuzzy_passages.chains(at, to), key=len)
    assert at[best].tolist() == [0, 5, 15, 20]


def test_fuzzy_passages_of_many_edits(spark):
    rng = random.Random(12)
    texts, edited = [], []
    for _ in range(40):
        passage = prose(rng, 60, 50_000).split()
        fuzzy = list(passage)
        for i in range(9, 60, 10):
            fuzzy[i] = f"odd{rng.randrange(10**6)}"
        texts.append(" ".join([prose(rng, 40, 50_000), *passage, prose(rng, 40, 50_000)]))
        edited.append(" ".join([prose(rng, 70, 50_000), *fuzzy, prose(rng, 30, 50_000)]))
    found = {(r["doc_id"], r["match_doc_id"]) for r in fuzzy_passages.passages(docs(spark, texts + edited)).collect()}
    assert found == {(40 + i, i) for i in range(40)}


def test_fuzzy_passages_with_parts_in_earlier_texts(spark):
    rng = random.Random(13)
    passage = prose(rng, 60, 50_000).split()
    new = lambda n: prose(rng, n, 50_000).split()
    parts = [new(40) + passage[i : i + 24] + new(40) for i in (0, 18, 36)]
    texts = [*parts, new(50) + passage + new(50), new(80) + passage + new(20)]
    rows = [r for r in fuzzy_passages.passages(docs(spark, [" ".join(t) for t in texts])).collect() if r["match_doc_id"] == 3]
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["match_start"]) for r in rows] == [(4, 80, 140, 50)]
    parts = parts + [new(40) + passage[i : i + 24] + new(40) for i in (0, 18, 36)]  # such parts between the two as well
    texts = [*parts[:3], new(50) + passage + new(50), *parts[3:], new(80) + passage + new(20)]
    rows = [r for r in fuzzy_passages.passages(docs(spark, [" ".join(t) for t in texts])).collect() if r["match_doc_id"] == 3]
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["match_start"]) for r in rows] == [(7, 80, 140, 50)]
    parts = [new(40) + passage[i : i + 16] + new(40) for i in (0, 7, 14)]  # no more than min_words
    texts = [*parts, new(50) + passage[:30] + new(50), *parts, new(80) + passage[:30] + new(20)]
    rows = [r for r in fuzzy_passages.passages(docs(spark, [" ".join(t) for t in texts])).collect() if r["match_doc_id"] == 3]
    assert (7, 80, 110, 50) in [(r["doc_id"], r["start_word"], r["end_word"], r["match_start"]) for r in rows]


def brute_passages(texts, min_words=30, min_identity=0.8):
    """Pairs (later, earlier) of texts with a passage: all equal seeds of each two texts, chained and aligned."""
    import numpy as np
    import pyarrow as pa

    w = fuzzy_passages.Words(pa.array(texts, pa.string()))
    row, word, h = w.shingles(fuzzy_passages.K)
    own = [w.hash[w.first[i] : w.first[i + 1]].view(np.int64) for i in range(len(texts))]
    at = [dict() for _ in texts]
    for r, p, x in zip(row.tolist(), word.tolist(), h.tolist(), strict=True):
        at[r].setdefault(x, []).append(p - int(w.first[r]))
    found = set()
    for i in range(len(texts)):
        for j in range(i):
            met = np.array([(p, q) for x in at[i].keys() & at[j].keys() for p in at[i][x] for q in at[j][x]], np.int64).reshape(-1, 2)
            for path in fuzzy_passages.chains(met[:, 0], met[:, 1]) if len(met) else []:
                s, e, t, f, same = fuzzy_passages.align(own[i], own[j], met[path])
                if max(e - s, f - t) >= min_words and same >= min_identity * max(e - s, f - t):
                    found.add((i, j))
    return found


def edited_family(rng, n, share):
    """Texts that hold two of five passages, each with a share of its words replaced, among words of their own."""
    passages = [prose(rng, rng.choice([40, 60, 90]), 50_000).split() for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for p in rng.sample(passages, 2):
            parts += prose(rng, rng.randint(10, 60), 50_000).split() + [f"odd{rng.randrange(10**6)}" if rng.random() < share else w for w in p]
        texts.append(" ".join(parts))
    return texts


def test_fuzzy_passages_link_every_two_texts_that_brute_force_links(spark):
    """Each of many edited forms of a passage with each other, not with the first and the previous alone."""
    rng = random.Random(31)
    texts = edited_family(rng, 30, 0.08)
    want = brute_passages(texts)
    found = {(r["doc_id"], r["match_doc_id"]) for r in fuzzy_passages.passages(docs(spark, texts)).collect()}
    assert len(want) > 100 and want - found == set() and {p for p in found if p[0] != p[1]} == want


def test_fuzzy_passages_made_of_hot_seeds_alone(spark, monkeypatch):
    """With few occurrences matched each with each, texts still meet through pairs of hot seeds."""
    rng = random.Random(33)
    new = lambda n: prose(rng, n, 50_000).split()
    phrases = [new(7) for _ in range(8)]  # each stands in many texts
    link = lambda gap: [w for p in phrases for w in [*p, *new(gap)]]
    texts = [" ".join(new(20) + rng.choice(phrases) + new(40)) for _ in range(60)]
    texts += [" ".join(new(30) + link(1) + new(30)) for _ in range(3)]
    monkeypatch.setattr(fuzzy_passages, "MOST", 4)
    monkeypatch.setattr(fuzzy_passages, "HELD", 5)
    monkeypatch.setattr(fuzzy_passages, "ROWS", 3)
    found = {(r["doc_id"], r["match_doc_id"]) for r in fuzzy_passages.passages(docs(spark, texts)).collect()}
    assert found == brute_passages(texts) == {(61, 60), (62, 60), (62, 61)}


def test_fuzzy_passages_around_a_single_seed(spark):
    """Five equal words in the middle, on either side of them four equal words and another one in turn."""
    rng = random.Random(35)
    new = lambda n: prose(rng, n, 50_000).split()
    passage = new(45)
    fuzzy = [f"odd{i}" if i in (4, 9, 14, 19, 25, 30, 35, 40) else w for i, w in enumerate(passage)]
    texts = [" ".join([*new(50), *passage, *new(50)]), " ".join([*new(80), *fuzzy, *new(20)])]
    found = {(r["doc_id"], r["match_doc_id"]) for r in fuzzy_passages.passages(docs(spark, texts)).collect()}
    assert found == brute_passages(texts) == {(1, 0)}


def test_seeds_move_in_packed_rows_and_whole(spark):
    rng = random.Random(36)
    texts = [prose(rng, 200, 50_000) for _ in range(50)]
    rows = [r for share in range(2) for r in fuzzy_passages.seeds(docs(spark, texts).coalesce(1), 30, share, 2).collect()]
    assert len(rows) <= 2 * 4  # of one slice of texts, a row for each share and bucket
    assert sorted((d, a) for r in rows for d, a in zip(r["doc_id"], r["at"], strict=True)) == [(d, a) for d in range(50) for a in range(196)]


def test_far_pairs_are_the_next_chosen_seed_of_the_text():
    import numpy as np

    rng = np.random.default_rng(9)
    row = np.sort(rng.integers(0, 4, 400))
    word, h = np.arange(400) * 2, rng.integers(0, 2**63, 400).astype(np.uint64)
    _, step = fuzzy_passages.far_pairs(row, word, h)
    chosen = [i for i in range(400) if h[i] % fuzzy_passages.FAR_SHARE == 0]
    for i in range(400):
        after = [j for j in chosen if word[j] - word[i] >= fuzzy_passages.FAR][:1] if i in chosen else []
        ok = [j for j in after if row[j] == row[i] and word[j] - word[i] <= fuzzy_passages.MOST_STEP]
        assert step[i] == (word[ok[0]] - word[i] if ok else 0)


@pytest.mark.parametrize("gap", [100, 300, 800, 1200])
def test_chaining_links_later_passages_of_a_pair(gap):
    import numpy as np

    far = 200 + gap
    at = np.concatenate([np.arange(0, 200, 8), np.arange(far, far + 60, 8)])
    assert sorted(len(c) for c in fuzzy_passages.chains(at, at)) == [8, 25]
    assert sorted(len(c) for c in fuzzy_passages.chains(at, at + 7 * (at >= far))) == [8, 25]


def test_chaining_is_the_recurrence():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(2, 120))
        at, to = rng.integers(0, 500, n), rng.integers(0, 500, n)
        order = np.lexsort((to, at))
        x, y = at[order].tolist(), to[order].tolist()
        score = []
        for i in range(n):
            score.append(5.0 + max([0.0] + [score[j] - 0.05 * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if 0 < x[i] - x[j] <= 64 and 0 < y[i] - y[j] <= 64]))
        got = [5.0 * len(c) - 0.05 * (at[c[-1]] - at[c[0]] + to[c[-1]] - to[c[0]]) for c in fuzzy_passages.chains(at, to)]
        assert abs(max(got) - max(score)) < 1e-6


def test_pipeline(spark, tmp_path, family):
    """run() against the brute-force versions of its stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(8)
    item = prose(rng, 25, 5000)
    texts = family + ["\n".join(prose(rng, 40, 5000) for _ in range(4)) + " " + item, prose(rng, 80, 5000)]
    letters = str.maketrans("0123456789", "abcdefghij")  # words of digits would fail the quality rules
    texts, item = [t and t.translate(letters) for t in texts], item.translate(letters)
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [r["doc_id"] for r in quality_rules.ledger_rows(docs(spark, texts)).where("kept").collect()]
    left.sort()
    done = brute_lines([texts[i] for i in left])
    left = [(i, t) for i, (_, gone, t) in zip(left, done, strict=True) if not (gone and not words(t))]
    groups = brute_groups([t for _, t in left], 5, 80)
    left = [x for k, (x, (n, c)) in enumerate(zip(left, groups, strict=True)) if n == 0 or c == k]
    left = [(i, t) for i, t in left if item not in t]
    tok = tokenizers.Tokenizer.from_file(vocabulary_path())
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in left}
    assert want and {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_null_ids_and_repeated_rows(spark):
    rng = random.Random(1)
    t = "\n".join(prose(rng, 60) for _ in range(3))
    rows = [(None, t, "en", "s", 1), (1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t + " more", "en", "s", 1), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit(1))
    items = spark.createDataFrame([(0, prose(rng, 20))], "item_id long, text string")
    assert line_dedup.dedup(d).count() == 5 and quality_rules.ledger_rows(d).count() == 5 and jaccard_join.join(d).count() == 5
    assert substring_dedup.dedup(d).count() == 5 and decontaminate.clean(d, items).count() == 5 and maxent_lm.run(d).count() == 5
    assert bpe.encode(d, vocabulary_path()).count() == 5 and len(fuzzy_passages.passages(d).collect()) >= 1
    empty = d.where("false")
    for f in (line_dedup.dedup, quality_rules.ledger_rows, jaccard_join.join, substring_dedup.dedup, maxent_lm.run, fuzzy_passages.passages):
        assert f(empty).count() == 0


def test_t_occurrence_is_the_overlap():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(40):
        base = rng.integers(0, 40, 30)
        sets = [[np.unique(np.where(rng.random(30) < 0.1, rng.integers(0, 1000, 30), base)) for _ in range(rng.integers(1, 12))] for _ in range(2)]
        (x, fx), (y, fy) = ((np.concatenate(v), np.append(0, np.cumsum([len(s) for s in v]))) for v in sets)
        need, asked = rng.integers(1, 30, (len(sets[1]), len(sets[0]))), rng.random((len(sets[1]), len(sets[0]))) < 0.8
        want = np.array([[len(np.intersect1d(a, b)) for b in sets[0]] for a in sets[1]]) >= need
        assert (jaccard_join.t_occurrence(x, fx, y, fy, need, asked) == (want & asked)).all()


def test_jaccard_join_of_a_group_just_below(spark):
    """300 texts of one group, most of them a little too far from each other to link."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs(spark, texts)).collect()}
    assert [got[i] for i in range(300)] == [c for _, c in brute_groups(texts, 3, 90)]
    assert 20 < len(set(got.values())) < 300


def test_toxicity_learns_what_only_pairs_tell(spark):
    """Toxic where a text has both of two terms: linear weights cannot tell, as each term alone is harmless."""
    rng = random.Random(40)
    texts, labels = [], []
    for i in range(1600):
        w, a, b = prose(rng, 30, 200).split(), i % 2, (i // 2) % 2
        w[4], w[9] = "groupname" if a else "weather", "dreadful" if b else "sunny"
        texts.append(" ".join(w))
        labels.append((i, a & b))
    d = docs(spark, texts)
    rows = toxicity.score(d, toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.9 * len(held)


def test_machine_is_the_sum_over_all_pairs():
    import numpy as np

    rng = np.random.default_rng(8)
    m = toxicity.Machine(np.arange(6, dtype=np.int32), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 1, 2], [3], [], [1, 4, 5, 0]]
    got = m.scores(np.repeat(np.arange(4), [len(r) for r in rows]), np.array(sum(rows, []), np.int64), 4)
    for r, p in zip(rows, got, strict=True):
        z = 0.3 + sum(m.w[i] for i in r) + sum(m.v[i] @ m.v[j] for k, i in enumerate(r) for j in r[:k])
        assert math.isclose(p, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_odd_rows_of_toxicity_urls_and_benchmark(spark):
    rng = random.Random(41)
    d = docs(spark, ["you moron scum", "good day", "tie", "tie", "x " * 40_000]).withColumns({"score": F.lit("mine"), "toxic": F.lit(2)})
    d = d.unionByName(d.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(d.where("doc_id = 1"))
    model = toxicity.train(d, spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, 0)], "doc_id long, toxic int"))
    rows = toxicity.score(d, model).collect()
    assert len(rows) == 8 and len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.score(d.where("false"), model).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/x", "h"), (1, "http://a.net/x", "h"), (None, "http://" + "b" * 50_000 + ".net/", "h")], "page_id long, url string, host string")
    out = url_filter.judge(pages).collect()
    assert [r["verdict"] for r in out] == ["block"] * 3 and sum(r["page_id"] is None for r in out) == 1
    items = spark.createDataFrame([(0, prose(rng, 20))], "item_id long, text string")
    assert decontaminate.leaks(d.where("false"), items).count() == 0 and decontaminate.leaks(d, items.where("false")).count() == 0
    assert bpe.encode(docs(spark, []), vocabulary_path()).count() == 0
    for f, name in ((line_dedup.dedup, "__removed"), (quality_rules.evaluate_rules, "__ledger")):
        with pytest.raises(ValueError):
            f(d.withColumn(name, F.lit(1)))


def test_first_level_is_sized_by_both_sides(spark):
    """A thousandth of the keys is listed; the filter stays small and the second level takes about half of these."""
    keys = spark.range(200_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", "id").alias("h2"), (F.col("id") % 1000 == 0).alias("listed"))
    c = url_filter.build_cascade(keys, most_bits=1 << 13)
    p = keys.toPandas()
    assert (c.member(p["h1"].to_numpy(), p["h2"].to_numpy()) == p["listed"].to_numpy()).all()
    assert len(c.levels[1]) * 64 < 12 * 400
