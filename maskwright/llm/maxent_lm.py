"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(cell | class, context) * P(word | cell). The first factor is a
softmax over a few dozen classes, whose scores are sums of weight rows found by hashing the context's features:
the word before, the word before that (skip) and both together (n-gram). The second is a softmax over the
class's CELLS cells (words are dealt to them by hash), whose weight rows are found by hashing the same features with the
class; the most frequent words have a class, and so a cell, of their own. The third is the word's
add-one share of its cell, from counts over the whole training text; one unseen word a cell keeps
it a distribution.

Counts are one aggregation over all training texts. Weights are learnt in rounds; each training
text belongs to one round and, by a hash of its id and text, to one of the round's learners, whose number follows
the training tokens (TASK_TOKENS or more each, so that answers stay small beside texts). A learner is a task that walks from the
shared weights over its texts, in the order of their hashes, by
Adagrad steps and returns its change; changes are added up by a tree reduce (of the weights' size, which is bounded) and
averaged over the learners that touched a row. They are added as whole numbers, so the order in which tasks end
does not matter. Words frequent enough for a proven bound
(count >= N / 2^18, so 2^18 words at most) are looked up in a broadcast array; the counts of all
others are joined by shuffle, a document's rare words with their frequency.

Defined results: null and empty texts have one token, the end; scores are log10. Repeated rows and
ids are scored row by row (rows carry their own key); a row with a null id is not held out. An empty table gives no
rows. Very long texts are read whole, by the slice; other columns, whatever their names, are ignored. The
weights, and so `score`, are a function of the table's ids and texts: not of how files are cut, nor of the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import _MIX, Words, held_out, list_array, mix, release, signed, slices, unsigned, write_table

HEAVY_BITS = 18
TOP_WORDS, TOP_SUFFIXES, OTHER = 20, 24, 4
CLASSES = TOP_WORDS + TOP_SUFFIXES + OTHER
FEATURE_BITS = 13
#: Cells of a class, and rows of their weights.
CELL_BITS, CELL_FEATURE_BITS = 5, 14
CELLS = 1 << CELL_BITS
#: Tokens of a weight row that are added up rank by rank; those beyond as one sum.
RANKS = 16
#: A change of one in the whole numbers that tasks return.
UNIT = float(1 << 20)
#: Training tokens of a round that a task takes at least, where there are so many; its answer is of a fixed size.
TASK_TOKENS = 1 << 20
STEP_TOKENS = 16_384
#: Tokens, and bytes of text, whose arrays stay in a core's cache; results do not depend on them.
NEAR_TOKENS, NEAR_BYTES = 2_048, 1 << 19
#: Scores whose greatest is within this of 0 need no shift before exp.
MOST_POWER = 60.0
END = np.uint64(0x5DEECE66D1234567)
START = np.uint64(0x1234567089ABCDEF)
_LOG10E = float(np.log10(np.e))


def _suffixes(w: Words, at: np.ndarray) -> np.ndarray:
    """The last three bytes of words, without closing punctuation, as an integer."""
    start, end = w.start[at], w.end[at]
    for _ in range(2):
        punct = (end - start > 1) & np.isin(w.buf[end - 1], np.frombuffer(b".,;:!?", np.uint8))
        end = end - punct
    out = np.zeros(len(at), np.int64)
    for j in (3, 2, 1):
        has = end - start >= j
        b = w.buf[np.maximum(end - j, 0)].astype(np.int64)
        b[(b >= 65) & (b <= 90)] += 32
        out = out << 8 | np.where(has, b, 0)
    return out


@dataclass
class Stream:
    """The tokens of a slice: hash and suffix of each, with an end after every text."""

    hash: np.ndarray
    suffix: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Stream:
        w = Words(column)
        n = np.diff(w.first)
        first = w.first + np.arange(w.n_docs + 1)
        size = int(first[-1])
        is_end = np.zeros(size, bool)
        is_end[first[1:] - 1] = True
        h, s = np.full(size, END), np.zeros(size, np.int64)
        h[~is_end] = w.hash
        s[~is_end] = _suffixes(w, np.arange(len(w.hash)))
        assert len(n) + len(w.hash) == size
        return Stream(h, s, first)

    def contexts(self) -> np.ndarray:
        """Hashes of each token's features."""
        one = np.concatenate([[START], self.hash[:-1]])
        two = np.concatenate([[START, START], self.hash[:-2]])[: len(self.hash)]
        head = self.first[:-1]
        one[head] = START
        two[head] = START
        second = head + 1
        two[second[second < len(two)]] = START
        return np.stack([mix(one ^ _MIX[0]), mix(two ^ _MIX[1]), mix(one * _MIX[1] + two * _MIX[2])], 1)


def class_rows(contexts: np.ndarray) -> np.ndarray:
    """Weight rows of the classes' softmax: one for each feature, and the bias row."""
    rows = np.full((len(contexts), contexts.shape[1] + 1), 1 << FEATURE_BITS, np.int32)
    rows[:, :-1] = contexts >> np.uint64(64 - FEATURE_BITS)
    return rows


def cell_rows(contexts: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Weight rows of the cells' softmax: one for each feature with the class, and the class's bias row."""
    rows = np.empty((len(contexts), contexts.shape[1] + 1), np.int32)
    rows[:, :-1] = mix(contexts + (cls.astype(np.uint64) * _MIX[2])[:, None]) >> np.uint64(64 - CELL_FEATURE_BITS)
    rows[:, -1] = (1 << CELL_FEATURE_BITS) + cls
    return rows


def cell_of(hash_: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The word's cell in its class; classes of one word have one cell."""
    return np.where(cls < TOP_WORDS, 0, (mix(hash_ ^ _MIX[1]) >> np.uint64(64 - CELL_BITS)).astype(np.int64))


@dataclass
class Vocabulary:
    """Fixed-size facts about the training text."""

    n: int
    v: int
    heavy: np.ndarray
    heavy_log: np.ndarray
    top: np.ndarray
    suffix: np.ndarray
    cell_log: np.ndarray
    prior: np.ndarray
    cell_prior: np.ndarray

    def classes(self, hash_: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return classes(self.top, self.suffix, hash_, suffix)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10(count + 1) of heavy words, and which are heavy."""
        if not len(self.heavy):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.heavy, h), len(self.heavy) - 1)
        found = self.heavy[at] == h
        return np.where(found, self.heavy_log[at], 0.0), found


def classes(top: np.ndarray, suffixes: np.ndarray, hash_: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    out = TOP_WORDS + TOP_SUFFIXES + (hash_ % np.uint64(OTHER)).astype(np.int64)
    for listed, asked, base in ((suffixes, suffix, TOP_WORDS), (top, hash_, 0)):
        if len(listed):
            order = np.argsort(listed)
            at = np.minimum(np.searchsorted(listed[order], asked), len(listed) - 1)
            found = listed[order][at] == asked
            out[found] = base + order[at[found]]
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, s, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    h, at, inv = np.unique(h, return_index=True, return_inverse=True)
    return h, s[at], np.bincount(inv, c, len(h)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), suffix, n: over all texts of docs, ends included. Tasks add up their own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []

        def out() -> pa.RecordBatch:
            h, s, c = _merged(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(s), pa.array(c)], names=["word", "suffix", "n"])

        for batch in batches:
            for part in slices(batch, "text", NEAR_BYTES):
                t = Stream.of(part.column("text"))
                h, at, c = np.unique(t.hash, return_index=True, return_counts=True)
                parts.append((h, t.suffix[at], c))
                if len(parts) >= 64:
                    parts[:] = [_merged(parts)]
                    if len(parts[0][0]) > 1_500_000:
                        yield out()
        if parts:
            yield out()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, suffix long, n long")
    return counted.groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    heavy = counts.where(F.col("n") * (1 << HEAVY_BITS) >= n).select("word", "n").toPandas()  # at most 2^18 rows, as their counts add up to n at most
    h = unsigned(heavy["word"].to_numpy(np.int64))
    order = np.argsort(h)
    top = counts.orderBy(F.desc("n"), "word").limit(TOP_WORDS).select("word").toPandas()["word"].to_numpy(np.int64)
    suffix = counts.where(~F.col("word").isin(top.tolist())).groupBy("suffix").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "suffix").limit(TOP_SUFFIXES).select("suffix").toPandas()["suffix"].to_numpy(np.int64)
    top_u = unsigned(top)

    @F.pandas_udf("int")
    def place_of(word, suf):
        import pandas as pd

        h = unsigned(word.to_numpy(np.int64))
        cls = classes(top_u, suffix, h, suf.to_numpy(np.int64))
        return pd.Series((cls * CELLS + cell_of(h, cls)).astype(np.int32))

    cells = counts.groupBy(place_of("word", "suffix").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    size, tokens = np.ones(CLASSES * CELLS), np.ones(CLASSES * CELLS)
    tokens[cells["c"].to_numpy(int)] += cells["n"].to_numpy(float)
    size[cells["c"].to_numpy(int)] += (cells["n"] + cells["v"]).to_numpy(float)
    tokens = tokens.reshape(CLASSES, CELLS)
    per_class = tokens.sum(axis=1)
    prior, cell_prior = np.log(per_class / per_class.sum()), np.log(tokens / per_class[:, None])
    return Vocabulary(int(n), int(v), h[order], np.log10(heavy["n"].to_numpy(float)[order] + 1), top_u, suffix, np.log10(size), prior, cell_prior)


def _far_from_zero(weights: np.ndarray, columns: int) -> bool:
    """Whether sums of so many feature rows and a bias row may be beyond the powers of e that floats hold; by the weights alone,
    so that scores do not follow the slices."""
    n = 1 << ((len(weights) - 1).bit_length() - 1)
    features, bias = columns * max(weights[:n].max(), -weights[:n].min()), weights[n:]
    return bool(bias.max() + features > MOST_POWER or bias.max(axis=1).min() - features < -MOST_POWER)


def _scores(weights: np.ndarray, rows: np.ndarray, far: bool) -> np.ndarray:
    """Sums of the given weight rows; if far from 0, shifted so that the greatest of each token is 0."""
    s = np.take(weights, rows[:, 0], axis=0)
    more = np.empty_like(s)
    for f in range(1, rows.shape[1]):
        s += np.take(weights, rows[:, f], axis=0, out=more, mode="clip")
    if far:
        s -= s.max(axis=1, keepdims=True)
    return s


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    s = _scores(weights, rows, _far_from_zero(weights, rows.shape[1]))
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def log_share(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The targets' entries of log_softmax."""
    out = np.empty(len(target))
    far = _far_from_zero(weights, rows.shape[1])
    for i in range(0, len(target), NEAR_TOKENS):
        s = _scores(weights, rows[i : i + NEAR_TOKENS], far)
        asked = s[np.arange(len(s)), target[i : i + NEAR_TOKENS]]
        out[i : i + NEAR_TOKENS] = asked - np.log(np.exp(s, out=s).sum(axis=1))
    return out


def row_sums(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct weight rows, how many (token, feature) name each, and the sum of those tokens' g.

    The first token of every row is taken at once, then the second of those that have one, and so on; few
    rows have more than RANKS, and what they have beyond is one sum each."""
    flat = rows.T.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    sorted_rows, token = flat[order], order % len(g)
    heads = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    size = np.diff(np.append(heads, len(order)))
    largest = np.argsort(-size, kind="stable")
    heads, size = heads[largest], size[largest]
    total = np.take(g, token[heads], axis=0)
    for rank in range(1, RANKS):
        n = int(np.searchsorted(-size, -rank))  # rows with more than `rank` tokens
        if n == 0:
            break
        total[:n] += np.take(g, token[heads[:n] + rank], axis=0)
    for i in range(int(np.searchsorted(-size, -RANKS))):
        total[i] += g[token[heads[i] + RANKS : heads[i] + size[i]]].sum(axis=0)
    return sorted_rows[heads].astype(np.int64), size, total


def bias_sums(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As row_sums, for the few bias rows, which hold many tokens each."""
    least = rows.min()
    if least == rows.max():
        return rows[:1].astype(np.int64), np.array([len(rows)]), g.sum(axis=0, keepdims=True)
    order = np.argsort((rows - least).astype(np.uint16), kind="stable")  # sorted by radix
    heads = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0))
    return rows[order][heads].astype(np.int64), np.diff(np.append(heads, len(order))), np.add.reduceat(g[order], heads, axis=0)


def _gradient_step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One Adagrad step, in place, on tokens; a row's gradient is the sum of its tokens' by the root of their number.
    The bias rows (the last column) are named by every token, so their sums are taken apart."""
    g = np.empty((len(rows), weights.shape[1]), np.float32)
    far = _far_from_zero(weights, rows.shape[1])
    for i in range(0, len(rows), NEAR_TOKENS):
        s = _scores(weights, rows[i : i + NEAR_TOKENS], far)
        np.exp(s, out=s)
        np.divide(s, s.sum(axis=1, keepdims=True), out=g[i : i + NEAR_TOKENS])
    g[np.arange(len(target)), target] -= 1
    named, size, total = (np.concatenate(x) for x in zip(row_sums(rows[:, :-1], g), bias_sums(rows[:, -1], g), strict=True))
    total /= np.sqrt(size, dtype=np.float32)[:, None]
    seen = squares[named] + total * total
    squares[named] = seen
    weights[named] -= rate * total / np.sqrt(seen)


def first_weights(v: Vocabulary) -> list[np.ndarray]:
    """The classes' and the cells' weights before training: the features have to say only what differs from the plain shares."""
    of_classes = np.zeros(((1 << FEATURE_BITS) + 1, CLASSES), np.float32)
    of_classes[-1] = v.prior
    of_cells = np.zeros(((1 << CELL_FEATURE_BITS) + CLASSES, CELLS), np.float32)
    of_cells[1 << CELL_FEATURE_BITS :] = v.cell_prior
    return [of_classes, of_cells]


def train(docs: DataFrame, v: Vocabulary, rounds: int = 3, rate: float = 0.3) -> list[np.ndarray]:
    """Weights of the classes' and of the cells' softmax."""
    sc = docs.sparkSession.sparkContext
    weights = first_weights(v)
    text = F.col("text").cast("string")
    learners = max(1, -(-v.n // (rounds * TASK_TOKENS)))
    dealt = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("deal"))
    dealt = dealt.withColumn("learner", F.pmod(F.xxhash64("deal"), F.lit(learners)).cast("int"))
    for k in range(rounds):
        shared = sc.broadcast((weights, v))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, vocab = shared.value
            own, squares = [w.copy() for w in start], [np.full(w.shape, 1.0, np.float32) for w in start]
            touched = [np.zeros(len(w), bool) for w in start]
            for batch in batches:
                for part in slices(batch, "text"):
                    t = Stream.of(part.column("text"))
                    contexts, cls = t.contexts(), vocab.classes(t.hash, t.suffix)
                    inside = np.flatnonzero(cls >= TOP_WORDS)
                    to_do = ((class_rows(contexts), cls), (cell_rows(contexts[inside], cls[inside]), cell_of(t.hash[inside], cls[inside])))
                    for head, (rows, target) in enumerate(to_do):
                        for i in range(0, len(target), STEP_TOKENS):
                            _gradient_step(own[head], squares[head], rows[i : i + STEP_TOKENS], target[i : i + STEP_TOKENS], rate)
                        touched[head][rows.ravel()] = True
            if touched[0].any():
                change = [np.round((a - b) * UNIT).astype(np.int32).ravel() for a, b in zip(own, start, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([*change, *(x.astype(np.int32) for x in touched)]).tobytes()], pa.binary())], names=["change"])

        part = dealt.where(F.pmod("deal", F.lit(rounds)) == k).repartitionById(learners, "learner").sortWithinPartitions("deal", "doc_id", "text")
        changes = part.select("text").mapInArrow(run, "change binary").rdd
        zero = np.zeros(sum(w.size + len(w) for w in weights), np.int64)
        add = lambda a, b: a + b
        depth = max(2, int(np.ceil(np.log(max(2, changes.getNumPartitions())) / np.log(16))))  # 16 sums or fewer reach the driver
        found = changes.map(lambda r: np.frombuffer(bytes(r[0]), np.int32)).treeAggregate(zero, add, add, depth=depth)
        del changes
        release(docs.sparkSession)  # the round's shuffle files
        at, tasks = 0, len(found) - sum(map(len, weights))
        for head, w in enumerate(weights):
            change, touched = found[at : at + w.size].reshape(w.shape) / UNIT, found[tasks : tasks + len(w)]
            weights[head] = (w + change / np.maximum(touched, 1)[:, None]).astype(np.float32)
            at, tasks = at + w.size, tasks + len(w)
    return weights


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, weights: list[np.ndarray], is_held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((weights, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of_classes, of_cells), vocab = shared.value
        for batch in batches:
            for part in slices(batch, "text", NEAR_BYTES):
                t, rows = Stream.of(part.column("text")), part.num_rows
                doc = np.repeat(np.arange(rows), np.diff(t.first))
                contexts = t.contexts()
                words, at, inv = np.unique(t.hash, return_index=True, return_inverse=True)
                cls = vocab.classes(words, t.suffix[at])
                cell, (log, heavy) = cell_of(words, cls)[inv], vocab.lookup(words)
                cls = cls[inv]
                p = log_share(of_classes, class_rows(contexts), cls)
                inside = np.flatnonzero(cls >= TOP_WORDS)
                p[inside] += log_share(of_cells, cell_rows(contexts[inside], cls[inside]), cell[inside])
                model = np.bincount(doc, p * _LOG10E - vocab.cell_log[cls * CELLS + cell], rows)
                rare = ~heavy[inv]
                pair, tf = np.unique(doc[rare].astype(np.int64) << 32 | inv[rare], return_counts=True)
                offsets = np.searchsorted(pair >> 32, np.arange(rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(t.first)), pa.array(np.bincount(doc, heavy[inv], rows).astype(np.int64)), pa.array(np.bincount(doc, log[inv], rows)), pa.array(model),
                     list_array(signed(words[pair & 0xFFFFFFFF]), offsets, pa.int64()), list_array(tf.astype(np.int32), offsets, pa.int32())],
                    names=["doc_id", "held_out", "n_tokens", "known", "logs", "model", "rare", "tf"],
                )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, model double, rare array<long>, tf array<int>"
    flag = held_out(7, 2) if is_held_out is None else is_held_out
    local = write_table(docs.select("doc_id", flag.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-local")
    pairs = local.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("tf").alias("tf"))).alias("x")).select("row", "x.word", "x.tf")
    found = pairs.join(counts.where(F.col("n") * (1 << HEAVY_BITS) < v.n).select("word", "n"), "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.log10(F.col("n") + 1.0) * F.col("tf")).alias("more_logs"))
    out = local.drop("rare", "tf").join(found, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(v.n + v.v + 1)))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def run(docs: DataFrame) -> DataFrame:
    """Learn from the texts that are not held out (crc32(doc_id) mod 7 = 2) and score all."""
    seen = docs.where(~held_out(7, 2))
    counts = write_table(count_words(seen), "lm-counts")
    v = vocabulary(counts)
    return score(docs, counts, v, train(seen, v))
