"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of a text, so
that a pair of terms can count for more than both alone. The model is fitted on a bounded sample
of labelled rows (`most_labelled`, at most half of them toxic; chosen by a hash of the id); every
text is scored, whole.

The sample is drawn by a top-k of hashes and its ids are joined by broadcast, bounded by
`most_labelled`; scoring is row-local with a model of fixed size. Texts are never shuffled.

Kept are at most `features` hashed terms (3,000: half by the z-score of their presence in toxic rows, half by
frequency); other terms score nothing. That bounds the model, not the rows that are scored.

Defined results: an empty table gives no rows; a null id is scored, counts as not held out, and has no label; very long
texts are read whole, by the slice; other columns, whatever their names, are ignored; null or empty texts get the model's intercept; null or missing labels are not
learnt from; of several labels of a document the highest counts; repeated rows are scored row by
row; without labels every score is 0.5 less a hair, thus predicted 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Words, held_out, list_array, slices

#: Documented bound of the labelled sample.
MOST_LABELLED = 16_000
BUCKET_BITS = 20
#: Besides whole words, their first bytes are terms: inflected and compound forms share them.
STEMS = (4, 5, 6)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed terms of each text: words and word beginnings."""
    w = Words(column, alphanumeric=True)
    rows, hashes = [w.doc], [w.hash]
    for k in STEMS:
        at = np.flatnonzero(w.end - w.start >= k)
        rows.append(w.doc[at])
        hashes.append(w.prefix_hash(at, k))
    row, h = np.concatenate(rows).astype(np.int64), np.concatenate(hashes)
    pairs = np.unique(row << BUCKET_BITS | (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


@dataclass
class Machine:
    """index: bucket to feature, -1 if not in the model; w0, w, v: the weights."""

    index: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        out = self.w0 + np.bincount(row, self.w[feature], n)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(buckets: list[np.ndarray], label: np.ndarray, weight: np.ndarray, factors: int = 4, features: int = 3000, epochs: int = 12, rate: float = 0.08, l2: float = 2e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss. Kept features: the strongest by the z-score of their presence
    in toxic rows, and the most frequent ones, which may matter in pairs only."""
    size = 1 << BUCKET_BITS
    index = np.full(size, -1, np.int32)
    n_pos = float(label.sum())
    if not len(label) or n_pos in (0.0, float(len(label))):
        return Machine(index, -1e-6 if not n_pos else 1e-6, np.zeros(1), np.zeros((1, factors)))
    lens = np.array([len(b) for b in buckets])
    row, flat = np.repeat(np.arange(len(buckets)), lens), np.concatenate(buckets)
    pos, all_ = np.bincount(flat, label[row], size), np.bincount(flat, minlength=size)
    share = n_pos / len(label)
    z = (pos - share * all_) / np.sqrt(share * (1 - share) * all_ + 1e-9) * (all_ >= 3)
    chosen = np.union1d(np.argsort(-np.abs(z), kind="stable")[: features // 2], np.argsort(-all_, kind="stable")[: features // 2])
    chosen = chosen[all_[chosen] >= 3]
    index[chosen] = np.arange(len(chosen))
    keep = index[flat] >= 0
    row, feature = row[keep], index[flat[keep]]
    first = np.searchsorted(row, np.arange(len(label) + 1))

    rng = np.random.default_rng(seed)
    w0, w = np.log(share / (1 - share)), np.zeros(len(chosen))
    v = rng.normal(0, 0.01, (len(chosen), factors))
    g0, gw, gv = 1e-6, np.full(len(chosen), 1e-6), np.full(v.shape, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            f, r = feature[at], np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
            sums = np.stack([np.bincount(r, v[f, k], len(batch)) for k in range(factors)], 1)
            squares = np.bincount(r, (v[f] ** 2).sum(1), len(batch))
            y = w0 + np.bincount(r, w[f], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            d = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[batch]) * weight[batch] / len(batch)
            used, inv = np.unique(f, return_inverse=True)
            dw = np.bincount(inv, d[r], len(used)) + l2 * w[used]
            dv = np.stack([np.bincount(inv, d[r] * (sums[r, k] - v[f, k]), len(used)) for k in range(factors)], 1) + l2 * v[used]
            g0 += d.sum() ** 2
            w0 -= rate * d.sum() / np.sqrt(g0)
            gw[used] += dw**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv**2
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return Machine(index, float(w0), w, v)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Machine:
    """docs: doc_id, text; labels: doc_id, toxic. Rows held out (crc32(doc_id) mod 5 = 0) are not seen."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(5, 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    half = most_labelled // 2
    pick = lambda k: known.where((F.col("toxic") > 0) == bool(k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
    total = known.groupBy((F.col("toxic") > 0).alias("toxic")).count().toPandas()
    n_neg = int(total.loc[~total["toxic"].astype(bool), "count"].sum())
    sample = pick(1).unionByName(pick(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket = _terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), list_array(bucket.astype(np.int32), np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())], names=["toxic", "buckets"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, buckets array<int>").toArrow()
    label = rows.column("toxic").to_numpy().astype(float) > 0
    buckets = [np.asarray(x, np.int64) for chunk in rows.column("buckets").chunks for x in np.split(chunk.flatten().to_numpy(zero_copy_only=False), np.cumsum(chunk.value_lengths().to_numpy(zero_copy_only=False))[:-1])] if len(rows) else []
    order = sorted(range(len(buckets)), key=lambda i: (bool(label[i]), len(buckets[i]), buckets[i].tobytes()))  # not the order in which tasks end
    label, buckets = label[order].astype(float), [buckets[i] for i in order]
    dropped = max(1.0, n_neg / max(1, (label == 0).sum()))
    return fit(buckets, label, np.where(label > 0, 3.0, min(dropped, 3.0)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket = _terms(part.column("text"))
                feature = m.index[bucket]
                s = m.scores(row[feature >= 0], feature[feature >= 0], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(5, 0).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
