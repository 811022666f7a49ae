"""Byte-level BPE encoding and decoding of whole texts, in length-bucketed padded numpy matrices.

A text is cut into pieces by the vocabulary's pattern; the distinct pieces of a batch that are no token themselves
become rows of symbol matrices, one matrix for each range of lengths, so that padding at most doubles them. Each
round, every row merges its leftmost pair of lowest rank; ranks of the two pairs that a merge makes are looked up in
an open hash table over pairs of symbols, and rows without a known pair leave the matrix (compaction). A round costs
a row as much as the row is long, so pieces beyond LONG bytes (no words, but runs of one character, say) merge all
places of the lowest pair in one round, up to the first place where that makes a pair of still lower rank.

Row-local: no shuffle. The vocabulary (its size is checked) is read once by the driver and broadcast, so executors
need no file. Null texts count as empty and give no ids; ids and texts of any length are whole; repeated rows give
repeated results; only the id and the text are read, so other columns may have any names; null ids stay null, and an
empty table gives no rows. `decode` raises an error for ids that the vocabulary lacks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices

#: A vocabulary above this many entries is refused, as it is broadcast.
MOST_ENTRIES = 1_000_000
#: Distinct pieces that a task remembers before it starts anew.
REMEMBERED = 200_000
#: Pieces of more bytes are merged apart, many places a round.
LONG = 256
#: Symbols of one matrix at most.
CELLS = 1 << 20

#: White space in the sense of the pattern's \s.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEVER = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) to merged id, by open addressing with linear probing over a power of two of slots."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(len(made) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, _NEVER, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, left_over = self._slot(key), np.arange(len(key))
        while len(left_over):
            free = left_over[self.keys[slot[left_over]] < 0]
            self.keys[slot[free]] = key[free]  # of several for one slot the last wins
            won = free[self.keys[slot[free]] == key[free]]
            self.made[slot[won]] = made[won]
            left_over = left_over[self.keys[slot[left_over]] != key[left_over]]
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes, which is its rank too; _NEVER where it makes none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        out = np.full(len(key), _NEVER, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.made[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


@dataclass
class Vocabulary:
    """What encoding and decoding need of a rank file: token bytes by id, and the pairs that make tokens."""

    pattern: str
    whole: dict[bytes, bytes]
    pairs: PairTable
    single: np.ndarray
    bytes_flat: np.ndarray
    bytes_end: np.ndarray

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if len(ids) > MOST_ENTRIES or max(ids.values()) >= 2 * MOST_ENTRIES:
            raise ValueError(f"a vocabulary of {len(ids)} entries is too large to broadcast")
        found = [(ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        left, right, made = np.array(found, np.int64).reshape(-1, 3).T
        by_id = {i: t for t, i in ids.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        return Vocabulary(pattern, {t: i.to_bytes(4, "little") for t, i in ids.items()}, PairTable(left, right, made), np.array([ids[bytes([b])] for b in range(256)], np.int32), flat, np.cumsum([len(t) for t in tokens]))


def _padded(pieces: list[bytes], v: Vocabulary, width: int) -> np.ndarray:
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    matrix = np.full((len(pieces), width), -1, np.int32)
    matrix[np.arange(width) < length[:, None]] = v.single[np.frombuffer(b"".join(pieces), np.uint8)]
    return matrix


def _rows(symbols: np.ndarray) -> list[bytes]:
    """Each row without its padding, as little-endian 32-bit integers."""
    real = symbols >= 0
    flat, to = symbols[real].astype("<i4", copy=False).tobytes(), (4 * np.cumsum(real.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]


def merge_matrix(pieces: list[bytes], v: Vocabulary, width: int) -> list[bytes]:
    """Ids of pieces of width bytes at most, as little-endian 32-bit integers."""
    symbols = _padded(pieces, v, width)
    rank = np.full(symbols.shape, _NEVER, np.int32)  # of each symbol with the next one
    rank[:, :-1] = v.pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(pieces), width - 1)
    row = np.arange(len(pieces))
    done = [b""] * len(pieces)
    while len(row):
        at = rank.argmin(axis=1)  # the leftmost of equal ones
        lowest = rank[np.arange(len(row)), at]
        over = lowest == _NEVER
        if over.any():
            for r, ids in zip(row[over].tolist(), _rows(symbols[over]), strict=True):
                done[r] = ids
            row, symbols, rank, at, lowest = (x[~over] for x in (row, symbols, rank, at, lowest))
            if not len(row):
                break
            most = int((symbols >= 0).sum(axis=1).max())
            if 2 * most <= symbols.shape[1]:  # columns that no row needs any more
                symbols, rank = symbols[:, :most], rank[:, :most].copy()
                rank[:, -1] = _NEVER
        each = np.arange(len(row))
        symbols[each, at] = lowest
        after = np.arange(symbols.shape[1] - 1) > at[:, None]
        symbols[:, :-1][after] = symbols[:, 1:][after]
        symbols[:, -1] = -1
        rank[:, :-1][after] = rank[:, 1:][after]
        rank[:, -1] = _NEVER
        wide = symbols.shape[1]
        follows = np.where(at + 1 < wide, symbols[each, np.minimum(at + 1, wide - 1)], -1)
        rank[each, at] = v.pairs(symbols[each, at], follows)
        has = np.flatnonzero(at > 0)
        rank[has, at[has] - 1] = v.pairs(symbols[has, at[has] - 1], symbols[has, at[has]])
    return done


def merge_long(piece: bytes, v: Vocabulary) -> np.ndarray:
    """Ids of one long piece: each round merges the places of its lowest pair, from the left.

    Merging them one by one would go on with the same rank as long as no merge makes a pair of a lower one, so they
    are merged at once up to the first place that does."""
    symbols = v.single[np.frombuffer(piece, np.uint8)]
    rank = v.pairs(symbols[:-1], symbols[1:])
    while len(rank) and (lowest := rank.min()) != _NEVER:
        at = np.flatnonzero(rank == lowest)
        # Places one behind the other overlap: from the left, every other one of such a run merges.
        new_run = np.append(True, np.diff(at) > 1)
        within = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[within % 2 == 0]
        made = np.full(len(at), lowest, np.int32)
        # The neighbours at the moment of each merge: to the left all merges are done, to the right none is.
        left = np.where(at > 0, symbols[np.maximum(at - 1, 0)], -1)
        joined = np.flatnonzero(np.append(False, at[1:] - at[:-1] == 2))
        left[joined] = lowest
        right = np.where(at + 2 < len(symbols), symbols[np.minimum(at + 2, len(symbols) - 1)], -1)
        lower = np.flatnonzero((v.pairs(left, made) < lowest) | (v.pairs(made, right) < lowest))
        if len(lower):
            at = at[: lower[0] + 1]
        symbols = symbols.copy()
        symbols[at] = lowest
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        rank = v.pairs(symbols[:-1], symbols[1:])
    return symbols


def merge(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each piece, as little-endian 32-bit integers; a piece that is a token as a whole has that id."""
    done = list(map(v.whole.get, pieces))
    buckets: dict[int, list[int]] = {}
    for k in [k for k, ids in enumerate(done) if ids is None]:
        n = len(pieces[k])
        if n > LONG:
            done[k] = merge_long(pieces[k], v).astype("<i4").tobytes()
        else:
            buckets.setdefault(1 << (n - 1).bit_length(), []).append(k)
    for width, members in buckets.items():
        step = max(1, CELLS // width)
        for lo in range(0, len(members), step):
            own = members[lo : lo + step]
            for k, ids in zip(own, merge_matrix([pieces[k] for k in own], v, width), strict=True):
                done[k] = ids
    return done


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.pieces = regex.compile(v.pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")).findall
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        distinct = set().union(*cut)
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(distinct)
        self.known.update(zip(new, merge([p.encode() for p in new], self.v), strict=True))
        ids = self.known.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in cut]


def decode(ids: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, and where those of each text end; ends: where each text's ids end."""
    length = np.diff(v.bytes_end, prepend=0)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or not length[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    n = length[ids]
    to = np.cumsum(n)
    at = np.repeat(v.bytes_end[ids] - to, n) + np.arange(int(to[-1]) if len(to) else 0)
    return v.bytes_flat[at], np.append(0, to)[ends]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of ints), decoded (the bytes that the ids stand for)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, pattern))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = Encoder(v)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                own = encoder([x or "" for x in part.column("text").to_pylist()])
                ends = np.append(0, np.cumsum([len(x) // 4 for x in own]))
                ids = np.frombuffer(b"".join(own), "<i4")
                data, offsets = decode(ids, ends, v)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                decoded = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, decoded], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of the ids, in decimal with single spaces, and of the decoded bytes."""
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
