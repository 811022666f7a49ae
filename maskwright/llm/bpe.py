"""BPE encoding and decoding of whole texts, by batched numpy merge rounds.

The new words of a batch are laid out as symbols in one flat array. Each round finds every
neighbouring pair's rank by binary search over the sorted pair keys, takes each word's lowest, and
merges all places that hold it at once; it ends when no word has a known pair. Words are encoded
once and remembered in a dictionary of bounded size.

Row-local: no shuffle. The vocabulary (its size is checked) is read once by the driver and
broadcast, so executors need no file. Null texts count as empty and give no ids; ids and texts of
any length are whole; repeated rows give repeated results; other columns are dropped by
`encode`, which returns only the id, the token ids and the decoded text; null ids stay null, and an empty table gives
no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices

#: A vocabulary above this many entries is refused, as it is broadcast.
MOST_ENTRIES = 1_000_000
#: Words that a task remembers before it starts anew.
REMEMBERED = 200_000

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT_SPACE = re.compile(f"[{_SPACE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a tokenizer file (BPE with word ends)."""

    tokens: list[str]
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    special: dict[str, int]
    pattern: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, suffix = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in j["added_tokens"]}
        n = max([*vocab.values(), *special.values()]) + 1
        if n > MOST_ENTRIES:
            raise ValueError(f"a vocabulary of {n} entries is too large to broadcast")
        tokens = [""] * n
        for t, i in [*vocab.items(), *special.items()]:
            tokens[i] = t
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"])]
        left, right, made = np.array(merges, np.int64).reshape(-1, 3).T
        order = np.argsort(keys := left << 32 | right)
        chars = _byte_chars()
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return Vocabulary(tokens, keys[order], np.arange(len(keys))[order], made[order], np.array([vocab[c] for c in chars]), np.array([vocab[c + suffix] for c in chars]), special, pattern)


def merge_rounds(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Token ids of each word."""
    if not words:
        return []
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym = v.inner[flat]
    last = np.cumsum(length) - 1
    sym[last] = v.final[flat[last]]
    word = np.repeat(np.arange(len(words)), length)
    done_sym, done_word = [], []
    never = len(v.pair_keys)
    while len(sym):
        key = sym[:-1] << 32 | sym[1:]
        at = np.append(np.minimum(np.searchsorted(v.pair_keys, key), never - 1), 0)
        known = (v.pair_keys[at[:-1]] == key) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, v.pair_ranks[at[:-1]], never), never)
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(word))))
        over = lowest == never
        if over.any():  # words without a known pair are finished and leave the array
            done_sym.append(sym[over])
            done_word.append(word[over])
            at, rank, lowest, sym, word = (x[~over] for x in (at, rank, lowest, sym, word))
            if not len(sym):
                break
        hit = rank == lowest
        # In a run such as (x,x),(x,x) the pairs overlap: from the left, every other one merges.
        place = np.arange(len(hit))
        run = place - np.maximum.accumulate(np.where(hit, -1, place))
        hit &= run % 2 == 1
        sym = np.where(hit, v.pair_ids[at], sym)
        keep = np.append(True, ~hit[:-1])
        sym, word = sym[keep], word[keep]
    ids, owner = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(owner, kind="stable")
    return np.split(ids[order].astype("<u4"), np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.pretokens = regex.compile(v.pattern.replace(r"\s", _SPACE)).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.known: dict[str, bytes] = {s: int(i).to_bytes(4, "little") for s, i in v.special.items()}
        self.fixed = dict(self.known)

    def split(self, text: str) -> list[str]:
        """White-space separated pieces, special tokens apart."""
        if self.special and any(s in text for s in self.v.special):
            return [w for part in self.special.split(text) for w in ([part] if part in self.v.special else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):  # str.split would take these for white space
            return [w for w in _SPLIT_SPACE.split(text) if w]
        return text.split()

    def learn(self, new: list[str]) -> None:
        parts: list[bytes] = []
        count = []
        for w in new:
            if not w.isascii():
                w = unicodedata.normalize("NFC", w)
            w = "".join(map(str.lower, w)) if "Σ" in w else w.lower()
            found = self.pretokens(w)
            count.append(len(found))
            parts += [x.encode() for x in found]
        distinct = list(dict.fromkeys(parts))
        ids = dict(zip(distinct, (x.tobytes() for x in merge_rounds(distinct, self.v)), strict=True))
        at = 0
        for w, n in zip(new, count, strict=True):
            self.known[w] = b"".join([ids[p] for p in parts[at : at + n]])
            at += n

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict(self.fixed)
            new = list(dict.fromkeys(w for words in split for w in words if w not in self.fixed))
        self.learn(new)
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]


def decode(ids: bytes, tokens: list[str]) -> str:
    """The file names no decoder: tokens joined by spaces."""
    return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as binary), decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = Encoder(v)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = encoder([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.array([decode(x, v.tokens) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    def hex256(c: Column) -> Column:
        return F.sha2(c, 256)

    return encoded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), hex256(F.col("ids")).alias("ids_sha256"), hex256(F.col("decoded").cast("binary")).alias("decoded_sha256"))
