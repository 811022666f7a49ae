"""URL rules by Bloom filter cascades.

A list of rule keys is stored as a cascade over the complete universe of keys that the corpus can
ask for: level 1 holds the listed keys, level 2 the unlisted keys of the universe that level 1 lets
pass, level 3 the listed keys that level 2 lets pass, and so on until nothing passes wrongly. Over
that universe the answer is exact, and asking needs no join: a page tests its own candidate keys.

A level is sized by its own keys and by those it is meant to stop: the more unlisted keys there are for each listed one,
the more bits and hashes a listed key gets, so that about half as many pass wrongly as are listed, whatever the corpus
holds, and levels shrink from the first.

The universe is one `distinct` over (host suffix, path prefix) keys. A level's filter is built by
`bit_or` over 64-bit words, so what reaches the driver is the filter, whose size is checked
against `most_bits`. Judging pages is row-local.

A page that no rule fits gets its verdict from a third cascade: the listed hosts (those with one of
LISTED_WORDS in a label) over all hosts of the corpus; listed ones are blocked, others allowed.

Defined results: a null url, or one without "://", has an empty host and path, no rule and the
default verdict; repeated urls and ids are judged row by row, and null ids stay null; an empty table gives no rows; urls
of any length are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import mix, unsigned, write_table

#: Rule (host and path) to verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DEFAULT = "allow"
#: Words of host labels that put a host on the block list.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "warez")
_SALT = 0x9E3779B97F4A7C15


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key of a rule that could fit: host suffixes with path prefixes of the given lengths,
    longest first (of equal ones, the longer host)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, path.substr(1, n)) for n in lengths)), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    ranked = F.sort_array(F.transform(F.array_distinct(keys), lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("host"), k.alias("k"))), asc=False)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(ranked, lambda r: r["k"]))


@dataclass
class Cascade:
    """Bit words of each level, asked by two 64-bit hashes of a key; `more` is the number of hashes of levels that have
    other than `hashes`."""

    hashes: int
    levels: list[np.ndarray] = field(default_factory=list)
    more: dict[int, int] = field(default_factory=dict)

    def positions(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        m = np.uint64(len(self.levels[level]) * 64)
        j = np.arange(1, self.more.get(level, self.hashes) + 1, dtype=np.uint64)[:, None]
        salt = np.uint64((level + 1) * _SALT % 2**64)  # small filters see few bits of a hash: other ones at each level
        return (mix(unsigned(h1) + salt) + j * (mix(unsigned(h2) ^ salt) | np.uint64(1))) % m

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p = self.positions(level, h1, h2)
        return ((self.levels[level][p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for the keys of the universe: the first level that a key fails decides."""
        listed = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.ones(len(h1), bool)
        for level in range(len(self.levels)):
            fails = open_ & ~self.passes(level, h1, h2)
            listed[fails] = level % 2 == 1
            open_ &= ~fails
        return listed


def _filter_words(keys: DataFrame, n: int, bits: int, hashes: int, level: int) -> np.ndarray:
    """The filter of a level: set bits are found on the executors and joined by bit_or."""
    words = max(1, -(-n * bits // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Cascade(hashes, [np.zeros(words, np.uint64)] * (level + 1))
        for b in batches:
            p = np.unique(shape.positions(level, b.column("h1").to_numpy(zero_copy_only=False), b.column("h2").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    found = keys.select("h1", "h2").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy(np.int64)] = unsigned(found["bits"].to_numpy(np.int64))
    return out


def build_cascade(universe: DataFrame, bits: int = 12, hashes: int = 4, most_bits: int = 1 << 28, most_levels: int = 40) -> Cascade:
    """universe: h1, h2, listed. Levels alternate between the two sides until no key passes wrongly."""
    cascade = Cascade(hashes)
    sides = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    for level in range(most_levels):
        inside = universe.where(F.col("listed") if level % 2 == 0 else ~F.col("listed"))
        for i in range(level):  # a key gets here only through all levels before
            inside = inside.where(_passes(cascade, i)(F.col("h1"), F.col("h2")))
        n = inside.count()
        if n == 0:
            return cascade
        size, asked = bits, hashes
        if level == 0 and sides.get(False, 0) > n:
            wrong = n / (2 * sides[False])  # the share of unlisted keys that may pass
            asked = max(hashes, int(np.ceil(-np.log2(wrong))))
            size = max(bits, int(np.ceil(-asked / np.log(1 - wrong ** (1 / asked)))))
        if n * size > most_bits:
            raise ValueError(f"{n} keys at level {level + 1} need {n * size} bits; the limit is {most_bits}")
        cascade.more[level] = asked
        cascade.levels.append(_filter_words(inside, n, size, asked, level))
    raise ValueError(f"no end after {most_levels} levels: two keys share both hashes")


def _passes(cascade: Cascade, level: int):
    frozen = Cascade(cascade.hashes, list(cascade.levels), dict(cascade.more))

    @F.pandas_udf("boolean")
    def passes(h1, h2):
        import pandas as pd

        return pd.Series(frozen.passes(level, h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

    return passes


def listed_host(host: Column, words: tuple[str, ...]) -> Column:
    return host.rlike(rf"(?:^|[.-])(?:{'|'.join(words)})(?:[.-]|$)") if words else F.lit(False)


def judge(pages: DataFrame, rules: dict[str, str] | None = None, words: tuple[str, ...] = LISTED_WORDS, default: str = DEFAULT, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest fitting one, or null), verdict."""
    rules = RULES if rules is None else rules
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    lengths = sorted({len(r) - r.index("/") if "/" in r else 0 for r in rules})
    host, path = host_path(F.col(url).cast("string"))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    hashes = lambda k: (F.xxhash64(k), F.xxhash64(F.lit("second"), k))
    hosts = split.select("host").where(F.col("host") != "").distinct()
    h1, h2 = hashes(F.col("host"))
    host_cascade = build_cascade(write_table(hosts.select(h1.alias("h1"), h2.alias("h2"), listed_host(F.col("host"), words).alias("listed")), "url-hosts"))
    cascades: dict[str, Cascade] = {}
    if rules:
        k1, k2 = hashes(F.col("key"))
        universe = keyed.select(F.explode("keys").alias("key")).distinct().select("key", k1.alias("h1"), k2.alias("h2"))
        listed = spark.createDataFrame(list(rules.items()), "key string, verdict string")
        universe = write_table(universe.join(listed, "key", "left").select("h1", "h2", "verdict"), "url-keys")
        for verdict in sorted(set(rules.values())):
            cascades[verdict] = build_cascade(universe.select("h1", "h2", (F.coalesce(F.col("verdict"), F.lit("")) == verdict).alias("listed")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            row = np.repeat(np.arange(b.num_rows), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat, a, c = keys.flatten(), *(b.column(h).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for h in ("h1", "h2"))
            best = np.full(b.num_rows, len(flat))
            host = host_cascade.member(*(b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("host1", "host2"))) & (pc.binary_length(b.column("host")).to_numpy(zero_copy_only=False) > 0)
            said = np.where(host, "block", default).astype(object)
            for verdict, cascade in cascades.items():
                at = np.flatnonzero(cascade.member(a, c)) if len(flat) else np.zeros(0, np.int64)
                rows, first = np.unique(row[at], return_index=True)
                wins = at[first] < best[rows]
                best[rows[wins]] = at[first][wins]
                said[rows[wins]] = verdict
            rule = flat.take(pa.array(best, mask=best == len(flat), type=pa.int64())) if len(flat) else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("page_id", "host", "path")), rule, pa.array(said, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    asked = keyed.select("*", F.transform("keys", lambda k: hashes(k)[0]).alias("h1"), F.transform("keys", lambda k: hashes(k)[1]).alias("h2"), h1.alias("host1"), h2.alias("host2"))
    return asked.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
