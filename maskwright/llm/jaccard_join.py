"""N-gram Jaccard join by T-occurrence search, after DivideSkip.

A document's set holds its distinct 3-word shingles. With a set of n shingles, a partner shares at
least T of them, so a link's two sets meet in one of the n - T + 1 rarest lists of each (any fixed order of
the shingles would do; rare ones first keeps lists short). Those lists are made by a shuffle; a list's
nodes are what T-occurrence search has to tell apart:

1. Equal sets are one node, however many copies there are.
2. Each node is tested against one other: of the first nodes of its lists, the one it meets in most.
   Then, in lists whose nodes are not yet in one component, one node of each component is tested against
   the first's. A group of linked copies costs one test a member and list, not one a pair.
3. Lists that still hold several components are searched whole. One of up to FEW nodes gives its pairs, less
   those that cannot reach T after they first meet or meet too seldom. A longer one is dealt in blocks of
   sets (by length and salt), and each two blocks meet in one task. A first pass takes the sets' short lists alone and
   tells the nodes that meet some other often enough; for these, whole sets are read, and the task runs DivideSkip (`t_occurrence`): the
   inverted lists of one block are divided for each set of the other; short ones are merged with a
   count, and sets that are met often enough are probed in the long ones by binary search, until T is reached or out
   of reach. Pairs below T end there; of the links a block finds, only a spanning forest leaves the task.

So no pair that could link two components is left out, and rows grow with the nodes and lists, not with pairs.
Two blocks are compared in the first list that a pair shares only.

Which lists are long is told by shingles that tasks see repeatedly, counted over all documents; the
most frequent 2^17 at most are broadcast, others order by hash. That order only decides how much work
there is: any fixed order finds every link.

Defined results: null and empty texts, and those without words, have no set, n_shingles 0, and stand
alone; of fewer than three words the whole sequence is one shingle; rows with a null id have a null
component unless they equal others, and link through those only; repeated rows and ids fare alike; an empty table
gives an empty result; very long texts are read by the slice, and a set takes 8 bytes a shingle in the block
it is compared in (blocks hold 2^20 shingles, or one set); other columns, whatever their names, are ignored. Shingles
are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Words, drop_tables, list_array, mix, signed, slices, unsigned, write_table
from maskwright.llm.graph import components

LONG_LISTS = 1 << 17
LOCAL_SHINGLES = 8_000_000
#: One short list more for so many.
SPARE = 4
#: Nodes of a list that is paired as rows; longer ones are compared in blocks of so many nodes and shingles.
FEW, BLOCK_NODES, BLOCK_SHINGLES = 32, 256, 1 << 20
#: Weight of the longest list's logarithm in DivideSkip's number of long lists, and postings merged at once.
MU, AT_ONCE = 0.1, 1 << 21


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and offsets."""
    w = Words(column)
    row, _, h = w.shingles(k)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(w.n_docs + 1))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """T of a set of n shingles, for the smallest partner that may link."""
    smallest = -(-percent * n // 100)
    return np.maximum(1, -(-percent * (n + smallest) // (100 + percent)))


def spare(n, least):
    """Short lists beyond the n - T + 1 that a link needs; it must be met in one list more for each."""
    return (n - least + 1) // SPARE


def short_lists(n: np.ndarray, percent: int) -> np.ndarray:
    least = least_overlap(n, percent)
    return np.minimum(n, n - least + 1 + spare(n, least))


def needed(n: str, percent: int) -> Column:
    """The n - T + 1 lists of which a linked set has at least one in common."""
    return F.expr(f"{n} - greatest(1, ({percent} * ({n} + (({percent} * {n} + 99) div 100)) + {99 + percent}) div {100 + percent}) + 1")


def must_meet(n: str, m: str, percent: int) -> Column:
    """In how many short lists two linked sets of n and m shingles meet at least."""

    def extra(c: str) -> str:
        smallest = f"(({percent} * {c} + 99) div 100)"
        return f"(({c} - greatest(1, ({percent} * ({c} + {smallest}) + {99 + percent}) div {100 + percent}) + 1) div {SPARE})"

    return F.expr(f"1 + least({extra(n)}, {extra(m)})")


def long_lists(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that tasks see in several documents; at most LONG_LISTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(h[c > 1])), pa.array(c[c > 1])], names=["h", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(shingle_sets(part.column("text"), k)[0])
                if sum(map(len, held)) > LOCAL_SHINGLES:
                    yield out()
        if held:
            yield out()

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = write_table(counts.where("n > 2"), "jaccard-counts")
    # the least count that leaves no more than LONG_LISTS
    level = F.floor(4 * F.log2("n")).cast("int")
    left, cut = LONG_LISTS, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= r["count"]
        if left < 0:
            break
        cut = r["level"]
    top = counts.where(level >= cut).toPandas() if cut is not None else counts.limit(0).toPandas()
    h = unsigned(top["h"].to_numpy(np.int64))
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (hashes of the set), short (the shingles whose lists are merged)."""
    shared = docs.sparkSession.sparkContext.broadcast(long_lists(docs, k))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = shingle_sets(part.column("text"), k)
                n = np.diff(first)
                row = np.repeat(np.arange(part.num_rows), n)
                sums = [np.zeros(part.num_rows, np.uint64) for _ in range(2)]
                some = n > 0
                if some.any():
                    heads = first[:-1][some]
                    sums[0][some] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5)), heads)
                    sums[1][some] = np.add.reduceat(mix(h + np.uint64(0x1234567)), heads)
                weight = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    weight = np.where(common[at] == h, count[at], 0)
                order = np.lexsort((h, weight, row))
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                taken = place < short_lists(n, percent)[row]
                short = h[order][taken]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[taken], minlength=part.num_rows))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(signed(sums[0])), pa.array(signed(sums[1])), list_array(signed(short), offsets, pa.int64())], names=["doc_id", "n", "s1", "s2", "short"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, short array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, words (the sorted set) of the given nodes; their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = shingle_sets(part.column("text"), k)
                n = np.diff(first)
                s = np.zeros(part.num_rows, np.uint64)
                if (n > 0).any():
                    s[n > 0] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5)), first[:-1][n > 0])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(signed(s)), list_array(signed(h), first, pa.int64())], names=["doc_id", "n", "s1", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
    made = texts.mapInArrow(run, f"doc_id {kind}, n long, s1 long, words array<long>")
    return made.join(nodes.select("doc_id", "n", "s1", "node"), ["doc_id", "n", "s1"]).select("node", "n", "words").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (unsigned(np.asarray(c[i].values.to_numpy(zero_copy_only=False), np.int64)) for c in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                need = -(-percent * (len(p) + len(q)) // (100 + percent))
                got, left = 0, len(p)
                for part in np.array_split(p, max(1, len(p) // 512)):  # until T is reached or out of reach
                    got += int((q[np.minimum(np.searchsorted(q, part), len(q) - 1)] == part).sum())
                    left -= len(part)
                    if got >= need or got + left < need:
                        break
                ok[i] = got >= need
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    full = pairs.join(sets.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def needed_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """T of each two sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start to start + size - 1 of each, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def t_occurrence(x: np.ndarray, x_first: np.ndarray, y: np.ndarray, y_first: np.ndarray, need: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which pairs of sets share `need` shingles: booleans (sets of y, sets of x), for the pairs asked for.

    x and y are flat, x_first and y_first the sets' offsets. The inverted lists of x are divided for each set
    of y: its longest, T / (MU log2(longest) + 1) of them, are set aside; the short ones are merged with a
    count. A set met T - (number set aside) times is probed in the long ones."""
    n_x, n_y = len(x_first) - 1, len(y_first) - 1
    words, word = np.unique(x, return_inverse=True)
    row = np.repeat(np.arange(n_x), np.diff(x_first))
    order = np.argsort(word, kind="stable")
    lists, heads = row[order], np.searchsorted(word[order], np.arange(len(words) + 1))
    at = np.minimum(np.searchsorted(words, y), len(words) - 1)
    has = words[at] == y
    y_row = np.repeat(np.arange(n_y), np.diff(y_first))[has]
    at = at[has]
    size = heads[at + 1] - heads[at]
    order = np.lexsort((size, y_row))
    at, size, y_row = at[order], size[order], y_row[order]
    first = np.searchsorted(y_row, np.arange(n_y + 1))
    place = np.arange(len(at)) - first[y_row]
    n = np.diff(first)
    least = np.where(asked, need, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
    longest = np.ones(n_y, np.int64)
    longest[n > 0] = size[first[1:][n > 0] - 1]
    aside = np.clip((least / (MU * np.log2(longest + 1) + 1)).astype(np.int64), 0, np.minimum(n, least - 1))
    aside[~asked.any(axis=1)] = n[~asked.any(axis=1)]
    short = np.flatnonzero(place < (n - aside)[y_row])
    count = np.zeros(n_y * n_x, np.int64)
    done, total = 0, np.cumsum(size[short])
    while done < len(short):  # the merge, so many postings at a time
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE, "right")))
        s = short[done:to]
        met = lists[_ranges(heads[at[s]], size[s])]
        count += np.bincount(np.repeat(y_row[s], size[s]) * n_x + met, minlength=n_y * n_x)
        done = to
    count = count.reshape(n_y, n_x)
    reached = asked & (count >= need)
    open_y, open_x = np.nonzero(asked & ~reached & (count + aside[:, None] >= need))
    got, t = count[open_y, open_x], need[open_y, open_x]
    keys = np.sort(row * len(words) + word)
    step = np.zeros(len(open_y), np.int64)
    while len(open_y):  # the long lists, shortest first: whether they hold the candidate
        i = (first[1:] - aside)[open_y] + step
        key = open_x * len(words) + at[np.minimum(i, len(at) - 1)]
        got = got + (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
        step = step + 1
        yes = got >= t
        reached[open_y[yes], open_x[yes]] = True
        on = ~yes & (got + aside[open_y] - step >= t)
        open_y, open_x, got, t, step = open_y[on], open_x[on], got[on], t[on], step[on]
    return reached


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))


def _some(flat: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first)[rows]
    return flat[_ranges(first[rows], size)], np.append(0, np.cumsum(size))


def forest(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which links (positions a, b) join groups that those before left apart."""
    parent = {int(g): int(g) for g in group}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    kept = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(group[a].tolist(), group[b].tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept[k] = True
    return kept


def least_meetings(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """must_meet of each two sets."""
    return 1 + np.minimum(*(spare(x, least_overlap(x, percent)) for x in (n, m)))


def _block_links(rows: DataFrame, percent: int, short: bool = False) -> DataFrame:
    """(a, b): links found among two blocks of a list. rows: h, g, i, j, salt, node, n, at, lower, component,
    early (the node's lists before h), words (its set). With `short`, words are the nodes' short lists, and what is
    found are nodes (a; b is null) that meet another one often enough to link."""

    def run(table: pa.Table) -> pa.Table:
        node, n, at, group, salt = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "at", "component", "salt"))
        lower = table.column("lower").to_numpy(zero_copy_only=False).astype(bool)
        words, first = _flat(table.column("words"))
        early, early_first = _flat(table.column("early"))
        one = table.column("i")[0] == table.column("j")[0]
        xs = np.flatnonzero(salt == table.column("i")[0].as_py())
        ys = xs if one else np.flatnonzero(salt == table.column("j")[0].as_py())
        a, b = [], []
        wx, fx = _some(words, first, xs)
        ex, gx = _some(early, early_first, xs)
        for at_y in range(0, len(ys), 256):
            y = ys[at_y : at_y + 256]
            need = needed_overlap(n[y][:, None], n[xs][None, :], percent)
            asked = (group[y][:, None] != group[xs][None, :]) & (lower[y][:, None] | lower[xs][None, :])
            asked &= np.minimum((n - at)[y][:, None], (n - at)[xs][None, :]) >= need
            if one:
                asked &= y[:, None] < xs[None, :]
            if not asked.any():
                continue
            if len(ex) and not short:  # pairs that share an earlier list are compared there
                wy, fy = _some(early, early_first, y)
                asked &= ~t_occurrence(ex, gx, wy, fy, np.ones_like(need), asked)
            wy, fy = _some(words, first, y)
            if short:
                need = least_meetings(n[y][:, None], n[xs][None, :], percent)
            p, q = np.nonzero(t_occurrence(wx, fx, wy, fy, need, asked))
            a.append(y[p])
            b.append(xs[q])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        if short:
            some = np.unique(np.concatenate([node[a], node[b]]))
            return pa.table({"a": some, "b": pa.nulls(len(some), pa.int64())})
        kept = forest(a, b, group)
        a, b = node[a[kept]], node[b[kept]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("h", "g", "i", "j").applyInArrow(run, "a long, b long")


def _fits(n: str, m: str, percent: int) -> Column:
    return (100 * F.least(F.col(n), F.col(m))) >= percent * F.greatest(F.col(n), F.col(m))


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    rows = write_table(signatures(docs, k, percent), "jaccard-rows")
    grouped = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("short").alias("short"))
    nodes = write_table(grouped.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")

    size = nodes.select("node", "n")
    posted = nodes.select("node", F.posexplode("short").alias("at", "h"), needed("n", percent).alias("last"))
    posted = posted.select("h", "node", "at", (F.col("at") < F.col("last")).alias("sure"))
    several = posted.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    lists = write_table(posted.join(several, "h").join(size, "node"), "jaccard-lists")
    links, tested, label = None, None, size.where("false").select("node", F.col("node").alias("component"))
    finished: list[DataFrame] = []  # dropped at the end
    used: list[DataFrame] = []  # dropped with the next pairs

    def sets_of(node_ids: DataFrame) -> DataFrame:
        return write_table(_sets(docs, nodes.join(node_ids.distinct(), "node", "left_semi"), k), "jaccard-sets")

    def add(found: DataFrame) -> None:
        nonlocal links, label
        finished.append(found)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)
            finished.append(label)

    def test(pairs: DataFrame) -> None:
        """Add the links among pairs (a, b) that were not tested yet."""
        nonlocal tested
        new = write_table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        tested = new if tested is None else tested.unionByName(new)
        finished.append(new)
        drop_tables(*used)
        used.clear()
        if not new.isEmpty():
            sets = sets_of(new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))))
            found = write_table(_linked(new, sets, percent), "jaccard-links")
            drop_tables(sets)
            add(found)

    def met(pairs: DataFrame, part: int) -> DataFrame:
        """Of pairs (a, n, b, m), a row for each list they meet in, those that meet in 1 / part of what they must."""
        counted = pairs.where(_fits("n", "m", percent)).groupBy("a", "b")
        counted = counted.agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
        return counted.where(F.col("c") * part >= must_meet("n", "m", percent))

    def mixed(some: DataFrame) -> DataFrame:
        """Lists whose nodes are in several components, with the least one (c) and their length."""
        known = write_table(some.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-known")
        of = known.groupBy("h").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("length"))
        of = write_table(of.where("c <> d").drop("d"), "jaccard-mixed")
        used.extend([known, of])
        return known.join(of, "h")

    heads = lists.groupBy("h").agg(F.min("node").alias("a"), F.min_by("n", "node").alias("n"))
    near = met(lists.select("h", F.col("node").alias("b"), F.col("n").alias("m")).join(heads, "h").where("a <> b"), 2)
    test(near.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b"))

    left = mixed(lists)
    one = left.groupBy("h", "component").agg(F.min("node").alias("node"), F.min_by("n", "node").alias("size"), F.first("c").alias("c"))
    first = one.where("component = c").select("h", F.col("node").alias("x"), F.col("size").alias("n"))
    more = one.where("component <> c").join(first, "h")
    test(met(more.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"), "n", F.col("size").alias("m")), 2).select("a", "b"))

    # Linked sets meet in a list that is sure for both. Where they first meet, in the order of all shingles, what
    # follows in both must still reach T.
    left = write_table(mixed(lists.where("sure")).select("h", "node", "n", "at", "component", "length"), "jaccard-left")
    finished.append(left)
    x = left.where(F.col("length") <= FEW).select("h", F.col("node").alias("a"), "n", F.col("at").alias("i"), F.col("component").alias("c1"))
    y = x.select("h", F.col("a").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c1").alias("c2"))
    reach = F.expr(f"least(n - i, m - j) * {100 + percent} >= {percent} * (n + m)")
    apart = (F.col("a") < F.col("b")) & (F.col("c1") != F.col("c2"))
    rest = x.join(y, "h").where(apart & _fits("n", "m", percent) & reach).select("a", "n", "b", "m").distinct()
    short = lambda node, name: nodes.select(F.col("node").alias(node), F.col("short").alias(name))
    meets = F.size(F.array_intersect("short_a", "short_b")) >= must_meet("n", "m", percent)
    test(rest.join(short("a", "short_a"), "a").join(short("b", "short_b"), "b").where(meets).select("a", "b"))

    # Longer lists: groups g of neighbouring length classes, as linked sets are at most one class apart.
    hot = left.where(F.col("length") > FEW)
    if not hot.isEmpty():
        known = hot.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        width = F.lit(1.0001 * float(np.log(100 / percent)) if percent < 100 else 1e-9)
        level = F.floor(F.log(F.col("n").cast("double")) / width)
        dealt = known.withColumn("g", level).withColumn("lower", F.explode(F.array(F.lit(True), F.lit(False))))
        dealt = write_table(dealt.withColumn("g", F.when(F.col("lower"), F.col("g")).otherwise(F.col("g") - 1)), "jaccard-dealt")
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int")
        groups = dealt.groupBy("h", "g").agg(blocks.alias("blocks"), F.min("component").alias("c"), F.max("component").alias("d"), F.max("lower").alias("any"))
        groups = write_table(groups.where("any and c <> d").select("h", "g", "blocks"), "jaccard-groups")
        salt = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met_in = dealt.join(groups, ["h", "g"]).withColumn("salt", salt).withColumn("other", other)
        met_in = met_in.select("h", "g", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "node", "n", "at", "lower", "component")
        known = met_in.join(nodes.select("node", "short"), "node").withColumn("early", F.slice("short", F.lit(1), F.col("at")))
        near = write_table(_block_links(known.withColumnRenamed("short", "words"), percent, short=True).select(F.col("a").alias("node")).distinct(), "jaccard-near")
        finished.append(near)
        sets = sets_of(near)
        full = known.drop("short").join(sets.select("node", "words"), "node")
        found = write_table(_block_links(full, percent).distinct(), "jaccard-links")
        drop_tables(sets, dealt, groups)
        add(found)

    placed = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = write_table(placed.join(smallest, "component").select("n", "s1", "s2", "component_id"), "jaccard-named")
    drop_tables(nodes, lists, *used, *finished)
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (all rows of that id);
    documents without a set, or without an id, all stay."""
    groups = join(docs.where("doc_id is not null"), k, percent)
    lasting = groups.where("n_shingles = 0 or doc_id = component_id").select("doc_id").distinct()
    some = docs.where("doc_id is not null").join(lasting, "doc_id", "left_semi")
    return some.unionByName(docs.where("doc_id is null")).select(*docs.columns)
