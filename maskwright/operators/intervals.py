"""Interval joins as equi-joins, and running values over sorted ranges.

Two intervals overlap where the later start lies in the other one. So an overlap join is two joins of points with
intervals, each pair found once. Positions are put into bins; an interval goes to the bins of its own level, whose
width is its length or more (two bins at most), and a point to one bin of each level. The rows made grow with the
intervals and the hits, and a document of any length is spread by its bins. Where one side has a row for each character
(`points_in`), a point goes to one bin and an interval to all that it touches: these are fewer than the characters it
covers. All such joins are by shuffles: Spark guesses a side's size before its rows are copied to bins, and would
broadcast millions of rows.

`Ranged` does what a window does, for groups that no task should hold alone: rows are range partitioned by group and
order, running values are taken within each partition, and what lies before is carried from partition to partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.storage import write_table

#: The narrowest bins are 2^SHIFT characters wide; each level is 2^STEP times as wide as the one before.
SHIFT, STEP, LEVELS = 5, 3, 10
#: Bins of points are 2^POINTS characters wide.
POINTS = 7


def _level(start: Column, end: Column) -> Column:
    """The first level whose bins are as wide as the interval."""
    n = (end - start).cast("long")
    return sum((F.when(n > (1 << (SHIFT + STEP * k)), 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0))


def _bin(at: str, level: str) -> Column:
    return F.expr(f"shiftright(cast({at} AS bigint), {SHIFT} + {STEP} * {level})")


def _in_bins(df: DataFrame, start: str, end: str) -> DataFrame:
    """Non-empty intervals, once for each bin of their level that they touch."""
    placed = df.where(F.col(start) < F.col(end)).withColumn("__level", _level(F.col(start), F.col(end)))
    return placed.withColumn("__bin", F.explode(F.sequence(_bin(start, "__level"), _bin(f"{end} - 1", "__level"))))


def _as_points(df: DataFrame, start: str) -> DataFrame:
    return df.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("__bin", _bin(start, "__level"))


def overlap_join(a: DataFrame, b: DataFrame, by: Sequence[str], a_at: tuple[str, str] = ("start", "end"), b_at: tuple[str, str] = ("__s", "__e")) -> DataFrame:
    """Pairs of rows of a and b of one group (equal columns `by`) whose half-open intervals overlap, each once. Columns
    other than `by` need different names. An empty interval overlaps those that it lies inside of."""
    (a_s, a_e), (b_s, b_e) = a_at, b_at
    quote = lambda c: f"`{c}`"
    on = [*by, "__level", "__bin"]
    met = (F.col(a_s) < F.col(b_e)) & (F.col(b_s) < F.col(a_e))
    columns = [*by, *(c for c in a.columns if c not in by), *(c for c in b.columns if c not in by)]
    a_later = _as_points(a, quote(a_s)).join(_in_bins(b, quote(b_s), quote(b_e)).hint("merge"), on).where((F.col(a_s) >= F.col(b_s)) & met)
    b_later = _in_bins(a, quote(a_s), quote(a_e)).join(_as_points(b, quote(b_s)).hint("merge"), on).where((F.col(b_s) > F.col(a_s)) & met)
    return a_later.select(*map(quote, columns)).unionByName(b_later.select(*map(quote, columns)))


def points_in(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, ends: tuple[str, str] = ("__s", "__e")) -> DataFrame:
    """Pairs of a point and an interval of one group (equal columns `by`) that it lies in (start <= at < end), each once.
    Meant for points that stand close together, as characters do: an interval is copied once for 2^POINTS places."""
    s, e = ends
    dealt = points.withColumn("__bin", F.expr(f"shiftright(cast(`{at}` AS bigint), {POINTS})"))
    bins = intervals.where(F.col(s) < F.col(e)).withColumn("__bin", F.expr(f"explode(sequence(shiftright(cast(`{s}` AS bigint), {POINTS}), shiftright(cast(`{e}` AS bigint) - 1, {POINTS})))"))
    return dealt.join(bins.hint("merge"), [*by, "__bin"]).where((F.col(at) >= F.col(s)) & (F.col(at) < F.col(e))).drop("__bin")


class Ranged:
    """Rows sorted by group and order over range partitions, written once so that their places are fixed."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str | Column], parts: int | None = None):
        self.by = list(by)
        keys = [*(F.col(c) for c in by), *order]
        dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
        self.rows = write_table(dealt.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranged").withColumn("__part", F.shiftright("__at", 33))

    def before(self, rows: DataFrame, name: str, value: Column, add: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
        """rows with `name`: value added up over the earlier rows of the group, null before the first. add: an aggregate
        that skips nulls; both: of two results, of which one may be null. Rows have to be those of this object, with more columns."""
        here = Window.partitionBy("__part", *self.by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*self.by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.groupBy("__part", *self.by).agg(add(value).alias("__total"))
        # Of a partition's groups only the first can have begun in an earlier one: a row a partition.
        carried = totals.withColumn("__carried", add(F.col("__total")).over(across)).where("__carried IS NOT NULL").drop("__total")
        keys = ["__part", *self.by]
        side = carried.select(*(F.col(c).alias(f"__key{k}") for k, c in enumerate(keys)), "__carried")
        same = [F.col(c).eqNullSafe(F.col(f"__key{k}")) for k, c in enumerate(keys)]  # rows without a group are a group
        met = rows.withColumn("__here", add(value).over(here)).join(F.broadcast(side), same, "left").drop(*(f"__key{k}" for k in range(len(keys))))
        return met.withColumn(name, both(F.col("__carried"), F.col("__here"))).drop("__carried", "__here")

    def greatest_before(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        return self.before(rows, name, value, F.max, F.greatest)

    def sum_before(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """0 before the first row of a group."""
        return self.before(rows, name, value, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
