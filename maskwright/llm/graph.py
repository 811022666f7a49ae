"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import drop_tables, write_table


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b: long, not null).

    Rounds of: hook every node to its smallest neighbour if that is smaller, follow hooks to their
    roots (each step doubles the distance), then rewrite the links between roots. A root that took in no
    node is beside a smaller root in the next round, so two rounds halve the nodes at least, in whatever order
    their numbers are; it ends when no links are left. Messages are counted map-side, and each step is a
    written table."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = write_table(both, "links")
    labels = None
    while True:
        root = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "roots")
        while True:
            above = root.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("up"))
            if root.join(above, "component", "left_semi").isEmpty():
                break
            nearer = write_table(root.join(above, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "roots")
            drop_tables(root)
            root = nearer
        to = lambda c, r: root.select(F.col("node").alias(c), F.col("component").alias(r))
        if labels is None:
            labels = root
        else:
            moved = write_table(labels.join(to("component", "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
            drop_tables(labels)
            labels = moved
        rest = both.join(to("a", "ra"), "a").join(to("b", "rb"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        rest = write_table(rest, "links")
        drop_tables(both)
        both = rest
        if both.isEmpty():
            return labels
