"""Small helpers on tables that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Rows of a few numbers up to which a side is broadcast, which is checked by counting them first.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast `df` if it has few rows; otherwise the planner joins it by shuffling. Both give the same rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component`, its smallest node, of an undirected graph given as `a`, `b`.

    Rounds of taking the neighbours' smallest label, then the label of that label, each written as a table; the number of
    rounds grows with the logarithm of the longest path, and only a flag comes back to the driver.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        step = cut_lineage(step)
        of = step.select(F.col("node").alias("of"), F.col("component").alias("jump"))
        after = cut_lineage(
            step.join(of, step["component"] == of["of"], "left").select("node", "old", F.least("component", "jump").alias("component"))
        )
        if after.where("component <> old").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
