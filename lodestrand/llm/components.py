"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import staged


def component_of(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its least node.

    Star contraction: each round links every node to the least node of its neighbourhood, first downwards from the
    larger neighbours, then among the smaller ones, until the links form stars. Every round is written out, so lost
    executors cost one round at most. Self links and repeated links change nothing."""
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        down = large.where("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = staged(small, "small")
        if small.exceptAll(now).isEmpty() and now.exceptAll(small).isEmpty():
            break
        now = small
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).where("node is not null").distinct()
    least = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
