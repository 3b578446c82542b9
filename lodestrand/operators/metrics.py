"""Retrieval and end-to-end metrics. Null means unknown and never counts as false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``(query_id, n_relevant, recall, reciprocal_rank, ndcg)`` of ranked hits against ``labels(query_id, relevant)``.

    Relevant ids count once; a query without labels or hits gets zeros."""
    goals = labels.select("query_id", F.explode_outer(F.array_distinct("relevant")).alias("chunk_id"))
    joined = goals.join(hits.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
    rows = joined.groupBy("query_id").agg(
        F.count("chunk_id").alias("n_relevant"), F.count("rank").alias("n_hit"), F.max(F.lit(1.0) / F.col("rank")).alias("rr"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    none = F.col("n_relevant") == 0
    return rows.select(
        "query_id",
        "n_relevant",
        F.when(none, 0.0).otherwise(F.col("n_hit") / F.col("n_relevant")).alias("recall"),
        F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"),
        F.when(none, 0.0).otherwise(F.coalesce(F.col("dcg") / ideal, F.lit(0.0))).alias("ndcg"),
    )


def nearest_rank(column: Column | str, share: float) -> Column:
    """The value at the nearest rank from above: the least one that ``share`` of the values do not exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").cast("double")


def floor_index(column: Column | str, share: float) -> Column:
    """The value at the index ``floor((n - 1) * share)`` of the sorted values. Equals an interpolated percentile at
    its lower neighbour, so it is an aggregate over partial counts and needs no sorted list."""
    return F.expr(f"percentile_approx({column}, {share}, 2147483647)").cast("double")


def all_known(column: Column | str) -> Column:
    """The mean of a column, null as soon as one value is unknown."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c.cast("double")))


def key_point_coverage(points: Column, answer: Column) -> Column:
    """Share of the points that the answer contains (both as match texts); null without points."""
    found = F.size(F.filter(points, lambda p: F.contains(answer, p)))
    return F.when(F.coalesce(F.size(points), F.lit(0)) > 0, found / F.size(points))


def three_valued_success(answerable: Column, answered: Column, supported: Column, good: Column) -> Column:
    """End-to-end success: an unanswerable case succeeds by abstaining, an answerable one by a good supported answer;
    unknown support of an answer leaves it unknown."""
    return F.when(~answerable, ~answered).when(~answered, F.lit(False)).when(supported.isNull(), F.lit(None).cast("boolean")).otherwise(supported & good)
