"""Top-k, fusion and re-ranking over hit tables ``(query_id, chunk_id, score, …)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9  # scores are compared at this precision, so that ties do not depend on the order of a sum


def top_k(hits: DataFrame, k: int, *ties: Column | str, by: str = "query_id", score: str = "score") -> DataFrame:
    """The ``k`` best hits of each query with their ``rank``; ``ties`` make the order total. The filter sits on the
    window, so each task keeps k rows a query before anything is shuffled."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, DIGITS)), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, k: int, rrf_k: int = 60, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, chunk_id, score, rank_a, rank_b, rank)`` from two ranked lists; a missing rank adds nothing. Columns
    ``carried``, which both lists have of a chunk, stay with it."""
    own = lambda hits, c: hits.select("query_id", "chunk_id", F.col("rank").alias(f"rank_{c}"), *(F.col(x).alias(f"{x}_{c}") for x in carried))
    both = own(a, "a").join(own(b, "b"), ["query_id", "chunk_id"], "full_outer")
    both = both.select("query_id", "chunk_id", "rank_a", "rank_b", *(F.coalesce(f"{x}_a", f"{x}_b").alias(x) for x in carried))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    return top_k(both.withColumn("score", part("rank_a") + part("rank_b")), k, "chunk_id")


def fusion_or_second(a: DataFrame, b: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """``reciprocal_rank_fusion``, but a query without hits in ``a`` keeps the ranking and the scores of ``b``."""
    fused = reciprocal_rank_fusion(a, b.join(a.select("query_id").distinct(), "query_id", "left_semi"), k, rrf_k)
    alone = b.join(a.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= k)
    names = ["query_id", "chunk_id", "score", "rank_a", "rank_b", "rank"]
    return fused.select(names).union(alone.select("query_id", "chunk_id", "score", F.lit(None).cast("int"), "rank", "rank"))


def rerank(hits: DataFrame, scorer: Column, k: int) -> DataFrame:
    """Hits in the order of another score (ties keep the former rank): adds ``rerank_score``, ``rerank_rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", DIGITS)), "rank", "chunk_id")
    return hits.withColumn("rerank_score", scorer).withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)


def conservative_fusion(hits: DataFrame, k: int, rrf_k: int = 60, original_weight: float = 2.0, rerank_weight: float = 1.0) -> DataFrame:
    """Weighted fusion of the former rank with the re-ranked one: adds ``fused_score``, ``fused_rank``."""
    score = F.lit(original_weight) / (rrf_k + F.col("rank")) + F.lit(rerank_weight) / (rrf_k + F.col("rerank_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused_score", DIGITS)), "rank", "chunk_id")
    return hits.withColumn("fused_score", score).withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k)


def keep_best(rows: DataFrame, text_key: Column) -> DataFrame:
    """First by rank of each id, then first of each text among those."""
    one = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    two = Window.partitionBy("query_id", "text_key").orderBy("rank", "chunk_id")
    first = rows.withColumn("text_key", text_key).withColumn("n1", F.row_number().over(one)).where("n1 = 1")
    return first.withColumn("n2", F.row_number().over(two)).where("n2 = 1").drop("n1", "n2", "text_key")
