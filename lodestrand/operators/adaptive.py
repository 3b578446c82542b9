"""Query features, the choice of a retrieval strategy, and the confidence of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import contains_any

# Markers of the query features.
REWRITE_MARKERS = ("换句话", "同义", "通俗", "口语", "改写", "另一种说法")
MULTI_SOURCE_MARKERS = ("结合", "对比", "匹配", "综合", "个人经历")
CROSS_DOCUMENT_MARKERS = (
    "哪些项目", "哪个项目", "哪些经历", "哪段经历", "能否证明", "可以证明", "是否匹配", "对应起来", "结合岗位", "岗位要求与", "候选人是否",
    "简历经历", "项目记录", "共同体现", "跨来源", "知识关系", "跳联系", "关系路径", "互补证据",
)
TECHNICAL_TERMS = ("混合检索", "引用校验", "请求追踪", "意图路由", "上下文预算", "失败回归", "bm25", "dense", "rrf", "agent", "rag", "trace", "citation")
JOB_WORD, OWN_WORDS = "岗位", ("项目", "经历", "简历")


def cross_document(text: Column) -> Column:
    """Whether a lower-cased query connects documents."""
    return contains_any(text, CROSS_DOCUMENT_MARKERS) | (F.contains(text, F.lit(JOB_WORD)) & contains_any(text, OWN_WORDS))


def features(queries: DataFrame, id_col: str, text_col: str, sources_col: str) -> DataFrame:
    """Seven features of each query; null sources count as none."""
    t = F.lower(F.trim(text_col))
    count = F.coalesce(F.size(sources_col), F.lit(0))
    count = F.when(count < 0, 0).otherwise(count)
    return queries.select(
        id_col,
        F.length(t).alias("char_count"),
        count.cast("int").alias("source_count"),
        (contains_any(t, TECHNICAL_TERMS) | F.col(text_col).rlike("[A-Za-z][A-Za-z0-9_.+-]+")).alias("has_exact_term"),
        contains_any(t, REWRITE_MARKERS).alias("has_semantic_rewrite"),
        ((count >= 2) | contains_any(t, MULTI_SOURCE_MARKERS)).alias("is_multi_source"),
        cross_document(t).alias("is_cross_document"),
        (count == 0).alias("is_unanswerable_route"),
    )


def strategies(rows: DataFrame, graph_enabled: bool) -> DataFrame:
    """Adds ``strategy``: the first rule that holds decides."""
    rules = F.when(F.col("is_unanswerable_route"), "bm25")
    if graph_enabled:
        rules = rules.when(F.col("is_cross_document"), "graph_hybrid")
    rules = rules.when(F.col("is_multi_source"), "hybrid").when(F.col("has_semantic_rewrite") & ~F.col("has_exact_term"), "dense")
    return rows.withColumn("strategy", rules.when((F.col("char_count") <= 8) & ~F.col("has_exact_term"), "bm25").otherwise("hybrid"))


def confidence(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(query_id, confidence)`` from number, margin, source coverage and agreement of fused hits (``rank_a``,
    ``rank_b``); ``wanted`` holds ``(query_id, sources)``."""
    both = F.expr("rank_a is not null and rank_b is not null").cast("double")
    own = hits.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.collect_set("source_type").alias("got"), F.avg(both).alias("agreement")
    )
    rows = own.join(wanted, "query_id")
    wanted_set = F.array_distinct("sources")
    quantity = F.least(F.lit(1.0), F.col("n") / F.lit(float(k)))
    margin = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("s2").isNull(), 1.0).otherwise((F.col("s1") - F.col("s2")) / F.col("s1"))))
    coverage = F.when(F.coalesce(F.size("sources"), F.lit(0)) < 1, 1.0).otherwise(F.size(F.array_intersect(wanted_set, "got")) / F.size(wanted_set))
    return rows.select("query_id", F.round(0.25 * quantity + 0.20 * margin + 0.25 * coverage + 0.30 * F.col("agreement"), 6).alias("confidence"))
