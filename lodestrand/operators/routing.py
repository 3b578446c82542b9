"""Routing of queries to intents and source types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Intents in order of precedence, with the sources they search and their keywords.
INTENT_SOURCES = {
    "analyze_jd": ("jd",),
    "match_resume": ("jd", "resume"),
    "interview_prepare": ("interview", "jd", "resume"),
    "project_explain": ("project_logs", "resume"),
    "application_plan": ("user_profile", "jd", "resume"),
}
INTENT_KEYWORDS = {
    "analyze_jd": ("jd", "岗位", "职位", "职责", "要求", "招聘", "实习天数", "分析岗位"),
    "match_resume": ("简历", "匹配", "适配", "差距", "优势", "经历", "项目经历", "怎么改简历", "胜任"),
    "interview_prepare": ("面试", "八股", "面经", "准备", "常问", "追问", "怎么回答", "复习"),
    "project_explain": ("项目", "项目日志", "怎么讲", "亮点", "难点", "架构", "模块", "实现细节"),
    "application_plan": ("投递", "求职", "规划", "计划", "城市", "目标", "用户画像", "时间安排", "申请"),
}
SCORE, MARGIN = 0.45, 0.02
OVERRIDE_SCORE, OVERRIDE_MARGIN, WEAK_KEYWORDS = 0.55, 0.04, 2


def rule_routes(queries: DataFrame) -> DataFrame:
    """``(query_id, intent, n_keywords, confidence, sources)``: the intent with the most keywords in the query, the
    first of several; without a keyword the intent is unknown and no source is searched."""
    text = F.lower(F.trim("query"))
    counts = [F.struct(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(INTENT_KEYWORDS.items())]
    best = F.greatest(*counts)
    rows = queries.select("query_id", best.alias("best"))
    known = F.col("best.n") > 0
    sources = F.create_map(*(x for name, s in INTENT_SOURCES.items() for x in (F.lit(name), F.array(*map(F.lit, s)))))
    return rows.select(
        "query_id", F.when(known, F.col("best.intent")).otherwise("unknown").alias("intent"), F.col("best.n").alias("n_keywords"), F.least(F.lit(1.0), F.col("best.n") / 2.0).alias("confidence"),
        F.when(known, F.element_at(sources, F.col("best.intent"))).otherwise(F.array().cast("array<string>")).alias("sources"),
    )


def semantic_routes(scores: DataFrame, score: float = SCORE, margin: float = MARGIN) -> DataFrame:
    """``(query_id, intent, score, margin)`` from similarities ``(query_id, intent, score)`` to prototypes: the best
    intent by its best prototype; unknown if the score or the lead over the second is too small."""
    best = scores.groupBy("query_id", "intent").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "intent")
    rows = best.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("score", 1, 0.0).over(order)).where("n = 1")
    lead = F.col("score") - F.col("next")
    sure = (F.round("score", 9) >= score) & (F.round(lead, 9) >= margin)
    return rows.select("query_id", F.when(sure, F.col("intent")).otherwise("unknown").alias("intent"), "score", lead.alias("margin"))


def hybrid_routes(rule: DataFrame, semantic: DataFrame) -> DataFrame:
    """``(query_id, intent, how)``: agreement first; a sure semantic route overrides a weak rule; else the rule."""
    s = semantic.select("query_id", F.col("intent").alias("semantic"), "score", "margin")
    rows = rule.join(s, "query_id", "left")
    agree = F.col("intent").eqNullSafe(F.col("semantic"))
    strong = (F.coalesce("semantic", F.lit("unknown")) != "unknown") & (F.round("score", 9) >= OVERRIDE_SCORE) & (F.round("margin", 9) >= OVERRIDE_MARGIN) & (F.col("n_keywords") <= WEAK_KEYWORDS)
    return rows.select("query_id", F.when(agree, F.col("intent")).when(strong, F.col("semantic")).otherwise(F.col("intent")).alias("intent"), F.when(agree, "agree").when(strong, "semantic").otherwise("rule").alias("how"))


def prototypes(queries: DataFrame) -> DataFrame:
    """``(query_id, anchor)``: what stands before the first colon if it has 2 to 16 characters, else the whole."""
    head = F.trim(F.split("query", "[：:]")[0])
    short = F.col("query").rlike("[：:]") & F.length(head).between(2, 16)
    return queries.select("query_id", F.when(short, head).otherwise(F.trim("query")).alias("anchor"))


def anchored(queries: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(query_id, anchor, intent)``: the longest of ``anchors(anchor, intent)`` that is the query or stands before a
    colon at its start. Both forms are equi-joins on the part before a colon."""
    heads = queries.select("query_id", F.trim("query").alias("q"))
    cut = heads.select("query_id", F.explode(F.array_distinct(F.array("q", F.split("q", "：")[0], F.split("q", ":")[0]))).alias("anchor"))
    rows = cut.join(anchors, "anchor")
    return rows.groupBy("query_id").agg(F.max(F.struct(F.length("anchor").alias("n"), "anchor", "intent")).alias("m")).select("query_id", "m.anchor", "m.intent")
