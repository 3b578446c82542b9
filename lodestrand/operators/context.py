"""Evidence gate, budgeted context packing, extractive answers and citation checks, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import snippet, squeezed

SEPARATOR = 2  # characters between two items
# Least scores by retriever.
LEAST_SCORES = {"keyword": 0.1, "bm25": 0.0, "dense": 0.45, "hybrid": 0.02, "bm25_hybrid": 0.02}


def evidence(routes: DataFrame, hits: DataFrame, retriever: str, may_retry: bool = True, least_results: int = 1) -> DataFrame:
    """``(query_id, status, reason, top_score, n_missing)`` from ``routes(query_id, intent, sources)`` and hits with
    their ``source_type``. The first check that fails decides."""
    own = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.collect_set("source_type").alias("got"))
    rows = routes.join(own, "query_id", "left")
    missing = F.size(F.array_except("sources", F.coalesce("got", F.array().cast("array<string>"))))
    least = LEAST_SCORES.get(retriever)
    reason = F.when((F.col("intent") == "unknown") | (F.coalesce(F.size("sources"), F.lit(0)) < 1), "unanswerable_route").when(F.coalesce("n", F.lit(0)) < least_results, "empty_retrieval")
    if least is not None:
        reason = reason.when(F.round("top_score", 9) < least, "weak_retrieval_score")
    reason = reason.when(missing > 0, "required_sources_missing").otherwise("sufficient_evidence")
    status = F.when(F.col("reason") == "sufficient_evidence", "sufficient").when((F.col("reason") == "unanswerable_route") | F.lit(not may_retry), "insufficient").otherwise("retryable")
    return rows.select("query_id", reason.alias("reason"), "top_score", F.greatest(missing, F.lit(0)).alias("n_missing")).withColumn("status", status)


def rank_prefix(items: DataFrame, budget: int) -> DataFrame:
    """The items ``(query_id, rank, chunk_id, size)`` in rank order up to the first that does not fit."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.col("size") + SEPARATOR).over(upto) - SEPARATOR
    return items.withColumn("used", used).where(F.col("used") <= budget)


def _fold(items: Column, budget: int) -> Column:
    """Go through ordered items and take each that still fits; later smaller ones may."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"))

    def step(s: Column, x: Column) -> Column:
        size = s["used"] + F.when(F.size(s["ranks"]) > 0, SEPARATOR).otherwise(0) + x["size"]
        return F.when(size <= budget, F.struct(size.cast("long").alias("used"), F.concat(s["ranks"], F.array(x["rank"])).alias("ranks"))).otherwise(s)

    return F.aggregate(items, start, step)


def built_context(items: DataFrame, required: DataFrame, budget: int, strategy: str = "rank_prefix") -> DataFrame:
    """``(query_id, used, skipped, covered, missing)`` of ``items(query_id, rank, chunk_id, source_type, size)``, a bounded
    list a query, and ``required(query_id, sources)``: ids of the packed items and of the others, both by rank, the
    source types of the packed ones, and the required ones that are not among them. ``strategy`` is "rank_prefix" or
    "source_balanced"."""
    if strategy not in ("rank_prefix", "source_balanced"):
        raise ValueError(f"no such strategy: {strategy}")
    if budget <= 0:
        raise ValueError("the budget has to be above 0")
    picked = rank_prefix(items, budget) if strategy == "rank_prefix" else source_balanced(items, required, budget)
    rows = items.join(picked.select("query_id", "rank", F.lit(True).alias("taken")), ["query_id", "rank"], "left")
    all_of = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_type", F.coalesce("taken", F.lit(False)).alias("taken")))).alias("x"))
    ids = lambda keep: F.transform(F.filter("x", keep), lambda e: e["chunk_id"])
    covered = F.array_sort(F.array_distinct(F.transform(F.filter("x", lambda e: e["taken"]), lambda e: e["source_type"])))
    out = required.join(all_of, "query_id", "left").withColumn("x", F.coalesce("x", F.array().cast(all_of.schema["x"].dataType)))
    return out.select("query_id", ids(lambda e: e["taken"]).alias("used"), ids(lambda e: ~e["taken"]).alias("skipped"), covered.alias("covered"), F.array_except(F.array_distinct("sources"), covered).alias("missing"))


def source_balanced(items: DataFrame, required: DataFrame, budget: int) -> DataFrame:
    """The best item of each required source first, then the others by rank; whatever fits is taken. ``items`` has
    ``(query_id, rank, chunk_id, source_type, size)``, a bounded list a query; ``required`` has ``(query_id,
    sources)``."""
    first = Window.partitionBy("query_id", "source_type").orderBy("rank")
    rows = items.join(required, "query_id", "left").withColumn("lead", F.coalesce((F.row_number().over(first) == 1) & F.array_contains("sources", F.col("source_type")), F.lit(False)))
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("lead")).alias("late"), F.col("rank").alias("rank"), F.col("size").cast("long").alias("size")))).alias("items"))
    picked = ordered.select("query_id", F.explode(_fold(F.col("items"), budget)["ranks"]).alias("rank"))
    return items.join(picked, ["query_id", "rank"], "left_semi")


def extractive_answers(hits: DataFrame, n: int = 3, chars: int = 220) -> DataFrame:
    """``(query_id, answer, citations)``: numbered snippets of the first ``n`` hits (with their ``text``)."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.col("rank").cast("string"), F.lit("] "), snippet("text", chars))
    rows = hits.where(F.col("rank") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "chunk_id"))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("answer"), F.array_join(F.transform("x", lambda e: e["chunk_id"]), ",").alias("citations"))


def citation_issues(generations: DataFrame, context: DataFrame) -> DataFrame:
    """``(query_id, issue, chunk_id)`` for ``generations(query_id, sufficient, cited)`` against the context's
    ``(query_id, chunk_id)``: missing and unexpected citations, repeated ones and ones outside the context."""
    n = F.greatest(F.coalesce(F.size("cited"), F.lit(0)), F.lit(0))
    whole = generations.select("query_id", F.when(F.col("sufficient") & (n == 0), "missing_citation").when(~F.col("sufficient") & (n > 0), "insufficient_with_citations").alias("issue"), F.lit(None).cast("string").alias("chunk_id")).where("issue is not null")
    each = generations.select("query_id", F.posexplode("cited").alias("at", "chunk_id"))
    order = Window.partitionBy("query_id", "chunk_id").orderBy("at")
    numbered = each.withColumn("n", F.row_number().over(order))
    repeated = numbered.where("n > 1").select("query_id", F.lit("duplicate_citation").alias("issue"), "chunk_id")
    outside = numbered.where("n = 1").join(context.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", F.lit("citation_not_found").alias("issue"), "chunk_id")
    return whole.union(repeated).union(outside)


def item_size(text: Column | str) -> Column:
    return F.length(squeezed(text))


#: Priorities of the kinds of segments, and what each mode takes of a conversation.
PRIORITIES = {"system": 100, "query": 100, "profile": 90, "memory": 80, "evidence": 70, "summary": 60, "history": 50}
MODES = {"no_memory": (), "full_history": ("history",), "recent_window": ("history",), "summary_recent": ("summary", "history"), "semantic_memory": ("memory",)}


def segments(parts: DataFrame, mode: str, recent: int = 6) -> DataFrame:
    """The ``parts(query_id, kind, segment_id, seq, size)`` that a mode takes, with their ``priority``. Every mode takes
    system, query, profile and evidence; those that take history take its last ``recent`` messages by ``seq``, apart from
    "full_history", which takes all."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    own = parts.where(F.col("kind").isin("system", "query", "profile", "evidence", *MODES[mode]))
    if mode != "full_history":
        last = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("seq"), F.desc("segment_id")))
        own = own.withColumn("n", last).where((F.col("kind") != "history") | (F.col("n") <= recent)).drop("n")
    known = F.create_map(*(F.lit(x) for pair in PRIORITIES.items() for x in pair))
    return own.withColumn("priority", F.element_at(known, F.col("kind")))


def managed_context(segments: DataFrame, budget: int, reserved: int = 0) -> DataFrame:
    """``(query_id, segment_id, used, error)``: the ``segments(query_id, kind, priority, segment_id, size)`` that fit a token
    budget less what is reserved. System and query always come first and have to fit; where they do not, or are missing,
    the query gets one row with an ``error`` and no segment. The others come by falling priority, then id; whatever still
    fits is taken. ``used`` are the tokens up to there. Segments of a query are a bounded list."""
    room = budget - reserved
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<segment_id:string,used:bigint>>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + x["size"]
        more = F.struct(x["segment_id"].alias("segment_id"), used.cast("long").alias("used"))
        return F.when(used <= room, F.struct(used.cast("long").alias("used"), F.concat(s["taken"], F.array(more)).alias("taken"))).otherwise(s)

    fixed = F.col("kind").isin("system", "query")
    key = F.struct((~fixed).alias("late"), (-F.col("priority")).alias("o"), "segment_id", F.col("size").cast("long").alias("size"))
    ordered = segments.groupBy("query_id").agg(F.array_sort(F.collect_list(key)).alias("x"), F.sum(F.when(fixed, F.col("size"))).alias("fixed"), F.count_distinct(F.when(fixed, F.col("kind"))).alias("n_fixed"))
    error = F.when(F.col("n_fixed") < 2, "missing_segment").when(F.col("fixed") > room, "budget")
    taken = F.when(error.isNull(), F.aggregate("x", start, step)["taken"])
    return ordered.select("query_id", error.alias("error"), F.explode_outer(taken).alias("t")).select("query_id", "t.segment_id", "t.used", "error")


FIELDS = {"answer": ("STRING",), "cited_chunk_ids": ("ARRAY<STRING>", "ARRAY<VOID>"), "sufficient": ("BOOLEAN",), "reason": ("STRING",)}


def parsed_generations(rows: DataFrame, json_col: str) -> DataFrame:
    """Adds ``answer``, ``cited``, ``sufficient``, ``reason`` and ``error``: ``invalid_json``; ``invalid_field_type`` if the
    whole is no object or a field has another type; ``missing_field``; or null. Faulty rows have no values."""
    v = rows.withColumn("v", F.try_parse_json(json_col))
    kind = lambda field: F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))
    missing, wrong = F.lit(False), F.lit(False)
    for field, kinds in FIELDS.items():
        got = kind(field)
        missing = missing | got.isNull()
        wrong = wrong | ~got.isin(*kinds)
    error = F.when(F.col("v").isNull(), "invalid_json").when(~F.schema_of_variant("v").startswith("OBJECT"), "invalid_field_type").when(missing, "missing_field").when(wrong, "invalid_field_type")
    out = v.withColumn("error", error)
    value = lambda field, kind: F.when(F.col("error").isNull(), F.try_variant_get("v", f"$.{field}", kind))
    return out.select(*rows.columns, value("answer", "string").alias("answer"), value("cited_chunk_ids", "array<string>").alias("cited"), value("sufficient", "boolean").alias("sufficient"), value("reason", "string").alias("reason"), "error")
