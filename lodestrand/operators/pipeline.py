"""The whole run of many queries: routing, retrieval with one retry, evidence, context, answer, citations and traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import context, lexical, routing
from lodestrand.session import staged

#: Stages of a run in order, each a span below the run's own.
STAGES = ("routing", "retrieval", "evidence", "context", "generation", "validation")


@dataclass(frozen=True)
class Run:
    """``queries(query_id, query, intent, sources, n_attempts, reason, status)``, one row each; ``attempts(query_id,
    attempt, n_hits, reason)``; ``hits(query_id, chunk_id, source_type, score, rank)`` of the last attempt; ``used(query_id,
    rank, chunk_id, source_type, size, text)``, what the answer may cite; ``answers(query_id, answer, citations)``."""

    queries: DataFrame
    attempts: DataFrame
    hits: DataFrame
    used: DataFrame
    answers: DataFrame


def run(queries: DataFrame, index: lexical.Bm25Index, chunks: DataFrame, k: int = 5, budget: int = 2000, snippets: int = 3, routes: DataFrame | None = None) -> Run:
    """Answer ``queries(query_id, query)`` over ``chunks(chunk_id, source_type, text)`` and their index.

    A query is routed to its sources and searched there; if the evidence does not suffice but may be found elsewhere, it
    is searched once more in all sources. What then suffices is packed in the order of ranks as far as the budget goes,
    and answered by snippets that cite it. Every step is one plan over all queries; a second attempt costs a join for
    the queries that need it. ``routes`` replaces the rule router."""
    routes = staged(routing.rule_routes(queries) if routes is None else routes, "routes")
    allowed = routes.select("query_id", F.explode("sources").alias("source_type"))
    first = staged(lexical.bm25(index, queries, k, allowed), "first")
    gate = lambda hits, of, again: context.evidence(of, hits, "bm25", again).select("query_id", "reason", "status")
    judged = staged(gate(first, routes, True), "judged")
    open_routes = routes.join(judged.where("status = 'retryable'"), "query_id", "left_semi")
    second = staged(lexical.bm25(index, queries.join(open_routes, "query_id", "left_semi"), k), "second")
    again = staged(gate(second, open_routes, False), "again")
    hits = first.join(open_routes.select("query_id"), "query_id", "left_anti").select(second.columns).union(second)
    last = judged.join(again.select("query_id"), "query_id", "left_anti").withColumn("n_attempts", F.lit(1)).union(again.withColumn("n_attempts", F.lit(2)))
    status = F.when(F.col("status") == "sufficient", "answered").otherwise("abstained")
    done = queries.select("query_id", "query").join(routes.select("query_id", "intent", "sources"), "query_id").join(last.withColumn("status", status), "query_id")
    answered = done.where("status = 'answered'").select("query_id")
    texts = hits.join(answered, "query_id", "left_semi").join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("size", context.item_size("text"))
    used = staged(context.rank_prefix(texts, budget).select("query_id", "rank", "chunk_id", "source_type", "size", "text"), "used")
    count = lambda rows, n: rows.groupBy("query_id").agg(F.count("*").alias("n_hits")).withColumn("attempt", F.lit(n))
    tried = judged.select("query_id", "reason", F.lit(1).alias("attempt")).union(again.select("query_id", "reason", F.lit(2)))
    attempts = tried.join(count(first, 1).union(count(second, 2)), ["query_id", "attempt"], "left").select("query_id", "attempt", F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"), "reason")
    return Run(done, attempts, hits, used, context.extractive_answers(used, snippets))


def traces(done: Run) -> DataFrame:
    """One nested record for each query: ``(query_id, query, routing, attempts, context, answer, error)``."""
    tried = done.attempts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "n_hits", "reason"))).alias("attempts"))  # two at most
    packed = done.used.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("used"), F.sum("size").alias("n_chars"))
    rows = done.queries.join(tried, "query_id").join(packed, "query_id", "left").join(done.answers, "query_id", "left")
    error = F.when(F.col("status") == "answered", "none").when(F.col("reason") == "unanswerable_route", "router_error").otherwise("retrieval_miss")
    return rows.select(
        "query_id", "query", F.struct("intent", "sources").alias("routing"), "attempts", F.struct(F.coalesce("used", F.array().cast("array<string>")).alias("chunk_ids"), F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars")).alias("context"),
        F.struct("status", "answer", "citations").alias("answer"), error.alias("error"),
    )


def spans(records: DataFrame) -> DataFrame:
    """``(query_id, span, parent, status, error)`` of ``traces``: the run, its stages, and its attempts. The stage that an
    error belongs to has failed, and so has the run."""
    at_fault = F.when(F.col("error") == "router_error", "routing").when(F.col("error") == "retrieval_miss", "retrieval").when(F.col("error").startswith("llm"), "generation").when(F.col("error").startswith("citation"), "validation")
    span = lambda name, parent, failed: F.struct(name.alias("span"), parent.alias("parent"), F.when(failed, "failed").otherwise("succeeded").alias("status"), F.when(failed, F.col("error")).alias("error"))
    root = F.array(span(F.lit("run"), F.lit(None).cast("string"), F.col("error") != "none"))
    stages = F.array(*(span(F.lit(s), F.lit("run"), F.coalesce(at_fault == s, F.lit(False))) for s in STAGES))
    tries = F.transform("attempts", lambda a: F.struct(F.concat(F.lit("attempt."), a["attempt"].cast("string")).alias("span"), F.lit("run").alias("parent"), F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error")))
    return records.select("query_id", F.inline(F.concat(root, stages, tries)))


def judged_run(done: Run, labels: DataFrame) -> DataFrame:
    """``(query_id, status, n_used, n_relevant, recall, citation_precision, success)`` of a run against
    ``labels(query_id, relevant, answerable)``: an answerable query succeeds if its answer cites a relevant chunk, any
    other if it was not answered."""
    cited = done.used.select("query_id", "chunk_id")
    wanted = labels.select("query_id", F.explode(F.array_distinct("relevant")).alias("chunk_id")).withColumn("hit", F.lit(1))
    both = cited.join(wanted, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_used"), F.count("hit").alias("n_hit"))
    n = F.greatest(F.coalesce(F.size(F.array_distinct("relevant")), F.lit(0)), F.lit(0)).alias("n_relevant")
    rows = done.queries.select("query_id", "status").join(labels.select("query_id", "answerable", n), "query_id").join(both, "query_id", "left")
    rows = rows.select("query_id", "status", "answerable", "n_relevant", F.coalesce("n_used", F.lit(0).cast("long")).alias("n_used"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    answered = F.col("status") == "answered"
    return rows.select("query_id", "status", "n_used", "n_relevant", share("n_hit", "n_relevant").alias("recall"), share("n_hit", "n_used").alias("citation_precision"), F.when(F.col("answerable"), answered & (F.col("n_hit") > 0)).otherwise(~answered).alias("success"))
