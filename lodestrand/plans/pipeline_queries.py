"""Whole runs over the searches, their traces and their judgement."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import context, graph, pipeline, routing
from lodestrand.operators.adaptive import CROSS_DOCUMENT_MARKERS
from lodestrand.plans.evaluation_queries import CATALOGUE_SQL, RELATIONS, RULE, catalogue
from lodestrand.plans.registry import CASES, cases, chunks, query, searches
from lodestrand.plans.retrieval_queries import BM25, any_sql, index_of, ranked
from lodestrand.plans.text_queries import SQUEEZED

BUDGET = 2000
REASON = "CASE WHEN intent = 'unknown' OR len(sources) < 1 THEN 'unanswerable_route' WHEN n < 1 THEN 'empty_retrieval' WHEN round(top_score, 9) < 0.0 THEN 'weak_retrieval_score' WHEN len(list_filter(sources, lambda x: NOT list_contains(coalesce(got, []), x))) > 0 THEN 'required_sources_missing' ELSE 'sufficient_evidence' END"


def gate_sql(hits: str, of: str) -> str:
    return f"SELECT query_id, {REASON} AS reason FROM (SELECT r.query_id, intent, sources, count(h.chunk_id) AS n, max(h.score) AS top_score, list(DISTINCT h.source_type) AS got FROM {of} r LEFT JOIN {hits} h USING (query_id) GROUP BY r.query_id, intent, sources)"


RUN = f"""{BM25}, {RULE.replace(CASES + ', ', '', 1)}, ro AS (SELECT case_id AS query_id, intent, sources FROM rs SEMI JOIN se ON rs.case_id = se.query_id), al AS (SELECT query_id, unnest(sources) AS source_type FROM ro),
f1 AS (SELECT bs.* FROM bs SEMI JOIN al ON bs.query_id = al.query_id AND bs.source_type = al.source_type), a1 AS {ranked('f1', 5, 'source_type, chunk_id')}, g1 AS ({gate_sql('a1', 'ro')}),
ag AS (SELECT ro.* FROM ro JOIN g1 USING (query_id) WHERE reason NOT IN ('unanswerable_route', 'sufficient_evidence')), f2 AS (SELECT bs.* FROM bs SEMI JOIN ag USING (query_id)), a2 AS {ranked('f2', 5, 'source_type, chunk_id')}, g2 AS ({gate_sql('a2', 'ag')}),
la1 AS (SELECT query_id, reason, 1 AS n_attempts FROM g1 ANTI JOIN g2 USING (query_id) UNION ALL SELECT query_id, reason, 2 FROM g2), dn AS (SELECT ro.query_id, intent, sources, reason, n_attempts, CASE WHEN reason = 'sufficient_evidence' THEN 'answered' ELSE 'abstained' END AS status FROM ro JOIN la1 USING (query_id)),
hi AS (SELECT * FROM a1 ANTI JOIN ag USING (query_id) UNION ALL SELECT * FROM a2), it AS (SELECT hi.query_id, hi.rank, hi.chunk_id, CAST(length({SQUEEZED.replace('{t}', 'ch.text')}) AS BIGINT) AS size FROM hi JOIN dn USING (query_id) JOIN ch USING (chunk_id) WHERE status = 'answered'),
us AS (SELECT query_id, rank, chunk_id, size FROM it QUALIFY sum(size + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - 2 <= {BUDGET}), ui AS (SELECT query_id, count(*) AS n_used, string_agg(chunk_id, ',' ORDER BY rank) AS used, CAST(sum(size) AS BIGINT) AS n_chars FROM us GROUP BY query_id)"""


def run_of(spark, d) -> pipeline.Run:
    return pipeline.run(searches(spark, d).select("query_id", "query"), index_of(spark, d), chunks(spark, d).select("chunk_id", "source_type", "text"), 5, BUDGET)


@query("h12_pipeline_run", f"WITH {RUN} SELECT query_id, intent, array_to_string(sources, ',') AS sources, n_attempts, reason, status, coalesce(used, '') AS used, coalesce(n_chars, 0) AS n_chars FROM dn LEFT JOIN ui USING (query_id)")
def h12(spark, d):
    done = run_of(spark, d)
    used = done.used.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("used"), F.sum("size").alias("n_chars"))
    rows = done.queries.join(used, "query_id", "left")
    return rows.select("query_id", "intent", F.array_join("sources", ",").alias("sources"), "n_attempts", "reason", "status", F.coalesce("used", F.lit("")).alias("used"), F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars"))


@query("l10_traces", f"WITH {RUN}, tries AS (SELECT query_id, '1:' || (SELECT count(*) FROM a1 WHERE a1.query_id = g1.query_id) || ':' || reason AS a, 1 AS o FROM g1 UNION ALL SELECT query_id, '2:' || (SELECT count(*) FROM a2 WHERE a2.query_id = g2.query_id) || ':' || reason, 2 FROM g2) SELECT dn.query_id, dn.intent, (SELECT string_agg(a, ',' ORDER BY o) FROM tries WHERE tries.query_id = dn.query_id) AS attempts, coalesce(used, '') AS chunk_ids, status, CASE WHEN status = 'answered' THEN 'none' WHEN reason = 'unanswerable_route' THEN 'router_error' ELSE 'retrieval_miss' END AS error FROM dn LEFT JOIN ui USING (query_id)")
def l10(spark, d):
    rows = pipeline.traces(run_of(spark, d))
    tries = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["attempt"].cast("string"), a["n_hits"].cast("string"), a["reason"])), ",")
    return rows.select("query_id", "routing.intent", tries.alias("attempts"), F.array_join("context.chunk_ids", ",").alias("chunk_ids"), "answer.status", "error")


@query("l11_spans", f"WITH {RUN}, er AS (SELECT query_id, n_attempts, CASE WHEN status = 'answered' THEN 'none' WHEN reason = 'unanswerable_route' THEN 'router_error' ELSE 'retrieval_miss' END AS error FROM dn), sp AS (SELECT query_id, error, unnest(['run', 'routing', 'retrieval', 'evidence', 'context', 'generation', 'validation']) AS span FROM er) SELECT query_id, span, CASE WHEN span <> 'run' THEN 'run' END AS parent, CASE WHEN span = 'run' AND error <> 'none' OR span = 'routing' AND error = 'router_error' OR span = 'retrieval' AND error = 'retrieval_miss' THEN 'failed' ELSE 'succeeded' END AS status FROM sp UNION ALL SELECT query_id, 'attempt.' || unnest(range(1, n_attempts + 1)), 'run', 'succeeded' FROM er")
def l11(spark, d):
    return pipeline.spans(pipeline.traces(run_of(spark, d))).select("query_id", "span", "parent", "status")


@query("o7_run_judgement", f"WITH {RUN}, lb AS (SELECT query_id, unnest(list_distinct(relevant_chunk_ids)) AS chunk_id FROM se), nu AS (SELECT us.query_id, count(*) AS n_used, count(lb.chunk_id) AS n_hit FROM us LEFT JOIN lb ON lb.query_id = us.query_id AND lb.chunk_id = us.chunk_id GROUP BY us.query_id), j AS (SELECT dn.query_id, status, answerable, coalesce(len(list_distinct(relevant_chunk_ids)), 0) AS n_relevant, coalesce(n_used, 0) AS n_used, coalesce(n_hit, 0) AS n_hit FROM dn JOIN se USING (query_id) LEFT JOIN nu USING (query_id)) SELECT query_id, status, n_used, CAST(n_relevant AS INTEGER) AS n_relevant, round(CASE WHEN n_relevant = 0 THEN 0.0 ELSE n_hit / n_relevant END, 6) AS recall, round(CASE WHEN n_used = 0 THEN 0.0 ELSE n_hit / n_used END, 6) AS citation_precision, CASE WHEN answerable THEN status = 'answered' AND n_hit > 0 ELSE status <> 'answered' END AS success FROM j")
def o7(spark, d):
    labels = searches(spark, d).select("query_id", F.col("relevant_chunk_ids").alias("relevant"), "answerable")
    rows = pipeline.judged_run(run_of(spark, d), labels)
    return rows.select("query_id", "status", "n_used", "n_relevant", F.round("recall", 6).alias("recall"), F.round("citation_precision", 6).alias("citation_precision"), "success")


@query("h5_built_context", f"WITH {RUN}, sk AS (SELECT query_id, string_agg(it.chunk_id, ',' ORDER BY it.rank) AS skipped FROM it ANTI JOIN us USING (query_id, rank) GROUP BY query_id), co AS (SELECT query_id, list_sort(list(DISTINCT ch.source_type)) AS covered FROM us JOIN ch USING (chunk_id) GROUP BY query_id) SELECT query_id, coalesce(used, '') AS used, coalesce(skipped, '') AS skipped, array_to_string(coalesce(covered, []), ',') AS covered, array_to_string(list_filter(sources, lambda x: NOT list_contains(coalesce(covered, []), x)), ',') AS missing FROM dn LEFT JOIN ui USING (query_id) LEFT JOIN sk USING (query_id) LEFT JOIN co USING (query_id) WHERE status = 'answered'")
def h5(spark, d):
    done = run_of(spark, d)
    answered = done.queries.where("status = 'answered'")
    items = done.hits.join(answered.select("query_id"), "query_id", "left_semi").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").withColumn("size", context.item_size("text"))
    rows = context.built_context(items, answered.select("query_id", "sources"), BUDGET)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("query_id", joined("used"), joined("skipped"), joined("covered"), joined("missing"))


CROSS = f"({any_sql('t', CROSS_DOCUMENT_MARKERS)} OR (contains(t, '岗位') AND {any_sql('t', ('项目', '经历', '简历'))}))"


@query("j1_query_decomposition", f"WITH {CASES}, {CATALOGUE_SQL}, q AS (SELECT case_id, query, lower(trim(query)) AS t FROM ca WHERE query IS NOT NULL), en AS (SELECT case_id, count(DISTINCT name) AS n FROM q JOIN (SELECT name, unnest(words) AS w FROM cat) ON contains(t, w) GROUP BY case_id), r AS (SELECT case_id, {RELATIONS} AS relations, {CROSS} AS is_cross, coalesce(n, 0) AS n_entities FROM q LEFT JOIN en USING (case_id)) SELECT case_id, array_to_string(relations, ',') AS relations, n_entities, is_cross, array_to_string(list_filter([CASE WHEN list_contains(relations, 'requires') THEN 'find_requirements' END, CASE WHEN list_contains(relations, 'demonstrates') OR list_contains(relations, 'uses') THEN 'find_evidence' END, CASE WHEN is_cross THEN 'connect' END], lambda x: x IS NOT NULL), ',') AS subgoals FROM r")
def j1(spark, d):
    rows = graph.decomposed(cases(spark, d).where("query is not null").select(F.col("case_id").alias("query_id"), "query"), catalogue(spark))
    return rows.select(F.col("query_id").alias("case_id"), F.array_join("relations", ",").alias("relations"), F.size("entities").cast("long").alias("n_entities"), "is_cross", F.array_join("subgoals", ",").alias("subgoals"))
