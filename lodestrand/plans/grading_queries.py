"""Judgements of answers and reports over runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import adaptive, graph, grading, lexical, metrics, ranking, routing
from lodestrand.plans.evaluation_queries import CASE_WALK, GRAPH_HITS, METRICS, NODES, PROTO, RULE, built, case_routes, catalogue
from lodestrand.plans.registry import CASES, CHUNKS, cases, chunks, query, searches
from lodestrand.plans.retrieval_queries import BM25, CONFIDENCE, FEATURES, FUSED, RERANKED, bm25_hits, fused_hits, index_of, ranked, reranked_hits
from lodestrand.plans.text_queries import MATCH
from lodestrand.session import staged, table

NUMBER = "cast(substring(case_id, 5) as bigint)"
#: Graders' texts of five kinds by the number of a case: a judgement left out, false evidence, a renamed point, broken, right.
GRADED = f"""{CASES}, gr AS (SELECT case_id, answerable, list_distinct(expected_points) AS points, CAST(substring(case_id, 5) AS BIGINT) % 5 AS n FROM ca WHERE len(expected_points) > 0),
kp AS (SELECT case_id, answerable, len(points) AS n_points, CASE n WHEN 0 THEN 'count' WHEN 1 THEN 'evidence' WHEN 2 THEN 'points' WHEN 3 THEN 'invalid_json' END AS error, CASE WHEN n = 4 THEN least(2, len(points)) END AS n_covered FROM gr), kc AS (SELECT *, n_covered / n_points AS coverage FROM kp)"""


def graded_points(spark, d):
    n = F.expr(f"{NUMBER} % 5")
    rows = cases(spark, d).where("size(expected_points) > 0").select("case_id", "answerable", "query", F.array_distinct("expected_points").alias("points"), n.alias("n"))
    rows = rows.withColumn("answer", F.concat_ws(" ", "query", F.array_join(F.slice("points", 1, 2), " ")))
    one = lambda p, i: F.struct(F.when((F.col("n") == 2) & (i == 0), F.lit("another point")).otherwise(p).alias("point"), F.when(i < 2, "covered").otherwise("not_covered").alias("verdict"), F.when((F.col("n") == 1) & (i == 0), "made up §").when(i < 2, p).otherwise("").alias("answer_evidence"), F.lit("read").alias("reason"))
    judged = F.transform("points", one)
    judged = F.when(F.col("n") == 0, F.slice(judged, F.lit(1), F.size("points") - 1)).otherwise(judged)
    raw = F.when(F.col("n") == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(judged.alias("judgments"))))
    return grading.point_judgements(rows.select("case_id", raw.alias("raw"), "answer", F.col("points").alias("expected")))


@query("k4_point_judgements", f"WITH {GRADED} SELECT case_id, error, CAST(n_points AS INTEGER) AS n_points, CAST(n_covered AS INTEGER) AS n_covered, round(coverage, 6) AS coverage FROM kc")
def k4(spark, d):
    return graded_points(spark, d).select("case_id", "error", "n_points", "n_covered", F.round("coverage", 6).alias("coverage"))


CLAIMED = f"""{CASES}, {CHUNKS}, cx AS (SELECT case_id, list(DISTINCT chunk_id) AS ids FROM (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca) JOIN ch USING (chunk_id) WHERE length({MATCH.replace('{t}', 'text')}) > 0 GROUP BY case_id),
kl AS (SELECT case_id, CASE CAST(substring(case_id, 5) AS BIGINT) % 6 WHEN 0 THEN 'citation' WHEN 1 THEN 'quotation' WHEN 2 THEN 'bare' WHEN 3 THEN 'claim' END AS error, CAST(substring(case_id, 5) AS BIGINT) % 6 AS n FROM cx JOIN ca USING (case_id) WHERE length({MATCH.replace('{t}', 'query')}) > 0)"""


def claimed(spark, d):
    """One claim for each case, the query itself, cited and quoted from its relevant chunks: with an unknown id, a false
    quotation, no quotation, another claim, unsupported, or right."""
    c = cases(spark, d).where(F.length(T.match_text("query")) > 0)
    cited = c.select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id")).distinct().join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").where(F.length(T.match_text("text")) > 0)
    n = F.expr(f"{NUMBER} % 6")
    own = cited.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", F.substring("text", 1, 60).alias("text")))).alias("spans"))  # the labels of one case
    rows = c.join(own, "case_id").withColumn("n", n)
    ids = F.transform("spans", lambda x: x["chunk_id"])
    spans = F.transform("spans", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), F.when(F.col("n") == 1, "§ not there §").otherwise(x["text"]).alias("text")))
    claim = F.struct(F.when(F.col("n") == 3, "§ not said §").otherwise(F.col("query")).alias("claim"), F.when(F.col("n") == 4, "unsupported").otherwise("supported").alias("verdict"), F.when(F.col("n") == 0, F.array(F.lit("nowhere"))).otherwise(ids).alias("citation_ids"), F.when(F.col("n") == 2, F.array().cast("array<struct<chunk_id:string,text:string>>")).otherwise(spans).alias("evidence"), F.lit("read").alias("reason"))
    raw = F.to_json(F.struct(F.array(claim).alias("claims")))
    return grading.claim_judgements(rows.select("case_id", raw.alias("raw"), F.col("query").alias("answer")), cited)


@query("k5_claim_judgements", f"WITH {CLAIMED} SELECT case_id, error, CASE WHEN error IS NULL THEN 1 END AS n_claims, CASE WHEN error IS NULL THEN CASE WHEN n = 4 THEN 0 ELSE 1 END END AS n_supported, CASE WHEN error IS NULL THEN n = 4 END AS unsupported FROM kl")
def k5(spark, d):
    return claimed(spark, d)


@query("k7_audit", f"WITH {GRADED}, {CLAIMED.replace(CASES + ', ', '', 1)}, au AS (SELECT ca.case_id, ca.answerable, coalesce(len(relevant_chunk_ids), 0) > 0 AS answered, coverage, CASE WHEN kl.error IS NULL THEN kl.n = 4 END AS unsupported FROM ca LEFT JOIN kc USING (case_id) LEFT JOIN kl ON kl.case_id = ca.case_id) SELECT case_id, round(coverage, 6) AS coverage, unsupported, CASE WHEN NOT answerable THEN NOT answered WHEN NOT answered THEN false ELSE coverage >= 0.5 AND NOT unsupported END AS success FROM au")
def k7(spark, d):
    own = cases(spark, d).select("case_id", "answerable", (F.greatest(F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)), F.lit(0)) > 0).alias("answered"))
    return grading.audit(own, graded_points(spark, d), claimed(spark, d)).select("case_id", F.round("coverage", 6).alias("coverage"), "unsupported", "success")


LEXICAL = f"lx AS (SELECT case_id, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS lexical FROM (SELECT p.case_id, p.point, bool_or(contains(t.t, p.p)) AS hit FROM (SELECT case_id, unnest(list_distinct(expected_points)) AS point, {MATCH.replace('{t}', 'point')} AS p FROM ca) p JOIN (SELECT case_id, {MATCH.replace('{t}', 'text')} AS t FROM (SELECT case_id, unnest(list_distinct(relevant_chunk_ids)) AS chunk_id FROM ca) JOIN ch USING (chunk_id)) t USING (case_id) GROUP BY p.case_id, p.point) GROUP BY case_id)"
BOTH = f"{GRADED}, {CHUNKS}, {LEXICAL}, bo AS (SELECT kc.case_id, answerable, lexical, coverage AS semantic, round(coverage - lexical, 9) AS delta FROM kc LEFT JOIN lx USING (case_id))"


def both_gradings(spark, d):
    c = cases(spark, d)
    texts = c.select("case_id", F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id")).join(chunks(spark, d).select("chunk_id", T.match_text("text").alias("t")), "chunk_id")
    points = c.select("case_id", F.explode(F.array_distinct("expected_points")).alias("point"))
    hits = points.join(texts, "case_id").groupBy("case_id", "point").agg(F.bool_or(F.contains("t", T.match_text("point"))).alias("hit"))
    lexical_mean = hits.groupBy("case_id").agg(F.avg(F.col("hit").cast("int")).alias("lexical"))
    rows = graded_points(spark, d).join(c.select("case_id", "answerable"), "case_id").join(lexical_mean, "case_id", "left")
    return rows.select("case_id", "answerable", "lexical", F.col("coverage").alias("semantic"))


@query("f21_compared_coverage", f"WITH {BOTH}, cm AS (SELECT * FROM bo WHERE answerable AND lexical IS NOT NULL AND semantic IS NOT NULL) SELECT count(*) AS n_comparable, (SELECT count(*) FROM bo WHERE answerable AND semantic IS NULL) AS n_unknown, round(avg(lexical), 6) AS lexical_mean, round(avg(semantic), 6) AS semantic_mean, count(CASE WHEN delta > 0 THEN 1 END) AS n_improved, count(CASE WHEN delta < 0 THEN 1 END) AS n_regressed, count(CASE WHEN delta = 0 THEN 1 END) AS n_alike FROM cm")
def f21(spark, d):
    rows = grading.compared_coverage(both_gradings(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("lexical_mean", "semantic_mean")})


@query("f21_compared_cases", f"WITH {BOTH} SELECT case_id, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round(delta, 6) AS delta FROM bo WHERE answerable AND lexical IS NOT NULL AND semantic IS NOT NULL ORDER BY CASE WHEN delta <> 0 THEN 0 ELSE 1 END, case_id LIMIT 10")
def f21_cases(spark, d):
    return grading.compared_cases(both_gradings(spark, d)).select("case_id", *(F.round(c, 6).alias(c) for c in ("lexical", "semantic", "delta")))


@query("f35_relabelled_support", f"WITH {CLAIMED}, lb AS (SELECT case_id, NOT human_reviewed AS label FROM ca WHERE split = 'test') SELECT kl.case_id, coalesce(label, CASE WHEN error IS NULL THEN n = 4 END) AS unsupported FROM kl LEFT JOIN lb USING (case_id)")
def f35(spark, d):
    labels = cases(spark, d).where("split = 'test'").select("case_id", (~F.col("human_reviewed")).alias("unsupported"))
    return grading.relabelled(claimed(spark, d).select("case_id", "unsupported"), labels, "case_id", "unsupported")


@query("f36_run_states", f"WITH {CLAIMED}, r AS (SELECT coalesce(error, 'read') AS status, n = 5 OR n = 4 AS success, CASE WHEN error IS NULL THEN n <> 4 END AS grounded FROM kl) SELECT status, count(*) AS n, count(CASE WHEN grounded THEN 1 END) AS n_grounded, count(CASE WHEN success AND NOT coalesce(grounded, false) THEN 1 END) AS n_success_ungrounded FROM r GROUP BY status")
def f36(spark, d):
    number = F.expr(f"{NUMBER} % 6")
    return grading.run_states(claimed(spark, d).select(F.coalesce("error", F.lit("read")).alias("status"), number.isin(4, 5).alias("success"), (~F.col("unsupported")).alias("grounded")))


@query("f27_rerank_rate", f"WITH {CONFIDENCE}, cc AS (SELECT se.category, coalesce(round(0.25 * least(1.0, n / 5.0) + 0.20 * least(1.0, greatest(0.0, CASE WHEN s2 IS NULL THEN 1.0 ELSE (s1 - s2) / s1 END)) + 0.25 * CASE WHEN len(coalesce(expected_sources, [])) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(expected_sources), got)) / len(list_distinct(expected_sources)) END + 0.30 * agreement, 6), 0) < 0.6 AS invoked FROM se LEFT JOIN cf USING (query_id)) SELECT category, count(*) AS n, count(CASE WHEN invoked THEN 1 END) AS n_invoked, round(avg(CASE WHEN invoked THEN 1.0 ELSE 0.0 END), 6) AS rate FROM cc GROUP BY category")
def f27(spark, d):
    """How often a search is unsure enough to be re-ranked."""
    q = searches(spark, d)
    hits = fused_hits(spark, d).join(chunks(spark, d).select("chunk_id", "source_type"), "chunk_id")
    sure = adaptive.confidence(hits, q.select("query_id", F.col("expected_sources").alias("sources")), 5)
    rows = q.select("query_id", "category").join(sure, "query_id", "left").withColumn("invoked", F.coalesce("confidence", F.lit(0.0)) < 0.6)
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("invoked").alias("n_invoked"), F.round(F.avg(F.col("invoked").cast("int")), 6).alias("rate"))


def _recall_sql(source: str, rank: str, name: str) -> str:
    return f"{name} AS (SELECT se.query_id, CASE WHEN coalesce(len(list_distinct(relevant_chunk_ids)), 0) = 0 THEN 0.0 ELSE count(h.chunk_id) / len(list_distinct(relevant_chunk_ids)) END AS recall FROM se LEFT JOIN (SELECT * FROM {source} WHERE {rank} <= 5) h ON h.query_id = se.query_id AND list_contains(relevant_chunk_ids, h.chunk_id) GROUP BY se.query_id, relevant_chunk_ids)"


def recalls(spark, d, hits):
    return metrics.per_query(hits, searches(spark, d).select("query_id", F.col("relevant_chunk_ids").alias("relevant")), 5).select("query_id", "recall")


@query("o11_rerank_deltas", f"WITH {RERANKED}, {_recall_sql('c10', 'rank', 'rb0')}, {_recall_sql('r2', 'rerank_rank', 'ra0')} SELECT query_id, round(ra0.recall - rb0.recall, 6) AS delta FROM ra0 JOIN rb0 USING (query_id)")
def o11(spark, d):
    hits = staged(reranked_hits(spark, d), "reranked")  # both ranks of the ten best: the documents are read once
    after = hits.where("rerank_rank <= 5").select("query_id", "chunk_id", F.col("rerank_rank").alias("rank"))
    rows = recalls(spark, d, after).join(recalls(spark, d, hits).withColumnRenamed("recall", "before"), "query_id")
    return rows.select("query_id", F.round(F.col("recall") - F.col("before"), 6).alias("delta"))


@query("o12_router_matrix", f"WITH {RULE}, {PROTO.replace(CASES + ', ', '', 1)}, an AS (SELECT anchor, min(expected_intent) AS intent FROM pr WHERE split = 'train' GROUP BY anchor), fb AS (SELECT p.case_id, an.intent FROM (SELECT case_id, trim(query) AS q FROM ca) p JOIN an ON p.q = an.anchor OR string_split(p.q, '：')[1] = an.anchor OR string_split(p.q, ':')[1] = an.anchor QUALIFY row_number() OVER (PARTITION BY p.case_id ORDER BY length(an.anchor) DESC, an.anchor DESC) = 1), al AS (SELECT 'rule' AS router, intent, expected_intent FROM rs UNION ALL SELECT 'feedback', coalesce(fb.intent, rs.intent), expected_intent FROM rs LEFT JOIN fb USING (case_id) UNION ALL SELECT 'unknown', 'unknown', expected_intent FROM rs) SELECT router, count(*) AS n, round(avg(CASE WHEN intent = expected_intent THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(CASE WHEN intent = 'unknown' THEN 1 END) AS n_unknown FROM al GROUP BY router")
def o12(spark, d):
    """The rule router, the anchors of the train split over it, and one that knows nothing."""
    q = cases(spark, d).withColumnRenamed("case_id", "query_id")
    anchors = routing.prototypes(q.where("split = 'train'")).join(q.select("query_id", "expected_intent"), "query_id").groupBy("anchor").agg(F.min("expected_intent").alias("intent"))
    feedback = routing.anchored(q, anchors).select("query_id", F.col("intent").alias("own"))
    rule = case_routes(spark, d).select("query_id", "intent").join(q.select("query_id", "expected_intent"), "query_id")
    part = lambda rows, name, intent: rows.select(F.lit(name).alias("router"), intent.alias("intent"), "expected_intent")
    rows = part(rule, "rule", F.col("intent")).union(part(rule.join(feedback, "query_id", "left"), "feedback", F.coalesce("own", "intent"))).union(part(rule, "unknown", F.lit("unknown")))
    right = F.coalesce(F.col("intent") == F.col("expected_intent"), F.lit(False)).cast("int")
    return rows.groupBy("router").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.count_if(F.col("intent") == "unknown").alias("n_unknown"))


def case_links(spark, d):
    named = graph.mentions(searches(spark, d).select("query_id", "query"), "query_id", "query", catalogue(spark))
    return named.select("query_id", graph.node_id(F.col("node_type"), F.col("name")).alias("node"))


GRAPH_RUN = f"{CASE_WALK}, {GRAPH_HITS}, h5 AS {ranked('gb', 5, 'hops, chunk_id', 'true')}, {METRICS}, {FEATURES}, gv AS (SELECT DISTINCT query_id FROM s2 JOIN aj USING (node) WHERE hops < 2), pc AS (SELECT se.query_id, category, answerable, recall, reciprocal_rank, ndcg, CASE WHEN gv.query_id IS NOT NULL THEN 1.0 END AS path_validity, CASE WHEN coalesce(len(expected_sources), 0) > 0 THEN CASE WHEN ff.is_cross_document = (len(expected_sources) >= 2) THEN 1.0 ELSE 0.0 END END AS selector FROM se JOIN pm USING (query_id) JOIN ff ON ff.case_id = se.query_id LEFT JOIN gv USING (query_id))"


@query("f16_graph_run", f"WITH {GRAPH_RUN} SELECT category, count(*) AS n, count(CASE WHEN answerable THEN 1 END) AS n_answerable, round(avg(CASE WHEN answerable THEN recall END), 6) AS recall, round(avg(CASE WHEN answerable THEN reciprocal_rank END), 6) AS mrr, round(avg(CASE WHEN answerable THEN ndcg END), 6) AS ndcg, round(avg(path_validity), 6) AS path_validity, round(avg(selector), 6) AS selector_accuracy FROM pc GROUP BY GROUPING SETS ((), (category))")
def f16(spark, d):
    """Graph retrieval for the searches among the cases: ranks over the answerable ones, whether the edges that were
    walked lie between known nodes, and whether the rule for graph search agrees with the number of wanted sources."""
    q, g = searches(spark, d), built(spark, d)
    links = case_links(spark, d)
    hits = graph.graph_hits(q.select("query_id", "query"), g, links, 2, 5, NODES)
    own = metrics.per_query(hits, q.select("query_id", F.col("relevant_chunk_ids").alias("relevant")), 5)
    walked = graph.reach(links, g.edges, 2, NODES).where("hops < 2").join(graph.adjacency(g.edges), "node")
    known = g.nodes.select(F.col("node_id").alias("next"), F.lit(1.0).alias("there"))
    valid = walked.join(known, "next", "left").groupBy("query_id").agg(F.avg(F.coalesce("there", F.lit(0.0))).alias("path_validity"))
    cross = adaptive.features(q, "query_id", "query", "expected_sources").select("query_id", "is_cross_document", "source_count")
    rows = q.select("query_id", "category", "answerable").join(own, "query_id").join(cross, "query_id").join(valid, "query_id", "left")
    selector = F.when(F.col("source_count") > 0, (F.col("is_cross_document") == (F.col("source_count") >= 2)).cast("double"))
    mean = lambda c, n: F.round(F.avg(F.when(F.col("answerable"), F.col(c))), 6).alias(n)
    summed = rows.withColumn("selector", selector).groupingSets([[], ["category"]], "category")
    return summed.agg(F.count("*").alias("n"), F.count_if("answerable").alias("n_answerable"), mean("recall", "recall"), mean("reciprocal_rank", "mrr"), mean("ndcg", "ndcg"), F.round(F.avg("path_validity"), 6).alias("path_validity"), F.round(F.avg("selector"), 6).alias("selector_accuracy"))


@query("o13_retrieval_matrix", f"WITH {FUSED}, f5 AS {ranked('fu', 5, 'chunk_id')}, {RERANKED.replace(BM25 + ', ', '', 1)}, cf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(2.0 / (60 + rank) + 1.0 / (60 + rerank_rank), 9) DESC, rank, chunk_id) AS fused_rank FROM r2), {_recall_sql('la', 'rank', 'm1')}, {_recall_sql('lb', 'rank', 'm2')}, {_recall_sql('f5', 'rank', 'm3')}, {_recall_sql('r2', 'rerank_rank', 'm4')}, {_recall_sql('cf', 'fused_rank', 'm5')} SELECT strategy, count(*) AS n, round(avg(recall), 6) AS recall FROM (SELECT 'bm25' AS strategy, recall FROM m1 UNION ALL SELECT 'keyword', recall FROM m2 UNION ALL SELECT 'hybrid', recall FROM m3 UNION ALL SELECT 'rerank', recall FROM m4 UNION ALL SELECT 'conservative', recall FROM m5) GROUP BY strategy")
def o13(spark, d):
    """Recall at 5 of the lexical retrievers for the same searches."""
    index, q = index_of(spark, d), searches(spark, d)
    again = lambda rows, c: rows.select("query_id", "chunk_id", F.col(c).alias("rank"))
    # the documents are read once for each of two rankings; the other runs are made of their first places
    bm25, keyword = staged(lexical.bm25(index, q, 20, shares=True), "bm25"), staged(lexical.keyword(index, q, 20), "keyword")
    reranked = ranking.rerank(bm25.where("rank <= 10"), F.col("share"), 10)
    runs = {"bm25": bm25, "keyword": keyword, "hybrid": ranking.reciprocal_rank_fusion(bm25, keyword, 5), "rerank": again(reranked.where("rerank_rank <= 5"), "rerank_rank"), "conservative": again(ranking.conservative_fusion(reranked, 5), "fused_rank")}
    rows = [recalls(spark, d, hits).select(F.lit(name).alias("strategy"), "recall") for name, hits in runs.items()]
    return reduce(DataFrame.union, rows).groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"))


@query("o19_fixed_demos", f"WITH {CASES}, {CHUNKS}, r AS (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca WHERE answerable) SELECT case_id, r.chunk_id, coalesce(source_type, 'unknown') AS source_type, coalesce(title, 'unknown') AS title FROM r LEFT JOIN ch ON ch.chunk_id = r.chunk_id")
def o19(spark, d):
    wanted = cases(spark, d).where("answerable").select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    rows = wanted.join(chunks(spark, d).select("chunk_id", "source_type", "title"), "chunk_id", "left")
    return rows.select("case_id", "chunk_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("title", F.lit("unknown")).alias("title"))


@query("o20_fault_matrix", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY event_type")
def o20(spark, d):
    rows = table(spark, d, "events").withColumn("ok", (F.col("event_id") % 4 != 0).cast("int")).withColumn("fallback", (F.col("event_id") % 7 == 0).cast("int"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("success_rate"), F.round(F.avg("fallback"), 6).alias("fallback_rate"), metrics.nearest_rank("value", 0.5).alias("p50"), metrics.nearest_rank("value", 0.95).alias("p95"))
