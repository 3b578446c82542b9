"""Comparisons of runs, gates, verdicts, paths, event logs and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import dense, gates, graph, labelling, lexical, metrics, ranking, routing
from lodestrand.plans.evaluation_queries import GRAPH, HITS5, METRICS, NODES, REACH, RULE, built, case_routes, links, search_metrics, semantic, text_searches, CENTROID
from lodestrand.plans.registry import CASES, CHUNKS, cases, chunks, query, searches
from lodestrand.plans.retrieval_queries import KEYWORD, bm25_hits, dense_hits, index_of, ranked
from lodestrand.plans.text_queries import MATCH
from lodestrand.session import staged, table


def keyword_metrics(spark, d):
    hits = lexical.keyword(index_of(spark, d), searches(spark, d))
    return metrics.per_query(hits, searches(spark, d).select("query_id", F.col("relevant_chunk_ids").alias("relevant")), 5)


BOTH_RUNS = f"{HITS5}, {METRICS}, {KEYWORD}, k5 AS {ranked('ks', 5, 'source_type, chunk_id')}, km AS (SELECT se.query_id, CASE WHEN count(lb2.chunk_id) = 0 THEN 0.0 ELSE count(k5.rank) / count(lb2.chunk_id) END AS recall FROM se LEFT JOIN lb2 USING (query_id) LEFT JOIN k5 ON k5.query_id = se.query_id AND k5.chunk_id = lb2.chunk_id GROUP BY se.query_id)"


@query("c27_run_changes", f"WITH {BOTH_RUNS} SELECT km.query_id, round(km.recall, 6) AS old, round(pm.recall, 6) AS new, CASE WHEN round(pm.recall, 9) > round(km.recall, 9) THEN 'improved' WHEN round(pm.recall, 9) < round(km.recall, 9) THEN 'regressed' ELSE 'same' END AS change FROM km JOIN pm USING (query_id)")
def c27(spark, d):
    rows = gates.changes(keyword_metrics(spark, d), search_metrics(spark, d), "query_id", "recall")
    return rows.select("query_id", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "change")


@query("e13_largest_differences", f"WITH {BOTH_RUNS} SELECT query_id, round(greatest(pm.recall, km.recall) - least(pm.recall, km.recall), 6) AS spread FROM pm JOIN km USING (query_id) ORDER BY spread DESC, query_id LIMIT 10")
def e13(spark, d):
    rows = gates.changes(keyword_metrics(spark, d), search_metrics(spark, d), "query_id", "recall")
    return rows.select("query_id", F.round(F.abs(F.col("new") - F.col("old")), 6).alias("spread")).orderBy(F.desc("spread"), "query_id").limit(10)  # a top-10 report


@query("f28_metric_gate", f"WITH {BOTH_RUNS}, m AS (SELECT 'recall' AS metric, (SELECT avg(recall) FROM km) AS old, (SELECT avg(recall) FROM pm) AS new), g AS (SELECT * FROM (VALUES ('recall', 'higher', 0.05), ('latency', 'lower', 1.25)) AS t(metric, direction, allowance)) SELECT metric, coalesce(CASE WHEN direction = 'higher' THEN round(new, 9) >= round(old - allowance, 9) ELSE new <= old * allowance END, false) AS passed FROM g LEFT JOIN m USING (metric)")
def f28(spark, d):
    old, new = keyword_metrics(spark, d).agg(F.round(F.avg("recall"), 9).alias("old")), search_metrics(spark, d).agg(F.round(F.avg("recall"), 9).alias("new"))
    values = old.crossJoin(new).withColumn("metric", F.lit("recall"))  # one row each
    rules = spark.createDataFrame([("recall", "higher", 0.05), ("latency", "lower", 1.25)], "metric string, direction string, allowance double")
    return gates.gate(values, rules)


@query("f30_regression_suite", f"WITH {RULE} SELECT case_id, CASE WHEN split = 'test' THEN 'fixed' ELSE 'open' END AS status, CASE WHEN split = 'test' THEN coalesce(intent = expected_intent, false) END AS passed FROM rs")
def f30(spark, d):
    expected = cases(spark, d).select("case_id", F.when(F.col("split") == "test", "fixed").otherwise("open").alias("status"), F.col("expected_intent").alias("result"))
    return gates.regressions(expected, case_routes(spark, d).select(F.col("query_id").alias("case_id"), F.col("intent").alias("result")))


@query("k3_support_verdicts", f"WITH {CASES}, c AS (SELECT r.case_id, CASE WHEN d.license_status IS NULL THEN NULL ELSE d.license_status = 'unknown' END AS unsupported FROM (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca) r JOIN (SELECT DISTINCT chunk_id, TRY_CAST(metadata['document_id'] AS BIGINT) AS doc_id FROM chunks WHERE text IS NOT NULL) l USING (chunk_id) JOIN documents d USING (doc_id)) SELECT case_id, CASE WHEN coalesce(bool_or(unsupported), false) THEN true WHEN count(unsupported) < count(*) THEN NULL ELSE false END AS unsupported FROM c GROUP BY case_id")
def k3(spark, d):
    labels = cases(spark, d).select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    owner = table(spark, d, "chunks").where("text is not null").select("chunk_id", F.col("metadata")["document_id"].try_cast("long").alias("doc_id")).distinct()
    rows = labels.join(owner, "chunk_id").join(table(spark, d, "documents").select("doc_id", "license_status"), "doc_id")
    return gates.verdict(rows.withColumn("unsupported", F.col("license_status") == "unknown"), "case_id", "unsupported")


@query("k2_point_coverage", f"WITH {CASES}, {CHUNKS}, e AS (SELECT case_id, string_agg({MATCH.replace('{t}', 'text')}, ' ') AS t FROM (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca) JOIN ch USING (chunk_id) GROUP BY case_id), p AS (SELECT case_id, {MATCH.replace('{t}', 'x')} AS point FROM (SELECT case_id, unnest(expected_points) AS x FROM ca)) SELECT case_id, count(*) AS n_points, round(avg(CASE WHEN t IS NULL THEN NULL WHEN contains(t, point) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM p LEFT JOIN e USING (case_id) GROUP BY case_id")
def k2(spark, d):
    labels = cases(spark, d).select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id")).join(chunks(spark, d).select("chunk_id", T.match_text("text").alias("t")), "chunk_id")
    texts = labels.groupBy("case_id").agg(F.array_join(F.collect_list("t"), " ").alias("t"))  # the labels of one case
    points = cases(spark, d).select("case_id", F.explode("expected_points").alias("x")).select("case_id", T.match_text("x").alias("point"))
    rows = points.join(texts, "case_id", "left")
    return rows.groupBy("case_id").agg(F.count("*").alias("n_points"), F.round(F.avg(F.contains(F.col("t"), F.col("point")).cast("double")), 6).alias("coverage"))


@query("i3_hybrid_routes", f"WITH {CENTROID}, q AS (SELECT query_id, source_type FROM dq JOIN un ON un.grp = dq.grp AND un.chunk_id = dq.query_id), b AS (SELECT q.query_id, CASE source_type WHEN 'user_profile' THEN 'unknown' ELSE source_type END AS intent, s.sem, s.score, s.margin FROM q LEFT JOIN (SELECT query_id, CASE WHEN round(score, 9) >= 0.45 AND round(margin, 9) >= 0.02 THEN intent ELSE 'unknown' END AS sem, score, margin FROM sm WHERE n = 1) s USING (query_id)) SELECT query_id, CASE WHEN intent = sem THEN intent WHEN coalesce(sem, 'unknown') <> 'unknown' AND round(score, 9) >= 0.55 AND round(margin, 9) >= 0.04 THEN sem ELSE intent END AS intent, CASE WHEN intent = sem THEN 'agree' WHEN coalesce(sem, 'unknown') <> 'unknown' AND round(score, 9) >= 0.55 AND round(margin, 9) >= 0.04 THEN 'semantic' ELSE 'rule' END AS how FROM b")
def i3(spark, d):
    v = dense.usable(table(spark, d, "chunk_vectors"), 64).where("try_cast(split_part(chunk_id, '-', 2) as bigint) % 100 = 0")
    rule = v.select(F.col("chunk_id").alias("query_id"), F.when(F.col("source_type") == "user_profile", "unknown").otherwise(F.col("source_type")).alias("intent"), F.lit(1).alias("n_keywords"))
    return routing.hybrid_routes(rule, semantic(spark, d))


PATHS = f"""{GRAPH}, st AS (SELECT node, next, edge_id FROM aj WHERE node <> next), p2 AS (SELECT x.node AS a, x.next AS b, y.next AS c, x.edge_id AS e1, y.edge_id AS e2 FROM st x JOIN st y ON x.next = y.node WHERE x.node <> y.next AND x.edge_id <> y.edge_id), p3 AS (SELECT p2.a, p2.b, p2.c, z.next AS d, e1, e2, z.edge_id AS e3 FROM p2 JOIN st z ON z.node = p2.c WHERE z.next <> p2.a AND z.next <> p2.b AND z.edge_id <> e1 AND z.edge_id <> e2)"""


@query("c15_path_counts", f"WITH {PATHS} SELECT 2 AS hops, b AS middle, count(*) AS n_paths FROM p2 WHERE a < c GROUP BY b UNION ALL SELECT 3, e2, count(*) FROM p3 WHERE a < d GROUP BY e2")
def c15_counts(spark, d):
    return graph.path_counts(built(spark, d).edges)


@query("c17_edge_validity", f"WITH {GRAPH} SELECT edge_type, count(*) AS n_edges, count(a.node_id) AS n_sources, count(b.node_id) AS n_targets FROM eg LEFT JOIN nd a ON a.node_id = source_node_id LEFT JOIN nd b ON b.node_id = target_node_id GROUP BY edge_type")
def c17(spark, d):
    g = built(spark, d)
    ids = g.nodes.select("node_id")
    rows = g.edges.join(ids.toDF("s"), F.col("source_node_id") == F.col("s"), "left").join(ids.toDF("t"), F.col("target_node_id") == F.col("t"), "left")
    return rows.groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.count("s").alias("n_sources"), F.count("t").alias("n_targets"))


@query("c20_cited_context", f"WITH {CASES}, {CHUNKS}, r AS (SELECT DISTINCT unnest(relevant_chunk_ids) AS chunk_id FROM ca WHERE split = 'test') SELECT ch.chunk_id, source_type FROM ch SEMI JOIN r USING (chunk_id)")
def c20(spark, d):
    cited = cases(spark, d).where("split = 'test'").select(F.explode("relevant_chunk_ids").alias("chunk_id"))
    return chunks(spark, d).join(cited, "chunk_id", "left_semi").select("chunk_id", "source_type")


@query("c22_label_remap", f"WITH {CASES}, {CHUNKS}, r AS (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id, expected_points FROM ca WHERE coalesce(len(expected_points), 0) > 0), o AS (SELECT r.case_id, r.chunk_id, r.expected_points, ch.source_path FROM r JOIN ch USING (chunk_id)), c AS (SELECT o.case_id, o.chunk_id, n.chunk_id AS candidate, len(list_filter(expected_points, lambda x: contains({MATCH.replace('{t}', 'n.text')}, {MATCH.replace('{t}', 'x')}))) AS n FROM o JOIN ch n ON n.source_path = o.source_path) SELECT case_id, chunk_id, candidate, CAST(n AS INTEGER) AS n_points FROM c QUALIFY row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY n DESC, candidate) = 1")
def c22(spark, d):
    labels = cases(spark, d).where("size(expected_points) > 0").select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id"), F.transform("expected_points", lambda x: T.match_text(x)).alias("points"))
    found = chunks(spark, d).select("chunk_id", "source_path", T.match_text("text").alias("t"))
    return labelling.remapped(labels, found)


@query("d19_graph_lexical_fusion", f"""WITH {REACH}, gl AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hops, chunk_id) AS INTEGER) AS rank FROM (SELECT query_id, unnest(chunk_ids) AS chunk_id, min(hops) AS hops FROM s2 JOIN nd ON nd.node_id = s2.node WHERE hops = 0 GROUP BY 1, 2) QUALIFY rank <= 20), ll AS (SELECT se.query_id, ch.chunk_id, CAST(row_number() OVER (PARTITION BY se.query_id ORDER BY ch.chunk_id) AS INTEGER) AS rank FROM se JOIN ch ON se.query = ch.text QUALIFY rank <= 20),
fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS rank_a, b.rank AS rank_b, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score FROM gl a FULL JOIN ll b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id) SELECT query_id, chunk_id, rank_a, rank_b, rank FROM {ranked('fu', 10, 'chunk_id')}""".replace("GROUP BY 1, 2", "GROUP BY query_id, chunk_id").replace("unnest(chunk_ids) AS chunk_id, min(hops) AS hops FROM s2 JOIN nd ON nd.node_id = s2.node WHERE hops = 0 GROUP BY query_id, chunk_id", "chunk_id, min(hops) AS hops FROM (SELECT query_id, unnest(chunk_ids) AS chunk_id, hops FROM s2 JOIN nd ON nd.node_id = s2.node WHERE hops = 0) GROUP BY query_id, chunk_id"))
def d19(spark, d):
    linked = graph.linked_chunks(links(spark, d), built(spark, d), 20)
    same = text_searches(spark, d).join(chunks(spark, d).select("chunk_id", F.col("text").alias("query")), "query").withColumn("score", F.lit(1.0))
    return ranking.reciprocal_rank_fusion(linked, ranking.top_k(same, 20, "chunk_id"), 10).select("query_id", "chunk_id", "rank_a", "rank_b", "rank")


@query("d19_graph_vector_fusion")
def d19_vectors(spark, d):
    """Graph hits as in D18 fused with the nearest stored vectors, for the chunks that are searches of both."""
    q = text_searches(spark, d)
    linked = graph.graph_hits(q, built(spark, d), links(spark, d), 2, 20, NODES)
    near = dense_hits(spark, d, 20).join(q.select("query_id"), "query_id", "left_semi")
    return ranking.fusion_or_second(staged(linked, "graph_hits"), staged(near, "vector_hits"), 10)


@query("e3_last_events", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n FROM events QUALIFY n <= 4")
def e3(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(order)).where("n <= 4").select("user_id", "event_id", "n")


@query("e11_floor_index", "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, CAST(max(CASE WHEN i = floor((n - 1) * 0.95) THEN value END) AS DOUBLE) AS p95 FROM o GROUP BY event_type")
def e11(spark, d):
    rows = table(spark, d, "events").where("value is not null")
    counts = rows.groupBy("event_type", "value").agg(F.count("*").alias("m"))  # equal values count once
    before = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("m").over(before)).join(totals, "event_type")
    return upto.where(F.col("upto") > F.floor((F.col("n") - 1) * 0.95)).groupBy("event_type").agg(F.min("value").cast("double").alias("p95"))


@query("f23_latency_by_stage", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY event_type")
def f23(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), metrics.nearest_rank("value", 0.5).alias("p50"), metrics.nearest_rank("value", 0.95).alias("p95"))


@query("f33_set_operations", f"WITH {CASES}, {CHUNKS}, r AS (SELECT case_id, list_distinct(list(source_type)) AS got FROM (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca) JOIN ch USING (chunk_id) GROUP BY case_id) SELECT case_id, array_to_string(list_sort(list_filter(list_distinct(expected_sources), lambda x: NOT list_contains(got, x))), ',') AS missing, array_to_string(list_sort(list_intersect(list_distinct(expected_sources), got)), ',') AS covered, CAST(len(list_distinct(list_concat(expected_sources, got))) AS INTEGER) AS n_all FROM ca JOIN r USING (case_id)")
def f33(spark, d):
    labels = cases(spark, d).select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id")).join(chunks(spark, d).select("chunk_id", "source_type"), "chunk_id")
    got = labels.groupBy("case_id").agg(F.collect_set("source_type").alias("got"))
    rows = cases(spark, d).join(got, "case_id")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select("case_id", joined(F.array_except("expected_sources", "got")).alias("missing"), joined(F.array_intersect("expected_sources", "got")).alias("covered"), F.size(F.array_union("expected_sources", "got")).alias("n_all"))


@query("l3_first_of_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def l3(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("l5_newest_version", "SELECT job_id, max(version) AS version, arg_max(content_hash, (version, content_hash)) AS content_hash FROM job_postings GROUP BY job_id")
def l5(spark, d):
    return table(spark, d, "job_postings").groupBy("job_id").agg(F.max(F.struct("version", "content_hash")).alias("m")).select("job_id", "m.version", "m.content_hash")


@query("l7_exact_text_dedup", f"WITH {CASES} SELECT case_id, expected_intent FROM ca WHERE query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY expected_intent, {MATCH.replace('{t}', 'query')} ORDER BY case_id) = 1")
def l7(spark, d):
    rows = cases(spark, d).where("query is not null").groupBy("expected_intent", T.match_text("query").alias("m")).agg(F.min("case_id").alias("case_id"))
    return rows.select("case_id", "expected_intent")


@query("l13_replay_compare", f"WITH {RULE} SELECT CAST((SELECT count(*) FROM (SELECT case_id, intent FROM rs EXCEPT ALL SELECT case_id, intent FROM rt)) AS INTEGER) AS n_missing, CAST((SELECT count(*) FROM (SELECT case_id, intent FROM rt EXCEPT ALL SELECT case_id, intent FROM rs)) AS INTEGER) AS n_extra")
def l13(spark, d):
    a, b = case_routes(spark, d).select("query_id", "intent"), case_routes(spark, d).select("query_id", "intent")
    return a.exceptAll(b).agg(F.count("*").cast("int").alias("n_missing")).crossJoin(b.exceptAll(a).agg(F.count("*").cast("int").alias("n_extra")))  # one row each


@query("o10_disagreements", f"WITH {RULE} SELECT case_id FROM rs WHERE intent <> expected_intent OR NOT (list_sort(sources) = list_sort(list_distinct(coalesce(expected_sources, []))))")
def o10(spark, d):
    own = cases(spark, d).select("case_id", "expected_intent", F.array_sort(F.array_distinct(F.coalesce("expected_sources", F.array().cast("array<string>")))).alias("goal"))
    rows = case_routes(spark, d).withColumnRenamed("query_id", "case_id").join(own, "case_id")
    return rows.where((F.col("intent") != F.col("expected_intent")) | (F.array_sort("sources") != F.col("goal"))).select("case_id")


@query("x1_event_windows", "SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY start_us, event_type")
def l_windows(spark, d):
    from lodestrand.streaming.events import windowed

    return windowed(table(spark, d, "events"), "5 minutes").select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))
