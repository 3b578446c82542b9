"""Routing, evidence, context, graph and evaluation over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import context, dense, graph, metrics, routing
from lodestrand.plans.registry import CASES, CHUNKS, cases, chunks, chunks_of, query, searches
from lodestrand.plans.retrieval_queries import BM25, DENSE, FUSED, ranked, bm25_hits, dense_hits, fused_hits
from lodestrand.plans.text_queries import MATCH, SQUEEZED
from lodestrand.session import once, staged, table

HITS5 = f"{BM25}, h5 AS {ranked('bs', 5, 'source_type, chunk_id')}"
METRICS = """lb2 AS (SELECT query_id, unnest(list_distinct(relevant_chunk_ids)) AS chunk_id FROM se),
mt AS (SELECT se.query_id, count(lb2.chunk_id) AS n_relevant, count(h5.rank) AS n_hit, max(1.0 / h5.rank) AS rr, sum(1 / log2(h5.rank + 1.0)) AS dcg FROM se LEFT JOIN lb2 USING (query_id) LEFT JOIN h5 ON h5.query_id = se.query_id AND h5.chunk_id = lb2.chunk_id GROUP BY se.query_id),
pm AS (SELECT query_id, n_relevant, CASE WHEN n_relevant = 0 THEN 0.0 ELSE n_hit / n_relevant END AS recall, CAST(coalesce(rr, 0) AS DOUBLE) AS reciprocal_rank, CASE WHEN n_relevant = 0 THEN 0.0 ELSE coalesce(dcg / list_sum(list_transform(range(1, least(5, n_relevant) + 1), lambda i: 1 / log2(i + 1.0))), 0) END AS ndcg FROM mt)"""


def search_metrics(spark, d):
    return metrics.per_query(bm25_hits(spark, d), searches(spark, d).select("query_id", F.col("relevant_chunk_ids").alias("relevant")), 5)


@query("f9_retrieval_metrics", f"WITH {HITS5}, {METRICS} SELECT query_id, n_relevant, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM pm")
def f9(spark, d):
    return search_metrics(spark, d).select("query_id", "n_relevant", *(F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


@query("f15_run_summary", f"WITH {HITS5}, {METRICS} SELECT category, count(*) AS n_cases, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM pm JOIN se USING (query_id) GROUP BY GROUPING SETS ((), (category))")
def f15(spark, d):
    rows = search_metrics(spark, d).join(searches(spark, d).select("query_id", "category"), "query_id")
    return rows.groupingSets([[], ["category"]], "category").agg(F.count("*").alias("n_cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("o6_saved_metrics", f"WITH {CASES} SELECT category, round(avg(CASE WHEN coalesce(len(relevant_chunk_ids), 0) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(relevant_chunk_ids), relevant_chunk_ids[:2])) / len(list_distinct(relevant_chunk_ids)) END), 6) AS recall_at_2 FROM ca GROUP BY category")
def o6(spark, d):
    r = F.array_distinct("relevant_chunk_ids")
    share = F.when(F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) < 1, 0.0).otherwise(F.size(F.array_intersect(r, F.slice("relevant_chunk_ids", 1, 2))) / F.size(r))
    return cases(spark, d).groupBy("category").agg(F.round(F.avg(share), 6).alias("recall_at_2"))


def words_sql(words) -> str:
    return " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words)


RULE = f"{CASES}, ru AS (SELECT case_id, expected_intent, expected_sources, split, category, " + ", ".join(f"{words_sql(w)} AS n_{i}" for i, w in routing.INTENT_KEYWORDS.items()) + " FROM (SELECT *, lower(trim(query)) AS t FROM ca))" + ", rb AS (SELECT *, greatest(" + ", ".join(f"n_{i}" for i in routing.INTENT_KEYWORDS) + ") AS n FROM ru), rt AS (SELECT case_id, expected_intent, expected_sources, split, category, CAST(n AS INTEGER) AS n_keywords, CASE WHEN n = 0 THEN 'unknown' " + " ".join(f"WHEN n_{i} = n THEN '{i}'" for i in routing.INTENT_KEYWORDS) + " END AS intent FROM rb)" + ", rs AS (SELECT *, CASE intent " + " ".join(f"WHEN '{i}' THEN [{', '.join(repr(s) for s in v)}]" for i, v in routing.INTENT_SOURCES.items()) + " ELSE [] END AS sources FROM rt)"


def case_routes(spark, d):
    return routing.rule_routes(cases(spark, d).withColumnRenamed("case_id", "query_id"))


@query("i1_rule_routes", f"WITH {RULE} SELECT case_id AS query_id, intent, n_keywords, CAST(least(1.0, n_keywords / 2.0) AS DOUBLE) AS confidence, array_to_string(sources, ',') AS sources FROM rs")
def i1(spark, d):
    return case_routes(spark, d).withColumn("sources", F.array_join("sources", ","))


def routed(spark, d):
    own = cases(spark, d).select(F.col("case_id").alias("query_id"), "expected_intent", "expected_sources", "category", "split")
    return case_routes(spark, d).join(own, "query_id")


@query("f10_router_accuracy", f"WITH {RULE} SELECT split, count(*) AS n_cases, round(avg(CASE WHEN intent = expected_intent THEN 1.0 ELSE 0.0 END), 6) AS intent_accuracy, round(avg(CASE WHEN intent = expected_intent AND list_sort(sources) = list_sort(list_distinct(coalesce(expected_sources, []))) THEN 1.0 ELSE 0.0 END), 6) AS exact_accuracy FROM rs GROUP BY split")
def f10(spark, d):
    same = F.col("intent") == F.col("expected_intent")
    exact = same & (F.array_sort("sources") == F.array_sort(F.array_distinct(F.coalesce("expected_sources", F.array().cast("array<string>")))))
    return routed(spark, d).groupBy("split").agg(F.count("*").alias("n_cases"), F.round(F.avg(same.cast("double")), 6).alias("intent_accuracy"), F.round(F.avg(exact.cast("double")), 6).alias("exact_accuracy"))


@query("f11_source_metrics", f"WITH {RULE}, s AS (SELECT category, sources, list_distinct(coalesce(expected_sources, [])) AS goal FROM rs) SELECT category, round(avg(CASE WHEN len(sources) = 0 THEN CASE WHEN len(goal) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(sources, goal)) / len(sources) END), 6) AS source_precision, round(avg(CASE WHEN len(goal) = 0 THEN CASE WHEN len(sources) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(sources, goal)) / len(goal) END), 6) AS source_recall FROM s GROUP BY category")
def f11(spark, d):
    goal = F.array_distinct(F.coalesce("expected_sources", F.array().cast("array<string>")))
    both = F.size(F.array_intersect("sources", "goal"))
    share = lambda a, b: F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(both / F.size(a))
    rows = routed(spark, d).withColumn("goal", goal).groupBy("category")
    return rows.agg(F.round(F.avg(share("sources", "goal")), 6).alias("source_precision"), F.round(F.avg(share("goal", "sources")), 6).alias("source_recall"))


@query("f12_unknown_metrics", f"WITH {RULE} SELECT round(coalesce(sum(CASE WHEN intent = 'unknown' AND expected_intent = 'unknown' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN intent = 'unknown' THEN 1 ELSE 0 END), 0), 0), 6) AS unknown_precision, round(coalesce(sum(CASE WHEN intent = 'unknown' AND expected_intent = 'unknown' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN expected_intent = 'unknown' THEN 1 ELSE 0 END), 0), 0), 6) AS unknown_recall FROM rs")
def f12(spark, d):
    p, e = F.col("intent") == "unknown", F.col("expected_intent") == "unknown"
    hit = F.count_if(p & e)
    ratio = lambda n: F.round(F.coalesce(hit / F.nullif(F.count_if(n), F.lit(0)), F.lit(0.0)), 6)
    return routed(spark, d).agg(ratio(p).alias("unknown_precision"), ratio(e).alias("unknown_recall"))


@query("f13_confusion_matrix", f"WITH {RULE} SELECT expected_intent, intent, count(*) AS n FROM rs GROUP BY expected_intent, intent")
def f13(spark, d):
    return routed(spark, d).groupBy("expected_intent", "intent").agg(F.count("*").alias("n"))


@query("f20_failure_taxonomy", f"WITH {RULE}, f AS (SELECT case_id AS query_id, CASE WHEN intent <> expected_intent THEN 'router_error' END AS a, CASE WHEN len(list_filter(coalesce(expected_sources, []), lambda x: NOT list_contains(sources, x))) > 0 THEN 'source_missing' END AS b, CASE WHEN intent = 'unknown' AND expected_intent <> 'unknown' THEN 'unexpected_abstention' END AS c FROM rs) SELECT query_id, unnest(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS failure FROM f")
def f20(spark, d):
    missing = F.size(F.array_except(F.coalesce("expected_sources", F.array().cast("array<string>")), "sources")) > 0
    found = F.array(F.when(F.col("intent") != F.col("expected_intent"), "router_error"), F.when(missing, "source_missing"), F.when((F.col("intent") == "unknown") & (F.col("expected_intent") != "unknown"), "unexpected_abstention"))
    return routed(spark, d).select("query_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("failure"))


PROTO = f"{CASES}, pr AS (SELECT case_id AS query_id, split, expected_intent, CASE WHEN regexp_matches(query, '[：:]') AND length(trim(regexp_extract(query, '^([^：:]*)', 1))) BETWEEN 2 AND 16 THEN trim(regexp_extract(query, '^([^：:]*)', 1)) ELSE trim(query) END AS anchor FROM ca WHERE query IS NOT NULL)"


@query("i5_prototypes", f"WITH {PROTO} SELECT query_id, anchor FROM pr")
def i5(spark, d):
    return routing.prototypes(cases(spark, d).withColumnRenamed("case_id", "query_id").where("query is not null"))


@query("i4_feedback_anchors", f"WITH {PROTO}, an AS (SELECT anchor, min(expected_intent) AS intent FROM pr WHERE split = 'train' GROUP BY anchor) SELECT p.query_id, an.anchor, an.intent FROM (SELECT case_id AS query_id, trim(query) AS q FROM ca) p JOIN an ON p.q = an.anchor OR string_split(p.q, '：')[1] = an.anchor OR string_split(p.q, ':')[1] = an.anchor QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY length(an.anchor) DESC, an.anchor DESC) = 1")
def i4(spark, d):
    q = cases(spark, d).withColumnRenamed("case_id", "query_id")
    anchors = routing.prototypes(q.where("split = 'train'")).join(q.select("query_id", "expected_intent"), "query_id").groupBy("anchor").agg(F.min("expected_intent").alias("intent"))
    return routing.anchored(q, anchors)


CENTROID = f"{DENSE}, sc AS (SELECT query_id, source_type AS intent, max(score) AS score FROM ds GROUP BY query_id, source_type), sm AS (SELECT query_id, intent, score, score - lead(score, 1, 0.0) OVER w AS margin, row_number() OVER w AS n FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, intent))"


def semantic(spark, d):
    """The searches against every vector but themselves as a prototype of its source type."""
    v = dense.usable(table(spark, d, "chunk_vectors"), 64).select(F.col("embedding_version").alias("grp"), "chunk_id", "source_type", "unit")
    q = v.where("try_cast(split_part(chunk_id, '-', 2) as bigint) % 100 = 0").select("grp", F.col("chunk_id").alias("query_id"), "unit")
    return routing.semantic_routes(dense.best_by_source(q, v).withColumnRenamed("source_type", "intent"))


@query("i2_semantic_routes", f"WITH {CENTROID} SELECT query_id, CASE WHEN round(score, 9) >= 0.45 AND round(margin, 9) >= 0.02 THEN intent ELSE 'unknown' END AS intent, round(score, 6) AS score, round(margin, 6) AS margin FROM sm WHERE n = 1")
def i2(spark, d):
    return semantic(spark, d).select("query_id", "intent", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


EVIDENCE = f"{FUSED}, h5 AS (SELECT f.*, ch.source_type FROM {ranked('fu', 5, 'chunk_id')} f JOIN ch USING (chunk_id)), ev AS (SELECT se.query_id, se.expected_intent, coalesce(se.expected_sources, []) AS sources, count(h5.chunk_id) AS n, max(h5.score) AS top_score, list_distinct(list(h5.source_type)) AS got FROM se LEFT JOIN h5 USING (query_id) GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY se.query_id, se.expected_intent, coalesce(se.expected_sources, [])")


def fused_with_source(spark, d, k=5):
    return fused_hits(spark, d, k).join(chunks(spark, d).select("chunk_id", "source_type", "text", "title", "source_path"), "chunk_id")


@query("h1_evidence_gate", f"WITH {EVIDENCE}, r AS (SELECT query_id, top_score, len(list_filter(sources, lambda x: NOT list_contains(got, x))) AS m, CASE WHEN expected_intent = 'unknown' OR len(sources) = 0 THEN 'unanswerable_route' WHEN n < 1 THEN 'empty_retrieval' WHEN round(top_score, 9) < 0.02 THEN 'weak_retrieval_score' WHEN len(list_filter(sources, lambda x: NOT list_contains(got, x))) > 0 THEN 'required_sources_missing' ELSE 'sufficient_evidence' END AS reason FROM ev) SELECT query_id, reason, round(top_score, 9) AS top_score, CAST(m AS INTEGER) AS n_missing, CASE reason WHEN 'sufficient_evidence' THEN 'sufficient' WHEN 'unanswerable_route' THEN 'insufficient' ELSE 'retryable' END AS status FROM r")
def h1(spark, d):
    routes = searches(spark, d).select("query_id", F.col("expected_intent").alias("intent"), F.coalesce("expected_sources", F.array().cast("array<string>")).alias("sources"))
    return context.evidence(routes, fused_hits(spark, d, carried=("source_type",)), "hybrid").withColumn("top_score", F.round("top_score", 9))


ITEMS = f"{BM25}, it AS (SELECT b.query_id, b.rank, b.chunk_id, b.source_type, length({SQUEEZED.replace('{t}', 'ch.text')}) AS size FROM {ranked('bs', 20, 'source_type, chunk_id')} b JOIN ch USING (chunk_id))"


def items(spark, d, k=20):
    hits = staged(bm25_hits(spark, d, k), "hits")
    sizes = chunks_of(spark, d, hits).select("chunk_id", context.item_size("text").alias("size"))
    return hits.join(sizes, "chunk_id").select("query_id", "rank", "chunk_id", "source_type", "size")


@query("h3_rank_prefix", f"WITH {ITEMS} SELECT query_id, rank, chunk_id, CAST(sum(size + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - 2 AS BIGINT) AS used FROM it QUALIFY used <= 2000")
def h3(spark, d):
    return context.rank_prefix(items(spark, d), 2000).select("query_id", "rank", "chunk_id", "used")


@query("h4_source_balanced", f"""WITH RECURSIVE {ITEMS}, ld AS (SELECT it.*, row_number() OVER (PARTITION BY it.query_id, it.source_type ORDER BY it.rank) = 1 AND list_contains(coalesce(expected_sources, []), it.source_type) AS lead FROM it JOIN se USING (query_id)),
od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT lead, rank) AS o FROM ld),
pk AS (SELECT query_id, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS taken FROM se UNION ALL
SELECT pk.query_id, od.o, CASE WHEN used + CASE WHEN n > 0 THEN 2 ELSE 0 END + size <= 2000 THEN used + CASE WHEN n > 0 THEN 2 ELSE 0 END + size ELSE used END, CASE WHEN used + CASE WHEN n > 0 THEN 2 ELSE 0 END + size <= 2000 THEN n + 1 ELSE n END, CASE WHEN used + CASE WHEN n > 0 THEN 2 ELSE 0 END + size <= 2000 THEN od.rank END FROM pk JOIN od ON od.query_id = pk.query_id AND od.o = pk.o + 1)
SELECT it.query_id, it.rank, it.chunk_id FROM pk JOIN it ON it.query_id = pk.query_id AND it.rank = pk.taken""")
def h4(spark, d):
    required = searches(spark, d).select("query_id", F.coalesce("expected_sources", F.array().cast("array<string>")).alias("sources"))
    return context.source_balanced(staged(items(spark, d), "items"), required, 2000).select("query_id", "rank", "chunk_id")


@query("f25_context_metrics", f"WITH {ITEMS}, pf AS (SELECT *, sum(size + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - 2 AS used FROM it QUALIFY used <= 2000) SELECT query_id, count(*) AS n_chunks, round(max(used) / 2000, 6) AS budget_use, CAST(count(DISTINCT source_type) AS BIGINT) AS n_sources FROM pf GROUP BY query_id")
def f25(spark, d):
    return context.rank_prefix(items(spark, d), 2000).groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.round(F.max("used") / 2000, 6).alias("budget_use"), F.count_distinct("source_type").alias("n_sources"))


ANSWER = f"{BM25}, an AS (SELECT query_id, string_agg(rank || '. [' || rank || '] ' || substr(t, 1, 220) || CASE WHEN length(t) > 220 THEN '...' ELSE '' END, chr(10) ORDER BY rank) AS answer, string_agg(chunk_id, ',' ORDER BY rank) AS citations FROM (SELECT b.*, {SQUEEZED.replace('{t}', 'ch.text')} AS t FROM {ranked('bs', 3, 'source_type, chunk_id')} b JOIN ch USING (chunk_id)) GROUP BY query_id)"


def answers(spark, d):
    return context.extractive_answers(bm25_hits(spark, d, 3).join(chunks(spark, d).select("chunk_id", "text"), "chunk_id"))


@query("h7_extractive_answers", f"WITH {ANSWER} SELECT query_id, answer, citations FROM an")
def h7(spark, d):
    return answers(spark, d)


@query("f18_key_point_coverage", f"WITH {ANSWER}, p AS (SELECT se.query_id, {MATCH.replace('{t}', 'answer')} AS a, list_transform(expected_points, lambda x: {MATCH.replace('{t}', 'x')}) AS points FROM se JOIN an USING (query_id)) SELECT query_id, CASE WHEN coalesce(len(points), 0) > 0 THEN round(len(list_filter(points, lambda x: contains(a, x))) / len(points), 6) END AS coverage FROM p")
def f18(spark, d):
    rows = answers(spark, d).join(searches(spark, d).select("query_id", "expected_points"), "query_id").withColumn("a", T.match_text("answer"))
    return rows.select("query_id", F.round(metrics.key_point_coverage(F.transform("expected_points", lambda x: T.match_text(x)), F.col("a")), 6).alias("coverage"))


@query("f17_citation_validity", f"WITH {ANSWER} SELECT query_id, round(len(list_filter(string_split(citations, ','), lambda x: list_contains(coalesce(relevant_chunk_ids, []), x))) / len(string_split(citations, ',')), 6) AS validity FROM an JOIN se USING (query_id)")
def f17(spark, d):
    rows = answers(spark, d).join(searches(spark, d).select("query_id", F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")).alias("r")), "query_id").withColumn("c", F.split("citations", ","))
    return rows.select("query_id", F.round(F.size(F.filter("c", lambda x: F.array_contains("r", x))) / F.size("c"), 6).alias("validity"))


@query("h10_citation_issues", f"WITH {CASES}, {CHUNKS}, g AS (SELECT case_id AS query_id, answerable AS sufficient, list_concat(coalesce(relevant_chunk_ids, []), coalesce(relevant_chunk_ids, [])[1:1]) AS cited FROM ca), cx AS (SELECT ca.case_id AS query_id, c.chunk_id FROM (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca) ca JOIN ch c USING (chunk_id) WHERE c.source_type <> 'jd'), e AS (SELECT query_id, unnest(cited) AS chunk_id, generate_subscripts(cited, 1) AS pos FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS n FROM e) SELECT query_id, CASE WHEN sufficient THEN 'missing_citation' ELSE 'insufficient_with_citations' END AS issue, CAST(NULL AS VARCHAR) AS chunk_id FROM g WHERE (sufficient AND len(cited) = 0) OR (NOT sufficient AND len(cited) > 0) UNION ALL SELECT query_id, 'duplicate_citation', chunk_id FROM n WHERE n > 1 UNION ALL SELECT n.query_id, 'citation_not_found', n.chunk_id FROM n ANTI JOIN cx ON n.query_id = cx.query_id AND n.chunk_id = cx.chunk_id WHERE n.n = 1")
def h10(spark, d):
    none = F.array().cast("array<string>")
    own = F.coalesce("relevant_chunk_ids", none)
    g = cases(spark, d).select(F.col("case_id").alias("query_id"), F.col("answerable").alias("sufficient"), F.concat(own, F.slice(own, 1, 1)).alias("cited"))
    others = chunks(spark, d).where("source_type <> 'jd'").select("chunk_id")
    c = cases(spark, d).select(F.col("case_id").alias("query_id"), F.explode("relevant_chunk_ids").alias("chunk_id")).join(others, "chunk_id", "left_semi")
    return context.citation_issues(g, c)


@query("f19_end_to_end", f"WITH {CASES}, v AS (SELECT category, answerable, coalesce(len(relevant_chunk_ids), 0) > 1 AS answered, human_reviewed AS supported, len(expected_points) > 0 AS good FROM ca), s AS (SELECT category, CASE WHEN NOT answerable THEN NOT answered WHEN NOT answered THEN false WHEN supported IS NULL THEN NULL ELSE supported AND good END AS ok FROM v) SELECT category, count(*) AS n, count(ok) AS n_known, CASE WHEN count(ok) = count(*) THEN round(avg(CAST(ok AS DOUBLE)), 6) END AS success FROM s GROUP BY category".replace("CAST(ok AS DOUBLE)", "CASE WHEN ok THEN 1.0 ELSE 0.0 END"))
def f19(spark, d):
    rows = cases(spark, d).select("category", "answerable", (F.greatest(F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)), F.lit(0)) > 1).alias("answered"), F.col("human_reviewed").alias("supported"), (F.size("expected_points") > 0).alias("good"))
    ok = metrics.three_valued_success(F.col("answerable"), F.col("answered"), F.col("supported"), F.col("good"))
    return rows.withColumn("ok", ok).groupBy("category").agg(F.count("*").alias("n"), F.count("ok").alias("n_known"), F.round(metrics.all_known(F.col("ok").cast("double")), 6).alias("success"))


# Entities of the test tables: what the texts name most.
CATALOGUE = [("retrieval", "skill", ["RAG", "BM25", "HNSW"]), ("deduplication", "skill", ["SimHash"]), ("fine-tuning", "skill", ["LoRA"]), ("containers", "technology", ["Docker", "Kubernetes"]), ("PyTorch", "technology", []), ("Redis", "technology", []), ("Neo4j", "technology", []), ("PostgreSQL", "technology", ["pgvector"]), ("LangGraph", "technology", []), ("FastAPI", "technology", [])]
CATALOGUE_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', [{', '.join(repr(x.lower()) for x in dict.fromkeys([n, *a]))}])" for n, k, a in CATALOGUE) + ") AS t(name, node_type, words))"
NODE = "{k} || '-' || substr(sha1(trim(regexp_replace(lower({n}), '\\s+', ' ', 'g'))), 1, 12)"


def node_sql(kind: str, name: str) -> str:
    return NODE.replace("{k}", kind).replace("{n}", name)


GRAPH = f"""{CHUNKS}, {CATALOGUE_SQL}, dc AS (SELECT chunk_id, source_type, dt, coalesce(title, chunk_id) AS dn, {node_sql('dt', 'coalesce(title, chunk_id)')} AS doc FROM (SELECT *, CASE source_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.DOCUMENT_TYPES.items())} END AS dt FROM ch) WHERE dt IS NOT NULL),
nm AS (SELECT DISTINCT chunk_id, name, node_type, {node_sql('node_type', 'name')} AS node_id FROM (SELECT chunk_id, lower(text) AS t FROM ch) JOIN (SELECT name, node_type, unnest(words) AS w FROM cat) ON contains(t, w)),
ed AS (SELECT edge_type, source_node_id, target_node_id, list_sort(list_distinct(list(chunk_id))) AS chunk_ids FROM (SELECT CASE WHEN source_type = 'jd' THEN 'requires' WHEN source_type = 'interview' THEN 'asks_about' WHEN source_type = 'project_logs' AND node_type = 'technology' THEN 'uses' ELSE 'demonstrates' END AS edge_type, doc AS source_node_id, node_id AS target_node_id, chunk_id FROM nm JOIN dc USING (chunk_id) UNION ALL SELECT 'related_to', a.node_id, b.node_id, a.chunk_id FROM nm a JOIN nm b ON a.chunk_id = b.chunk_id AND a.node_type = 'skill' AND b.node_type = 'technology') GROUP BY edge_type, source_node_id, target_node_id),
eg AS (SELECT 'edge-' || substr(sha1(edge_type || '|' || source_node_id || '|' || target_node_id), 1, 12) AS edge_id, * FROM ed),
nd AS (SELECT node_id, node_type, min(name) AS name, list_sort(list_distinct(list(chunk_id))) AS chunk_ids FROM (SELECT doc AS node_id, dt AS node_type, dn AS name, chunk_id FROM dc UNION ALL SELECT nm.node_id, nm.node_type, nm.name, chunk_id FROM nm JOIN dc USING (chunk_id)) GROUP BY node_id, node_type),
aj AS (SELECT source_node_id AS node, target_node_id AS next, edge_id, edge_type FROM eg UNION ALL SELECT target_node_id, source_node_id, edge_id, edge_type FROM eg WHERE source_node_id <> target_node_id)"""


def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "name string, node_type string, aliases array<string>")


def built(spark, d) -> graph.Graph:
    """The graph of the chunks, extracted once an application."""
    return once(table(spark, d, "chunks"), "graph", lambda: graph.kept(graph.extract(chunks(spark, d), catalogue(spark))))


@query("f5_graph_nodes", f"WITH {GRAPH} SELECT node_id, node_type, name, len(chunk_ids) AS n_chunks, list_min(chunk_ids) AS first_chunk, list_max(chunk_ids) AS last_chunk FROM nd")
def f5(spark, d):
    g = built(spark, d)
    held = g.node_chunks.groupBy("node_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))
    return g.nodes.join(held, "node_id").select("node_id", "node_type", "name", "n_chunks", "first_chunk", "last_chunk")


@query("f6_graph_edges", f"WITH {GRAPH} SELECT edge_id, edge_type, source_node_id, target_node_id, len(chunk_ids) AS n_chunks FROM eg")
def f6(spark, d):
    g = built(spark, d)
    return g.edges.join(g.edge_chunks.groupBy("edge_id").agg(F.count("*").alias("n_chunks")), "edge_id").select("edge_id", "edge_type", "source_node_id", "target_node_id", "n_chunks")


@query("c13_adjacency", f"WITH {GRAPH} SELECT node, edge_type, count(*) AS n_links, count(DISTINCT next) AS n_next FROM aj GROUP BY node, edge_type")
def c13(spark, d):
    return graph.adjacency(built(spark, d).edges).groupBy("node", "edge_type").agg(F.count("*").alias("n_links"), F.count_distinct("next").alias("n_next"))


LINKS = f"{GRAPH}, se AS (SELECT chunk_id AS query_id, text AS query FROM ch WHERE TRY_CAST(split_part(chunk_id, '-', 2) AS BIGINT) % 100 = 0), lk AS (SELECT DISTINCT query_id, {node_sql('node_type', 'name')} AS node FROM (SELECT query_id, lower(query) AS t FROM se) JOIN (SELECT name, node_type, unnest(words) AS w FROM cat) ON contains(t, w))"


def text_searches(spark, d):
    """The texts of documents whose number is divisible by 100, as queries against all chunks."""
    rows = chunks(spark, d).where("try_cast(split_part(chunk_id, '-', 2) as bigint) % 100 = 0")
    return rows.select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"))


def links(spark, d):
    found = graph.mentions(text_searches(spark, d), "query_id", "query", catalogue(spark))
    return found.select("query_id", graph.node_id(F.col("node_type"), F.col("name")).alias("node"))


@query("b10_entity_mentions", f"WITH {GRAPH} SELECT chunk_id, name, node_type FROM nm")
def b10(spark, d):
    return graph.mentions(chunks(spark, d), "chunk_id", "text", catalogue(spark))


@query("c12_entity_links", f"WITH {GRAPH}, {CASES} SELECT DISTINCT case_id, name FROM (SELECT case_id, lower(query) AS t FROM ca) JOIN (SELECT name, unnest(words) AS w FROM cat) ON contains(t, w)")
def c12(spark, d):
    return graph.mentions(cases(spark, d), "case_id", "query", catalogue(spark)).select("case_id", "name")


REACH = LINKS.replace("WITH ", "") + ", r0 AS (SELECT query_id, node, 0 AS hops FROM lk), r1 AS (SELECT DISTINCT query_id, next AS node, 1 AS hops FROM r0 JOIN aj USING (node)), s1 AS (SELECT query_id, node, min(hops) AS hops FROM (FROM r0 UNION ALL FROM r1) GROUP BY query_id, node), r2 AS (SELECT DISTINCT query_id, next AS node, 2 AS hops FROM s1 JOIN aj USING (node) WHERE hops = 1), s2 AS (SELECT query_id, node, CAST(min(hops) AS INTEGER) AS hops FROM (FROM s1 UNION ALL FROM r2) GROUP BY query_id, node)"


@query("c14_bounded_reach", f"WITH {REACH} SELECT query_id, hops, count(*) AS n_nodes FROM s2 GROUP BY query_id, hops")
def c14(spark, d):
    return graph.reach_counts(links(spark, d), built(spark, d).edges, 2)


RELATIONS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + f" THEN '{name}' END" for name, words in graph.RELATION_WORDS.items()) + "], lambda x: x IS NOT NULL)"


NODES = 160  # nodes visited for a query, first in, first out
CAPPED = LINKS.replace("WITH ", "") + f""", v0 AS (SELECT query_id, node, 0 AS hops, row_number() OVER (PARTITION BY query_id ORDER BY node) AS visit FROM lk QUALIFY visit <= {NODES}),
k1 AS (SELECT query_id, next AS node, min({{'v': visit, 't': edge_type, 'n': next}}) AS key FROM v0 JOIN aj USING (node) GROUP BY query_id, next), n1 AS (SELECT query_id, node, 1 AS hops, row_number() OVER (PARTITION BY query_id ORDER BY key) + (SELECT count(*) FROM v0 WHERE v0.query_id = k1.query_id) AS visit FROM k1 ANTI JOIN v0 USING (query_id, node) QUALIFY visit <= {NODES}), w1 AS (FROM v0 UNION ALL FROM n1),
k2 AS (SELECT query_id, next AS node, min({{'v': visit, 't': edge_type, 'n': next}}) AS key FROM n1 JOIN aj USING (node) GROUP BY query_id, next), n2 AS (SELECT query_id, node, 2 AS hops, row_number() OVER (PARTITION BY query_id ORDER BY key) + (SELECT count(*) FROM w1 WHERE w1.query_id = k2.query_id) AS visit FROM k2 ANTI JOIN w1 USING (query_id, node) QUALIFY visit <= {NODES}),
s2 AS (SELECT query_id, node, CAST(hops AS INTEGER) AS hops FROM (FROM w1 UNION ALL FROM n2))"""


GRAPH_HITS = f"""wt AS (SELECT query_id, {RELATIONS} AS wanted FROM se), gc AS (SELECT query_id, unnest(chunk_ids) AS chunk_id, 1.0 / (1 + hops) AS score, hops FROM s2 JOIN nd ON nd.node_id = s2.node UNION ALL SELECT query_id, unnest(eg.chunk_ids), 0.8 / (1 + hops) + CASE WHEN list_contains(wanted, aj.edge_type) THEN 0.2 ELSE 0.0 END, hops + 1 FROM s2 JOIN aj USING (node) JOIN eg USING (edge_id) JOIN wt USING (query_id) WHERE hops < 2),
gb AS (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(hops AS INTEGER) AS hops FROM gc QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(score, 9) DESC, hops) = 1)"""


@query("d18_graph_topk", f"WITH {CAPPED}, {GRAPH_HITS} SELECT query_id, chunk_id, round(score, 6) AS score, hops, rank FROM {ranked('gb', 10, 'hops, chunk_id', 'true')}")
def d18(spark, d):
    hits = graph.graph_hits(text_searches(spark, d), built(spark, d), links(spark, d), 2, 10, NODES)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "hops", "rank")


#: The walk from what the searches among the cases name.
CASE_WALK = CASES + ", " + CAPPED.replace("se AS (SELECT chunk_id AS query_id, text AS query FROM ch WHERE TRY_CAST(split_part(chunk_id, '-', 2) AS BIGINT) % 100 = 0)", "se AS (SELECT *, case_id AS query_id FROM ca WHERE CAST(substring(case_id, 5) AS BIGINT) % 100 = 0)")
