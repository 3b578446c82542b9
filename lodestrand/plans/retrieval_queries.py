"""Retrieval: keyword, BM25, exact vectors, fusion, re-ranking and the adaptive choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import adaptive, dense, lexical, ranking
from lodestrand.plans.registry import CHUNKS, SEARCHES, cases, chunks, chunks_in_place, query, searches
from lodestrand.plans.text_queries import VEC, tokens_sql
from lodestrand.session import once, table

POSTINGS = f"""{CHUNKS}, tk AS (SELECT chunk_id, source_type, {tokens_sql('text')} AS tokens FROM ch),
po AS (SELECT chunk_id, source_type, token, dl, count(*) AS tf FROM (SELECT chunk_id, source_type, len(tokens) AS dl, unnest(tokens) AS token FROM tk) GROUP BY chunk_id, source_type, token, dl),
df AS (SELECT token, count(*) AS df FROM po GROUP BY token), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tk)"""
QUERY_TOKENS = f"qt AS (SELECT query_id, unnest(list_distinct({tokens_sql('query')})) AS token FROM se)"
BM25 = f"""{SEARCHES}, {POSTINGS}, {QUERY_TOKENS}, bs AS (SELECT query_id, chunk_id, source_type, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM po JOIN qt USING (token) JOIN df USING (token), st GROUP BY query_id, chunk_id, source_type)"""


def ranked(source: str, k: int, ties: str, where: str = "score > 0") -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {ties}) AS INTEGER) AS rank FROM {source} WHERE {where} QUALIFY rank <= {k})"


def index_of(spark, d) -> lexical.Bm25Index:
    """The inverted index of the chunks, built once an application and read by every query."""
    return once(table(spark, d, "chunks"), "bm25", lambda: lexical.build_index(chunks_in_place(spark, d)))


@query("d2_index_stats", f"WITH {POSTINGS} SELECT (SELECT n FROM st) AS n_chunks, round((SELECT avgdl FROM st), 6) AS avgdl, (SELECT count(*) FROM df) AS n_tokens, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_occurrences FROM po")
def d2(spark, d):
    index = index_of(spark, d)
    total = index.postings.agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_occurrences"))
    words = index.df.agg(F.count("*").alias("n_tokens"))
    return index.stats.crossJoin(total).crossJoin(words).select(F.col("n").alias("n_chunks"), F.round("avgdl", 6).alias("avgdl"), "n_tokens", "n_postings", "n_occurrences")  # one row each


@query("d2_document_frequency", f"WITH {POSTINGS} SELECT token, df FROM df")
def d2_df(spark, d):
    return index_of(spark, d).df


def bm25_hits(spark, d, k=5, sources=None):
    return lexical.bm25(index_of(spark, d), searches(spark, d), k, sources)


@query("d3_bm25_topk", f"WITH {BM25} SELECT query_id, chunk_id, source_type, round(score, 6) AS score, rank FROM {ranked('bs', 5, 'source_type, chunk_id')}")
def d3(spark, d):
    return bm25_hits(spark, d).select("query_id", "chunk_id", "source_type", F.round("score", 6).alias("score"), "rank")


KEYWORD = f"""ks AS (SELECT query_id, c.chunk_id, c.source_type, count(*) / any_value(n) AS score FROM (SELECT chunk_id, source_type, unnest(list_distinct({tokens_sql('text')})) AS token FROM ch) c JOIN (SELECT query_id, len(list_distinct({tokens_sql('query')})) AS n, unnest(list_distinct({tokens_sql('query')})) AS token FROM se) q USING (token) GROUP BY query_id, c.chunk_id, c.source_type)"""


@query("d1_keyword_topk", f"WITH {SEARCHES}, {CHUNKS}, {KEYWORD} SELECT query_id, chunk_id, source_type, round(score, 6) AS score, rank FROM {ranked('ks', 5, 'source_type, chunk_id')}")
def d1(spark, d):
    hits = lexical.keyword(index_of(spark, d), searches(spark, d))
    return hits.select("query_id", "chunk_id", "source_type", F.round("score", 6).alias("score"), "rank")


@query("c1_source_filter", f"WITH {BM25}, ok AS (SELECT query_id, unnest(expected_sources) AS source_type FROM se) SELECT query_id, chunk_id, source_type, round(score, 6) AS score, rank FROM {ranked('(SELECT bs.* FROM bs SEMI JOIN ok ON bs.query_id = ok.query_id AND bs.source_type = ok.source_type)', 5, 'source_type, chunk_id')}")
def c1(spark, d):
    allowed = searches(spark, d).select("query_id", F.explode("expected_sources").alias("source_type"))
    return bm25_hits(spark, d, sources=allowed).select("query_id", "chunk_id", "source_type", F.round("score", 6).alias("score"), "rank")


UNIT = f"{VEC}, un AS (SELECT embedding_version AS grp, chunk_id, source_type, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS unit FROM ve)"
DENSE = f"{UNIT}, dq AS (SELECT grp, chunk_id AS query_id, unit FROM un WHERE CAST(split_part(chunk_id, '-', 2) AS BIGINT) % 100 = 0), ds AS (SELECT query_id, v.chunk_id, v.source_type, list_inner_product(q.unit, v.unit) AS score FROM dq q JOIN un v ON q.grp = v.grp AND q.query_id <> v.chunk_id)".replace("WHERE CAST(split_part(chunk_id, '-', 2) AS BIGINT) % 100 = 0", "WHERE TRY_CAST(split_part(chunk_id, '-', 2) AS BIGINT) % 100 = 0")


def dense_hits(spark, d, k=5, positive_only=True):
    v = dense.usable(table(spark, d, "chunk_vectors"), 64).select(F.col("embedding_version").alias("grp"), "chunk_id", "source_type", "unit")
    q = v.where("try_cast(split_part(chunk_id, '-', 2) as bigint) % 100 = 0").select("grp", F.col("chunk_id").alias("query_id"), "unit")
    return dense.exact_top_k(q, v, k, positive_only)


@query("d7_dense_topk", f"WITH {DENSE} SELECT query_id, chunk_id, source_type, round(score, 6) AS score, rank FROM {ranked('ds', 5, 'source_type, chunk_id')}")
def d7(spark, d):
    return dense_hits(spark, d).select("query_id", "chunk_id", "source_type", F.round("score", 6).alias("score"), "rank")


@query("d20_exact_vector_store", f"WITH {DENSE} SELECT query_id, chunk_id, source_type, round(score, 6) AS score, rank FROM {ranked('ds', 10, 'source_type, chunk_id', 'true')}")
def d20(spark, d):
    return dense_hits(spark, d, 10, positive_only=False).select("query_id", "chunk_id", "source_type", F.round("score", 6).alias("score"), "rank")


FUSED = f"{BM25}, {KEYWORD}, la AS {ranked('bs', 20, 'source_type, chunk_id')}, lb AS {ranked('ks', 20, 'source_type, chunk_id')}, fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS rank_a, b.rank AS rank_b, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score FROM la a FULL JOIN lb b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)"


def fused_hits(spark, d, k=5, carried=()):
    a = bm25_hits(spark, d, 20)
    b = lexical.keyword(index_of(spark, d), searches(spark, d), 20)
    return ranking.reciprocal_rank_fusion(a, b, k, carried=carried)


@query("d8_rank_fusion", f"WITH {FUSED} SELECT query_id, chunk_id, rank_a, rank_b, round(score, 9) AS score, rank FROM {ranked('fu', 5, 'chunk_id')}")
def d8(spark, d):
    return fused_hits(spark, d).select("query_id", "chunk_id", "rank_a", "rank_b", F.round("score", 9).alias("score"), "rank")


@query("c11_full_outer_ranks", f"WITH {FUSED} SELECT query_id, count(*) AS n_hits, count(rank_a) AS n_a, count(rank_b) AS n_b, count(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1 END) AS n_both FROM fu GROUP BY query_id")
def c11(spark, d):
    rows = fused_hits(spark, d, 40).groupBy("query_id")
    return rows.agg(F.count("*").alias("n_hits"), F.count("rank_a").alias("n_a"), F.count("rank_b").alias("n_b"), F.count_if(F.expr("rank_a is not null and rank_b is not null")).alias("n_both"))


RERANKED = f"{BM25}, c10 AS {ranked('bs', 10, 'source_type, chunk_id')}, rr AS (SELECT c10.*, CASE WHEN len(q.tokens) = 0 THEN 0.0 ELSE len(list_intersect(q.tokens, list_distinct(t.tokens))) / len(q.tokens) END AS rerank_score FROM c10 JOIN (SELECT query_id, list_distinct({tokens_sql('query')}) AS tokens FROM se) q USING (query_id) JOIN tk t USING (chunk_id)), r2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank, chunk_id) AS INTEGER) AS rerank_rank FROM rr)"


def reranked_hits(spark, d, k=10):
    """The overlap by which hits are re-ranked comes with them, so no text is read again."""
    hits = lexical.bm25(index_of(spark, d), searches(spark, d), 10, shares=True)
    return ranking.rerank(hits, F.col("share"), k).drop("share")


@query("d9_rerank_topk", f"WITH {RERANKED} SELECT query_id, chunk_id, rank, round(rerank_score, 6) AS rerank_score, rerank_rank FROM r2 WHERE rerank_rank <= 5")
def d9(spark, d):
    return reranked_hits(spark, d, 5).select("query_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


@query("d16_conservative_fusion", f"WITH {RERANKED}, f AS (SELECT *, 2.0 / (60 + rank) + 1.0 / (60 + rerank_rank) AS fused_score FROM r2) SELECT query_id, chunk_id, rank, rerank_rank, round(fused_score, 9) AS fused_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 9) DESC, rank, chunk_id) AS INTEGER) AS fused_rank FROM f QUALIFY fused_rank <= 5")
def d16(spark, d):
    rows = ranking.conservative_fusion(reranked_hits(spark, d), 5)
    return rows.select("query_id", "chunk_id", "rank", "rerank_rank", F.round("fused_score", 9).alias("fused_score"), "fused_rank")


def any_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


FEATURES = f"""fe AS (SELECT case_id, lower(trim(query)) AS t, query, CAST(len(coalesce(expected_sources, [])) AS INTEGER) AS source_count FROM ca),
ff AS (SELECT case_id, CAST(length(t) AS INTEGER) AS char_count, source_count, {any_sql('t', adaptive.TECHNICAL_TERMS)} OR regexp_matches(query, '[A-Za-z][A-Za-z0-9_.+-]+') AS has_exact_term, {any_sql('t', adaptive.REWRITE_MARKERS)} AS has_semantic_rewrite, source_count >= 2 OR {any_sql('t', adaptive.MULTI_SOURCE_MARKERS)} AS is_multi_source, {any_sql('t', adaptive.CROSS_DOCUMENT_MARKERS)} OR (contains(t, '岗位') AND {any_sql('t', ('项目', '经历', '简历'))}) AS is_cross_document, source_count = 0 AS is_unanswerable_route FROM fe)"""


@query("d13_query_features", f"WITH {SEARCHES}, {FEATURES} SELECT * FROM ff")
def d13(spark, d):
    return adaptive.features(cases(spark, d), "case_id", "query", "expected_sources")


@query("d14_strategy", f"WITH {SEARCHES}, {FEATURES} SELECT case_id, CASE WHEN is_unanswerable_route THEN 'bm25' WHEN is_cross_document THEN 'graph_hybrid' WHEN is_multi_source THEN 'hybrid' WHEN has_semantic_rewrite AND NOT has_exact_term THEN 'dense' WHEN char_count <= 8 AND NOT has_exact_term THEN 'bm25' ELSE 'hybrid' END AS strategy FROM ff")
def d14(spark, d):
    return adaptive.strategies(adaptive.features(cases(spark, d), "case_id", "query", "expected_sources"), graph_enabled=True).select("case_id", "strategy")


CONFIDENCE = f"{FUSED}, f5 AS {ranked('fu', 5, 'chunk_id')}, hc AS (SELECT f5.*, ch.source_type FROM f5 JOIN ch USING (chunk_id)), cf AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2, list_distinct(list(source_type)) AS got, avg(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1.0 ELSE 0.0 END) AS agreement FROM hc GROUP BY query_id)"


@query("b24_retrieval_confidence", f"WITH {CONFIDENCE} SELECT query_id, round(0.25 * least(1.0, n / 5.0) + 0.20 * least(1.0, greatest(0.0, CASE WHEN s2 IS NULL THEN 1.0 ELSE (s1 - s2) / s1 END)) + 0.25 * CASE WHEN len(coalesce(expected_sources, [])) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(expected_sources), got)) / len(list_distinct(expected_sources)) END + 0.30 * agreement, 6) AS confidence FROM cf JOIN se USING (query_id)")
def b24(spark, d):
    hits = fused_hits(spark, d).join(chunks(spark, d).select("chunk_id", "source_type"), "chunk_id")
    return adaptive.confidence(hits, searches(spark, d).select("query_id", F.col("expected_sources").alias("sources")), 5)


@query("d15_adaptive_topk", f"WITH {CONFIDENCE}, {FEATURES}, ch2 AS (SELECT case_id AS query_id, CASE WHEN is_unanswerable_route THEN 'none' WHEN is_multi_source THEN 'hybrid' WHEN has_semantic_rewrite AND NOT has_exact_term THEN 'keyword' WHEN char_count <= 8 AND NOT has_exact_term THEN 'bm25' ELSE 'hybrid' END AS strategy FROM ff), al AS (SELECT 'bm25' AS strategy, query_id, chunk_id, rank FROM la WHERE rank <= 5 UNION ALL SELECT 'keyword', query_id, chunk_id, rank FROM lb WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM f5) SELECT query_id, strategy, chunk_id, rank FROM al JOIN ch2 USING (query_id, strategy)")
def d15(spark, d):
    q = searches(spark, d)
    chosen = adaptive.strategies(adaptive.features(q, "query_id", "query", "expected_sources"), graph_enabled=False)
    name = F.when(F.col("is_unanswerable_route"), "none").when(F.col("strategy") == "dense", "keyword").otherwise(F.col("strategy"))
    chosen = chosen.select("query_id", name.alias("strategy"))
    index = index_of(spark, d)
    # every branch sees only the queries that chose it
    own = lambda s: q.join(chosen.where(F.col("strategy") == s), "query_id", "left_semi")
    part = lambda s, hits: hits.select(F.lit(s).alias("strategy"), "query_id", "chunk_id", "rank")
    hybrid = ranking.reciprocal_rank_fusion(lexical.bm25(index, own("hybrid"), 20), lexical.keyword(index_of(spark, d), own("hybrid"), 20), 5)
    out = part("bm25", lexical.bm25(index, own("bm25"), 5)).union(part("keyword", lexical.keyword(index_of(spark, d), own("keyword"), 5))).union(part("hybrid", hybrid))
    return out.select("query_id", "strategy", "chunk_id", "rank")


@query("e2_keep_best", f"WITH {BM25}, k AS (SELECT b.*, md5(lower(regexp_replace(ch.text, '[^a-zA-Z0-9一-鿿]+', '', 'g'))) AS tk FROM {ranked('bs', 50, 'source_type, chunk_id')} b JOIN ch USING (chunk_id)) SELECT query_id, chunk_id, rank FROM k QUALIFY row_number() OVER (PARTITION BY query_id, tk ORDER BY rank, chunk_id) = 1")
def e2(spark, d):
    hits = bm25_hits(spark, d, 50).join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    key = F.md5(F.lower(F.regexp_replace("text", "[^a-zA-Z0-9\\x{4e00}-\\x{9fff}]+", "")))
    return ranking.keep_best(hits, key).select("query_id", "chunk_id", "rank")


@query("e12_score_margin", f"WITH {BM25}, k AS {ranked('bs', 2, 'source_type, chunk_id')} SELECT query_id, round(max(CASE WHEN rank = 1 THEN score END) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0), 6) AS margin FROM k GROUP BY query_id")
def e12(spark, d):
    rows = bm25_hits(spark, d, 2).withColumn("next", F.lead("score", 1, 0.0).over(Window.partitionBy("query_id").orderBy("rank")))
    return rows.where("rank = 1").select("query_id", F.round(F.col("score") - F.col("next"), 6).alias("margin"))
