"""Scalar text, hash and vector functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vectors as V
from lodestrand.plans.registry import CASES, CHUNKS, cases, chunks, query
from lodestrand.session import table

TOKENS = "list_concat(list_concat(regexp_extract_all(lower({t}), '[a-z0-9]+'), regexp_extract_all({t}, '[一-鿿]')), list_transform(list_zip(regexp_extract_all({t}, '[一-鿿]')[:-2], regexp_extract_all({t}, '[一-鿿]')[2:]), lambda p: p[1] || p[2]))"
WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
MATCH = "lower(regexp_replace({t}, '" + WS + "+', '', 'g'))"
SQUEEZED = "trim(regexp_replace({t}, '" + WS + "+', ' ', 'g'))"


def tokens_sql(t: str) -> str:
    return TOKENS.replace("{t}", t)


@query("b1_token_bags", f"WITH {CHUNKS}, t AS (SELECT chunk_id, unnest({tokens_sql('text')}) AS token FROM ch) SELECT chunk_id, token, count(*) AS tf FROM t GROUP BY chunk_id, token")
def b1(spark, d):
    rows = chunks(spark, d).select("chunk_id", F.explode(T.mixed_tokens("text")).alias("token"))
    return rows.groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))


@query("b2_token_sets", f"WITH {CHUNKS} SELECT chunk_id, CAST(len(list_distinct({tokens_sql('text')})) AS INTEGER) AS n_tokens FROM ch")
def b2(spark, d):
    return chunks(spark, d).select("chunk_id", F.size(T.token_set("text")).alias("n_tokens"))


QUALITY = "lower(regexp_replace(text, '" + WS + "+', '', 'g'))"
QUALITY_SQL = f"""{CHUNKS}, w AS (SELECT chunk_id, {QUALITY} AS t FROM ch),
q AS (SELECT chunk_id, substr(t, i, 3) AS token FROM (SELECT chunk_id, t, unnest(range(1, length(t) - 1)) AS i FROM w WHERE length(t) >= 3) WHERE regexp_full_match(substr(t, i, 3), '[一-鿿]{{3}}')
UNION SELECT chunk_id, unnest(regexp_extract_all(t, '[a-z][a-z0-9_+#.-]+')) FROM w)"""


@query("b3_quality_tokens", f"WITH {QUALITY_SQL} SELECT chunk_id, token FROM q")
def b3(spark, d):
    return chunks(spark, d).select("chunk_id", F.explode(T.quality_tokens("text")).alias("token"))


@query("b7_corpus_text", f"WITH {CHUNKS} SELECT chunk_id, sha256(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {SQUEEZED.replace('{t}', 'x')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS text_hash FROM ch")
def b7(spark, d):
    return chunks(spark, d).select("chunk_id", F.sha2(T.corpus_text("text"), 256).alias("text_hash"))


@query("b8_content_ids", f"WITH {CHUNKS} SELECT chunk_id, sha256(text) AS content_hash, 'doc-' || substr(sha256('v1|' || source_type || '|table|' || source_path), 1, 16) AS document_id, source_type || '-' || substr(sha1(source_type || ':' || source_path || ':' || text), 1, 12) AS made_id FROM ch")
def b8(spark, d):
    key = F.concat(F.lit("v1|"), "source_type", F.lit("|table|"), "source_path")
    made = F.concat("source_type", F.lit("-"), T.short_id(F.col("source_type"), F.lit(":"), F.col("source_path"), F.lit(":"), F.col("text")))
    return chunks(spark, d).select("chunk_id", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("doc-"), F.substring(F.sha2(key, 256), 1, 16)).alias("document_id"), made.alias("made_id"))


@query("b9_record_normalise", "SELECT job_id, version, any_value(CASE WHEN coalesce(source_url, '') = '' THEN NULL ELSE regexp_extract(source_url, '^[a-z]+://([^/?#]*)', 1) END) AS source_domain, min(lower(trim(status))) AS status, min(coalesce(city, 'unknown')) AS city FROM job_postings GROUP BY job_id, version")
def b9(spark, d):
    domain = F.when(F.coalesce("source_url", F.lit("")) == "", None).otherwise(F.regexp_extract("source_url", "^[a-z]+://([^/?#]*)", 1))
    rows = table(spark, d, "job_postings").groupBy("job_id", "version")
    return rows.agg(F.min(domain).alias("source_domain"), F.min(F.lower(F.trim("status"))).alias("status"), F.min(F.coalesce("city", F.lit("unknown"))).alias("city"))


@query("b17_token_estimate", f"WITH {CASES} SELECT case_id, CAST(len(regexp_extract_all(query, '[一-鿿]|[A-Za-z]+|\\p{{Nd}}+|[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')) AS INTEGER) AS n_tokens FROM ca")
def b17(spark, d):
    return cases(spark, d).select("case_id", T.token_estimate("query").alias("n_tokens"))


@query("b18_snippets", f"WITH {CHUNKS}, s AS (SELECT chunk_id, {SQUEEZED.replace('{t}', 'text')} AS t FROM ch) SELECT chunk_id, substr(t, 1, 220) || CASE WHEN length(t) > 220 THEN '...' ELSE '' END AS snippet FROM s")
def b18(spark, d):
    return chunks(spark, d).select("chunk_id", T.snippet("text").alias("snippet"))


@query("b19_context_items", f"WITH {CHUNKS} SELECT chunk_id, 'chunk_id: ' || chunk_id || chr(10) || 'source_type: ' || source_type || chr(10) || 'source_path: ' || source_path || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'text:' || chr(10) || text AS item FROM ch")
def b19(spark, d):
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("")))
    item = F.concat_ws("\n", line("chunk_id", "chunk_id"), line("source_type", "source_type"), line("source_path", "source_path"), line("title", "title"), F.concat(F.lit("text:\n"), "text"))
    return chunks(spark, d).select("chunk_id", item.alias("item"))


@query("b20_match_text", f"WITH {CASES} SELECT case_id, {MATCH.replace('{t}', 'query')} AS match_text FROM ca")
def b20(spark, d):
    return cases(spark, d).select("case_id", T.match_text("query").alias("match_text"))


@query("b21_bigram_jaccard", f"""WITH {CASES}, p AS (SELECT a.case_id AS case_a, b.case_id AS case_b, {MATCH.replace('{t}', 'a.query')} AS x, {MATCH.replace('{t}', 'b.query')} AS y FROM ca a JOIN ca b ON a.category = b.category AND a.expected_intent = b.expected_intent AND a.relevant_chunk_ids = b.relevant_chunk_ids AND len(a.relevant_chunk_ids) > 0 AND a.case_id < b.case_id),
g AS (SELECT case_a, case_b, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS gx, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS gy FROM p)
SELECT case_a, case_b, round(len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))), 6) AS jaccard FROM g""")
def b21(spark, d):
    c = cases(spark, d).where("size(relevant_chunk_ids) > 0").select("case_id", "category", "expected_intent", "relevant_chunk_ids", T.char_bigrams("query").alias("g"))
    a, b = c.withColumnsRenamed({"case_id": "case_a", "g": "gx"}), c.withColumnsRenamed({"case_id": "case_b", "g": "gy"})
    rows = a.join(b, ["category", "expected_intent", "relevant_chunk_ids"]).where("case_a < case_b")
    return rows.select("case_a", "case_b", F.round(T.jaccard(F.col("gx"), F.col("gy")), 6).alias("jaccard"))


@query("b11_query_overlap", f"""WITH {CASES}, {CHUNKS}, p AS (SELECT case_id, query, unnest(relevant_chunk_ids) AS chunk_id FROM ca),
t AS (SELECT case_id, p.chunk_id, list_distinct({tokens_sql('query')}) AS q, list_distinct({tokens_sql('text')}) AS c FROM p JOIN ch USING (chunk_id))
SELECT case_id, chunk_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, c)) / len(q) END, 6) AS overlap FROM t""")
def b11(spark, d):
    pairs = cases(spark, d).select("case_id", "query", F.explode("relevant_chunk_ids").alias("chunk_id"))
    rows = pairs.join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return rows.select("case_id", "chunk_id", F.round(T.overlap(T.token_set("query"), T.token_set("text")), 6).alias("overlap"))


VEC = "ve AS (SELECT embedding_version, chunk_id, min(embedding) AS embedding, min(source_type) AS source_type FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY embedding_version, chunk_id")


def vectors(spark, d):
    rows = table(spark, d, "chunk_vectors").where((F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("embedding_version", "chunk_id").agg(F.min("embedding").alias("embedding"), F.min("source_type").alias("source_type"))


@query("b13_unit_vectors", f"WITH {VEC}, n AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM ve) SELECT embedding_version, chunk_id, round(norm, 5) AS norm, round(embedding[1] / norm, 6) AS first, round(embedding[64] / norm, 6) AS last FROM n")
def b13(spark, d):
    rows = vectors(spark, d).withColumn("u", V.unit(F.col("embedding")))
    return rows.select("embedding_version", "chunk_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("b15_cosine", f"WITH {VEC}, {CASES}, p AS (SELECT DISTINCT unnest(relevant_chunk_ids[1:1]) AS a, unnest(relevant_chunk_ids[2:2]) AS b FROM ca WHERE len(relevant_chunk_ids) >= 2) SELECT p.a, p.b, x.embedding_version, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine, round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 4) AS dot FROM p JOIN ve x ON x.chunk_id = p.a JOIN ve y ON y.chunk_id = p.b AND x.embedding_version = y.embedding_version")
def b15(spark, d):
    pairs = cases(spark, d).where("size(relevant_chunk_ids) >= 2").select(F.col("relevant_chunk_ids")[0].alias("a"), F.col("relevant_chunk_ids")[1].alias("b")).distinct()
    v = vectors(spark, d).select("embedding_version", "chunk_id", "embedding")
    rows = pairs.join(v.toDF("embedding_version", "a", "x"), "a").join(v.toDF("embedding_version", "b", "y"), ["b", "embedding_version"])
    return rows.select("a", "b", "embedding_version", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine"), F.round(V.dot(F.col("x"), F.col("y")), 4).alias("dot"))
