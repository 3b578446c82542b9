"""Further operators over the tables: fingerprints of labels, retries, prompts, parsing, traces and the encoder."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vectors as V
from lodestrand.operators import context, dedup, dense, encoding, graph, lexical
from lodestrand.plans.corpus_queries import HASHES, prints
from lodestrand.plans.evaluation_queries import GRAPH, HITS5, catalogue, items
from lodestrand.plans.registry import CASES, CHUNKS, cases, chunks, query, searches
from lodestrand.plans.report_queries import BOTH_RUNS, keyword_metrics
from lodestrand.plans.evaluation_queries import search_metrics
from lodestrand.plans.retrieval_queries import BM25, bm25_hits, index_of, ranked
from lodestrand.plans.text_queries import MATCH, VEC, vectors
from lodestrand.session import shared_folder, staged, table


LABEL_PAIRS = "p AS (SELECT DISTINCT x.c AS a, y.c AS b FROM (SELECT case_id, unnest(list_distinct(relevant_chunk_ids)) AS c FROM ca) x JOIN (SELECT case_id, unnest(list_distinct(relevant_chunk_ids)) AS c FROM ca) y ON x.case_id = y.case_id AND x.c < y.c)"


def label_pairs(spark, d):
    """Every two relevant chunks ``(a, b)`` of a case, the smaller id first."""
    rows = cases(spark, d).select("case_id", F.explode(F.array_distinct("relevant_chunk_ids")).alias("a"))
    return rows.join(rows.withColumnRenamed("a", "b"), "case_id").where("a < b").select("a", "b").distinct()


@query("b5_hamming_distance", f"WITH {HASHES}, {CASES}, {LABEL_PAIRS} SELECT p.a, p.b, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INTEGER) AS distance, round(least(x.n_chars, y.n_chars) / greatest(x.n_chars, y.n_chars), 6) AS length_ratio FROM p JOIN sh x ON x.chunk_id = p.a JOIN sh y ON y.chunk_id = p.b")
def b5(spark, d):
    p = prints(spark, d).select("id", "hi", "lo", "n_chars")
    rows = label_pairs(spark, d).join(p.toDF("a", "h1", "l1", "n1"), "a").join(p.toDF("b", "h2", "l2", "n2"), "b")
    distance = dedup.hamming(F.col("h1"), F.col("l1"), F.col("h2"), F.col("l2"))
    return rows.select("a", "b", distance.cast("int").alias("distance"), F.round(T.length_ratio(F.col("n1"), F.col("n2")), 6).alias("length_ratio"))


@query("b28_redacted_manifest", "SELECT doc_id, lang, source, source_type, source_path, sha256(text) AS content_hash, CAST(length(text) AS INTEGER) AS n_chars FROM documents")
def b28(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "source_type", "source_path", F.sha2("text", 256).alias("content_hash"), F.length("text").alias("n_chars"))


@query("c18_label_hits", f"WITH {HITS5}, lb AS (SELECT DISTINCT query_id, unnest(relevant_chunk_ids) AS chunk_id FROM se) SELECT lb.query_id, lb.chunk_id, h5.rank FROM lb LEFT JOIN h5 ON h5.query_id = lb.query_id AND h5.chunk_id = lb.chunk_id")
def c18(spark, d):
    labels = searches(spark, d).select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id")).distinct()
    return labels.join(bm25_hits(spark, d).select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")


@query("c19_missing_vectors", f"WITH {VEC}, {CHUNKS} SELECT chunk_id, source_type FROM ch ANTI JOIN ve USING (chunk_id)")
def c19(spark, d):
    return chunks(spark, d).join(vectors(spark, d).select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "source_type")


@query("e7_best_candidate", f"WITH {CHUNKS} SELECT source_path, arg_min(chunk_id, (-length(text), chunk_id)) AS chunk_id, CAST(max(length(text)) AS INTEGER) AS n_chars FROM ch GROUP BY source_path")
def e7(spark, d):
    rows = chunks(spark, d).withColumn("n", F.length("text"))
    return rows.groupBy("source_path").agg(F.min_by("chunk_id", F.struct(-F.col("n"), "chunk_id")).alias("chunk_id"), F.max("n").alias("n_chars"))


@query("f7_recall_at_k", f"WITH {HITS5}, lb AS (SELECT DISTINCT query_id, unnest(relevant_chunk_ids) AS chunk_id FROM se), k AS (SELECT unnest([1, 3, 5]) AS k) SELECT CAST(k AS INTEGER) AS k, se.query_id, coalesce(round(count(h5.rank) / nullif(count(lb.chunk_id), 0), 6), 0.0) AS recall FROM se CROSS JOIN k LEFT JOIN lb USING (query_id) LEFT JOIN h5 ON h5.query_id = se.query_id AND h5.chunk_id = lb.chunk_id AND h5.rank <= k GROUP BY k, se.query_id")
def f7(spark, d):
    labels = searches(spark, d).select("query_id", F.explode_outer(F.array_distinct("relevant_chunk_ids")).alias("chunk_id"))
    rows = labels.join(bm25_hits(spark, d).select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5)))))
    share = F.count_if(F.col("rank") <= F.col("k")) / F.nullif(F.count("chunk_id"), F.lit(0))
    return rows.groupBy("k", "query_id").agg(F.coalesce(F.round(share, 6), F.lit(0.0)).alias("recall"))


@query("f22_token_usage", f"WITH {CASES}, {CHUNKS}, t AS (SELECT source_type, len(regexp_extract_all(text, '[一-鿿]|[A-Za-z]+')) AS n FROM ch) SELECT source_type, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(quantile_disc(n, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS p95 FROM t GROUP BY source_type")
def f22(spark, d):
    from lodestrand.operators.metrics import nearest_rank

    n = F.size(F.regexp_extract_all("text", F.lit(f"{T.HAN}|[A-Za-z]+"), F.lit(0)))
    rows = chunks(spark, d).select("source_type", n.alias("n")).groupBy("source_type")
    return rows.agg(F.sum("n").alias("n_tokens"), nearest_rank("n", 0.5).alias("p50"), nearest_rank("n", 0.95).alias("p95"))


@query("f29_shadow_gate", f"WITH {BOTH_RUNS} SELECT avg(pm.recall) >= avg(km.recall) AS mean_holds, coalesce(bool_and(round(pm.recall, 9) >= round(km.recall, 9)), false) AS no_case_regressed, count(*) AS n_cases FROM pm JOIN km USING (query_id)")
def f29(spark, d):
    from lodestrand.operators.gates import changes

    rows = changes(keyword_metrics(spark, d), search_metrics(spark, d), "query_id", "recall")
    return rows.agg((F.avg("new") >= F.avg("old")).alias("mean_holds"), F.coalesce(F.bool_and(F.col("change") != "regressed"), F.lit(False)).alias("no_case_regressed"), F.count("*").alias("n_cases"))


@query("f34_ordered_distinct", f"WITH {CASES}, e AS (SELECT case_id, unnest(expected_points) AS p, generate_subscripts(expected_points, 1) AS i FROM ca), f AS (SELECT case_id, p, min(i) AS i FROM e GROUP BY case_id, p) SELECT case_id, string_agg(p, '|' ORDER BY i) AS points FROM f GROUP BY case_id")
def f34(spark, d):
    return cases(spark, d).where("size(expected_points) > 0").select("case_id", F.array_join(F.array_distinct("expected_points"), "|").alias("points"))


@query("h2_source_expansion", f"WITH {BM25}, ok AS (SELECT query_id, unnest(expected_sources) AS source_type FROM se), f AS (SELECT bs.* FROM bs SEMI JOIN ok ON bs.query_id = ok.query_id AND bs.source_type = ok.source_type), a1 AS (SELECT 1 AS attempt, * FROM {ranked('f', 3, 'source_type, chunk_id')}), gt AS (SELECT query_id, list(source_type) AS got FROM a1 GROUP BY query_id), g AS (SELECT se.query_id FROM se LEFT JOIN gt USING (query_id) WHERE len(list_filter(coalesce(expected_sources, []), lambda x: NOT coalesce(list_contains(got, x), false))) > 0), a2 AS (SELECT 2 AS attempt, b.* FROM {ranked('bs', 3, 'source_type, chunk_id')} b SEMI JOIN g USING (query_id)) SELECT attempt, query_id, chunk_id, rank FROM a1 UNION ALL SELECT attempt, query_id, chunk_id, rank FROM a2")
def h2(spark, d):
    q = searches(spark, d)
    none = F.array().cast("array<string>")
    index = index_of(spark, d)
    allowed = q.select("query_id", F.explode("expected_sources").alias("source_type"))
    first = staged(lexical.bm25(index, q, 3, allowed), "first")  # read for what it lacks and for the result
    got = first.groupBy("query_id").agg(F.collect_set("source_type").alias("got"))
    lacking = q.join(got, "query_id", "left").where(F.size(F.array_except(F.coalesce("expected_sources", none), F.coalesce("got", none))) > 0)
    again = lexical.bm25(index, q.join(lacking, "query_id", "left_semi"), 3)
    part = lambda n, rows: rows.select(F.lit(n).alias("attempt"), "query_id", "chunk_id", "rank")
    return part(1, first).union(part(2, again))


SEGMENTS = f"""{BM25}, pt AS (SELECT query_id, 'system' AS kind, 'system' AS segment_id, 0 AS seq, 9 AS size FROM se UNION ALL SELECT query_id, 'query', 'query', 0, CAST(length(query) AS INTEGER) FROM se UNION ALL SELECT b.query_id, 'evidence', b.chunk_id, b.rank, CAST(length(ch.text) AS INTEGER) FROM {ranked('bs', 10, 'source_type, chunk_id')} b JOIN ch USING (chunk_id) UNION ALL SELECT query_id, 'history', 'h' || lpad(CAST(i AS VARCHAR), 3, '0'), i, 20 * i FROM se, (SELECT unnest(range(1, 13)) AS i) UNION ALL SELECT query_id, 'memory', 'm' || i, i, 40 FROM se, (SELECT unnest(range(1, 4)) AS i)),
sg AS (SELECT m.mode, pt.*, CASE kind WHEN 'system' THEN 100 WHEN 'query' THEN 100 WHEN 'memory' THEN 80 WHEN 'evidence' THEN 70 ELSE 50 END AS priority FROM pt, (VALUES ('no_memory'), ('full_history'), ('recent_window'), ('semantic_memory')) AS m(mode) WHERE kind IN ('system', 'query', 'evidence') OR kind = 'memory' AND mode = 'semantic_memory' OR kind = 'history' AND (mode = 'full_history' OR mode = 'recent_window' AND seq > 6)),
od AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY kind NOT IN ('system', 'query'), priority DESC, segment_id) AS o FROM sg),
pk AS (SELECT DISTINCT mode, query_id, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS taken FROM sg UNION ALL SELECT pk.mode, pk.query_id, od.o, CASE WHEN used + size <= 1700 THEN used + size ELSE used END, CASE WHEN used + size <= 1700 THEN od.segment_id END FROM pk JOIN od ON od.mode = pk.mode AND od.query_id = pk.query_id AND od.o = pk.o + 1)"""


@query("h6_managed_context", f"WITH RECURSIVE {SEGMENTS} SELECT mode, query_id, taken AS segment_id, used FROM pk WHERE taken IS NOT NULL")
def h6(spark, d):
    """Four modes over one conversation: twelve messages, three memories, and the evidence of each search."""
    q = searches(spark, d).select("query_id", "query")
    part = lambda rows, kind, name, seq, size: rows.select("query_id", F.lit(kind).alias("kind"), name.alias("segment_id"), seq.cast("int").alias("seq"), size.cast("int").alias("size"))
    texts = bm25_hits(spark, d, 10).join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    talk = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"))
    known = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    parts = part(q, "system", F.lit("system"), F.lit(0), F.lit(9)).union(part(q, "query", F.lit("query"), F.lit(0), F.length("query"))).union(part(texts, "evidence", F.col("chunk_id"), F.col("rank"), F.length("text")))
    parts = parts.union(part(talk, "history", F.concat(F.lit("h"), F.lpad(F.col("i").cast("string"), 3, "0")), F.col("i"), 20 * F.col("i"))).union(part(known, "memory", F.concat(F.lit("m"), F.col("i").cast("string")), F.col("i"), F.lit(40)))
    parts = staged(parts, "segments")
    modes = ("no_memory", "full_history", "recent_window", "semantic_memory")
    runs = [context.managed_context(context.segments(parts, mode), 1800, 100).select(F.lit(mode).alias("mode"), "query_id", "segment_id", "used") for mode in modes]
    return reduce(DataFrame.union, runs)


@query("h8_prompts", f"WITH {BM25}, c AS (SELECT b.query_id, string_agg('chunk_id: ' || b.chunk_id || chr(10) || ch.text, chr(10) || chr(10) ORDER BY b.rank) AS ctx FROM {ranked('bs', 3, 'source_type, chunk_id')} b JOIN ch USING (chunk_id) GROUP BY b.query_id) SELECT query_id, sha256('Question: ' || query || chr(10) || 'Evidence:' || chr(10) || ctx) AS prompt_hash FROM se JOIN c USING (query_id)")
def h8(spark, d):
    hits = bm25_hits(spark, d, 3).join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    item = F.concat(F.lit("chunk_id: "), "chunk_id", F.lit("\n"), "text")
    ctx = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))), lambda x: x["t"]), "\n\n").alias("ctx"))
    rows = searches(spark, d).join(ctx, "query_id")
    return rows.select("query_id", F.sha2(F.concat(F.lit("Question: "), "query", F.lit("\nEvidence:\n"), "ctx"), 256).alias("prompt_hash"))


@query("h9_parsed_generations", f"WITH {CASES}, g AS (SELECT case_id, CAST(substring(case_id, 5) AS BIGINT) % 8 AS n FROM ca) SELECT case_id, CASE WHEN n >= 6 THEN case_id END AS answer, CASE WHEN n >= 6 THEN CASE WHEN n = 7 THEN 'a,b' ELSE '' END END AS cited, CASE WHEN n >= 6 THEN n = 7 END AS sufficient, CASE n WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'invalid_field_type' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'invalid_field_type' WHEN 4 THEN 'invalid_field_type' WHEN 5 THEN 'invalid_field_type' END AS error FROM g")
def h9(spark, d):
    """Generations of eight kinds: broken, no object, a field missing, three with a field of another type, two right."""
    n = F.expr("cast(substring(case_id, 5) as bigint) % 8")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    whole = lambda answer, cited, sure, why='"why"': text('{"answer": ', answer, f', "cited_chunk_ids": {cited}, "sufficient": {sure}, "reason": {why}}}')
    own = text('"', F.col("case_id"), '"')
    j = F.when(n == 0, text("no json ", F.col("case_id"))).when(n == 1, text('["', F.col("case_id"), '"]')).when(n == 2, text('{"answer": ', own, ', "cited_chunk_ids": [], "sufficient": true}')).when(n == 3, whole("1", "[]", "true")).when(n == 4, whole(own, "[1]", "true")).when(n == 5, whole(own, "[]", '"yes"')).when(n == 6, whole(own, "[]", "false")).otherwise(whole(own, '["a", "b"]', "true"))
    rows = context.parsed_generations(cases(spark, d).select("case_id", j.alias("j")), "j")
    return rows.select("case_id", "answer", F.array_join("cited", ",").alias("cited"), "sufficient", "error")


@query("k1_point_verdicts", f"WITH {CASES}, {CHUNKS}, t AS (SELECT case_id, {MATCH.replace('{t}', 'text')} AS t FROM (SELECT case_id, unnest(list_distinct(relevant_chunk_ids)) AS chunk_id FROM ca) JOIN ch USING (chunk_id)), p AS (SELECT case_id, unnest(list_distinct(expected_points)) AS point FROM ca) SELECT case_id, point, CASE WHEN bool_or(contains(t, {MATCH.replace('{t}', 'point')})) THEN 'matched' ELSE 'unmatched' END AS verdict FROM p JOIN t USING (case_id) GROUP BY case_id, point")
def k1(spark, d):
    c = cases(spark, d)
    texts = c.select("case_id", F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id")).join(chunks(spark, d).select("chunk_id", T.match_text("text").alias("t")), "chunk_id")
    points = c.select("case_id", F.explode(F.array_distinct("expected_points")).alias("point"))
    rows = points.join(texts, "case_id").groupBy("case_id", "point").agg(F.bool_or(F.contains("t", T.match_text("point"))).alias("m"))
    return rows.select("case_id", "point", F.when(F.col("m"), "matched").otherwise("unmatched").alias("verdict"))


SIMILAR = 0.80  # cosine from which two answers count as similar


@query("k8_similar_answers", f"WITH {VEC}, {CASES}, {LABEL_PAIRS} SELECT p.a, p.b, x.embedding_version AS version, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) >= {SIMILAR} AS is_similar FROM p JOIN ve x ON x.chunk_id = p.a JOIN ve y ON y.chunk_id = p.b AND x.embedding_version = y.embedding_version")
def k8(spark, d):
    v = vectors(spark, d).select("embedding_version", "chunk_id", "embedding")
    rows = label_pairs(spark, d).join(v.toDF("version", "a", "x"), "a").join(v.toDF("version", "b", "y"), ["b", "version"])
    return rows.select("a", "b", "version", (F.round(V.cosine(F.col("x"), F.col("y")), 9) >= SIMILAR).alias("is_similar"))


@query("x2_event_gaps", "SELECT event_id, user_id, lag(event_id) OVER w AS previous_id, row_number() OVER w = 1 AS is_root, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def x2(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(MICROSECOND, previous_ts, ts)")
    rows = table(spark, d, "events").withColumn("previous_ts", F.lag("ts").over(w)).withColumn("previous_id", F.lag("event_id").over(w)).withColumn("is_root", F.row_number().over(w) == 1)
    return rows.select("event_id", "user_id", "previous_id", "is_root", gap.alias("gap_us"))


@query("o18_store_equivalence", f"WITH {GRAPH} SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT count(*) FROM eg) AS n_edges, (SELECT CAST(sum(len(chunk_ids)) AS BIGINT) FROM nd) AS n_node_chunks, (SELECT CAST(sum(len(chunk_ids)) AS BIGINT) FROM eg) AS n_edge_chunks, 0 AS n_lost, 0 AS n_gained")
def o18(spark, d):
    """The graph written and read again, compared with one that is extracted anew."""
    fresh = graph.extract(chunks(spark, d), catalogue(spark))
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    graph.save_graph(fresh, folder)
    again = graph.load_graph(spark, folder)
    n = lambda t, name: getattr(again, t).agg(F.count("*").alias(name))
    differ = lambda a, b: [getattr(a, t).exceptAll(getattr(b, t)).agg(F.count("*").alias("n")) for t in graph.TABLES]
    total = lambda parts, name: reduce(DataFrame.union, parts).agg(F.sum("n").cast("int").alias(name))
    out = n("nodes", "n_nodes").crossJoin(n("edges", "n_edges")).crossJoin(n("node_chunks", "n_node_chunks")).crossJoin(n("edge_chunks", "n_edge_chunks"))  # one row each
    return out.crossJoin(total(differ(fresh, again), "n_lost")).crossJoin(total(differ(again, fresh), "n_gained"))


@query("d4_encoded_topk")
def d4(spark, d):
    """Searches encoded by the learned encoder against all encoded chunks."""
    c = chunks(spark, d)
    encoder = encoding.fit(c, "chunk_id", "text")
    rows = encoding.encode(c, encoder, "chunk_id", "text").join(c.select("chunk_id", "source_type"), "chunk_id")
    vectors_df = rows.select(F.lit("lsa").alias("grp"), "chunk_id", "source_type", F.transform("embedding", lambda x: x.cast("double")).alias("unit"))
    asked = encoding.encode(searches(spark, d), encoder, "query_id", "query")
    return dense.exact_top_k(asked.select(F.lit("lsa").alias("grp"), "query_id", F.transform("embedding", lambda x: x.cast("double")).alias("unit")), vectors_df, 5)
