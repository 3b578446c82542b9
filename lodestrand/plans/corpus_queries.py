"""Corpus preparation: ingestion projections, duplicates, statistics, chunking and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import corpus as C
from lodestrand.functions import text as T
from lodestrand.operators import chunking, dedup, metrics
from lodestrand.plans.registry import CASES, CHUNKS, cases, chunks, query
from lodestrand.plans.text_queries import QUALITY_SQL, SQUEEZED
from lodestrand.session import table

@query("a3_source_type", "SELECT doc_id, CASE WHEN split_part(source_path, '/', 1) IN ('jd', 'project_logs', 'interview', 'resume', 'user_profile') THEN split_part(source_path, '/', 1) END AS source_type FROM documents")
def a3(spark, d):
    return table(spark, d, "documents").select("doc_id", C.source_type(F.col("source_path")).alias("source_type"))


@query("a4_front_matter", """WITH j AS (SELECT job_id, version, min('---' || chr(10) || 'company: ' || company || chr(10) || 'title : ' || job_title || chr(10) || 'no value here' || chr(10) || '---' || chr(10) || description) AS t FROM job_postings WHERE description IS NOT NULL GROUP BY job_id, version),
l AS (SELECT job_id, version, unnest(string_split(regexp_extract(t, '^---\\n((?s).*?)\\n---\\n', 1), chr(10))) AS line FROM j)
SELECT job_id, version, trim(split_part(line, ':', 1)) AS key, trim(substr(line, strpos(line, ':') + 1)) AS value FROM l WHERE contains(line, ':')""")
def a4(spark, d):
    t = F.concat(F.lit("---\ncompany: "), "company", F.lit("\ntitle : "), "job_title", F.lit("\nno value here\n---\n"), "description")
    rows = table(spark, d, "job_postings").where("description is not null").groupBy("job_id", "version").agg(F.min(t).alias("t"))
    return rows.select("job_id", "version", F.inline(C.front_matter(F.col("t"))))


@query("a5_metadata", "SELECT doc_id, coalesce(title, 'untitled') AS title, CASE WHEN lower(trim(review_status)) IN ('reviewed', 'pending', 'rejected') THEN lower(trim(review_status)) ELSE 'unreviewed' END AS review_status, coalesce(license_status, 'unknown') AS license_status, coalesce(lower(trim(CAST(anonymized AS VARCHAR))) IN ('1', 'true', 'yes'), false) AS anonymized FROM documents")
def a5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("title", F.lit("untitled")).alias("title"), C.review_state(F.col("review_status")).alias("review_status"), F.coalesce("license_status", F.lit("unknown")).alias("license_status"), C.is_yes(F.col("anonymized")).alias("anonymized"))


JOB_DOC = "'# ' || company || ' - ' || job_title || chr(10) || chr(10) || '## Description' || chr(10) || coalesce(description, '') || chr(10) || chr(10) || '## Requirements' || chr(10) || coalesce(requirements, '')"


@query("a9_job_documents", f"SELECT job_id, version, company || ' - ' || job_title AS title, sha256({JOB_DOC}) AS text_hash, CAST(length({JOB_DOC}) AS INTEGER) AS n_chars FROM job_postings")
def a9(spark, d):
    text = C.job_document(F.col("company"), F.col("job_title"), F.col("description"), F.col("requirements"))
    return table(spark, d, "job_postings").select("job_id", "version", C.job_title(F.col("company"), F.col("job_title")).alias("title"), F.sha2(text, 256).alias("text_hash"), F.length(text).alias("n_chars"))


@query("a11_segment_extract", "WITH s AS (SELECT doc_id, text, strpos(text, '## ') AS b FROM documents WHERE strpos(text, '## ') > 0), e AS (SELECT doc_id, substr(text, b + 3) AS rest FROM s) SELECT doc_id, rtrim(CASE WHEN strpos(rest, chr(10)) > 0 THEN substr(rest, 1, strpos(rest, chr(10)) - 1) ELSE rest END, ' ') AS segment FROM e")
def a11(spark, d):
    return table(spark, d, "documents").select("doc_id", C.segment(F.col("text"), "## ", "\n").alias("segment")).where("segment is not null")


@query("a14_tagged_rows", "WITH t AS (SELECT job_id, version, '<title>' || job_title || '</title><text>' || coalesce(description, '') || '</text>' AS t FROM job_postings) SELECT job_id, version, regexp_extract(t, '<title>((?s).*?)</title>', 1) AS title, CAST(length(regexp_extract(t, '<text>((?s).*?)</text>', 1)) AS INTEGER) AS n_chars FROM t WHERE length(regexp_extract(t, '<text>((?s).*?)</text>', 1)) >= 60")
def a14(spark, d):
    t = F.concat(F.lit("<title>"), "job_title", F.lit("</title><text>"), F.coalesce("description", F.lit("")), F.lit("</text>"))
    rows = table(spark, d, "job_postings").select("job_id", "version", t.alias("t"))
    return rows.select("job_id", "version", C.tagged(F.col("t"), "title").alias("title"), F.length(C.tagged(F.col("t"), "text")).alias("n_chars")).where("n_chars >= 60")


@query("a16_markdown_sections", "WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '(^|\\n)(##{1,2}\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS section FROM documents) SELECT doc_id, sha256(trim(section, ' ' || chr(10) || chr(13))) AS section_hash FROM s WHERE length(trim(section, ' ' || chr(10) || chr(13))) >= 80")
def a16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(C.sections(F.col("text"), 80)).alias("section")).select("doc_id", F.sha2("section", 256).alias("section_hash"))


@query("a17_markdown_title", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?:^|\\n)#{1,2}[ \\t]+([^\\n\\r]+)', 1), ''), list_extract(string_split(source_path, '/'), -1)) AS title FROM documents")
def a17(spark, d):
    return table(spark, d, "documents").select("doc_id", C.markdown_title(F.col("text"), F.col("source_path")).alias("title"))


@query("a18_markdown_noise", "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '<img[^>]*>', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text_hash FROM documents")
def a18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(C.without_images(F.col("text")), 256).alias("text_hash"))


@query("a32_last_writer_wins", "SELECT job_id, version, city, status, epoch_us(last_seen_at) AS last_seen_us FROM job_postings QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY version DESC, last_seen_at DESC, status, city NULLS FIRST) = 1")
def a32(spark, d):
    order = Window.partitionBy("job_id").orderBy(F.desc("version"), F.desc("last_seen_at"), "status", F.asc_nulls_first("city"))
    rows = table(spark, d, "job_postings").withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.select("job_id", "version", "city", "status", F.unix_micros("last_seen_at").alias("last_seen_us"))


HASHES = f"""{QUALITY_SQL}, dg AS (SELECT chunk_id, sha256(token) AS h FROM q),
bt AS (SELECT chunk_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS lo FROM dg),
cn AS (SELECT chunk_id, count(*) AS n, {", ".join(f"sum((hi >> {b}) & 1) AS h{b}, sum((lo >> {b}) & 1) AS l{b}" for b in range(32))} FROM bt GROUP BY chunk_id),
sh AS (SELECT ch.chunk_id, source_type, length(text) AS n_chars, coalesce(CAST({" + ".join(f"(CASE WHEN 2 * h{b} >= n THEN {1 << b} ELSE 0 END)" for b in range(32))} AS BIGINT), 0) AS hi, coalesce(CAST({" + ".join(f"(CASE WHEN 2 * l{b} >= n THEN {1 << b} ELSE 0 END)" for b in range(32))} AS BIGINT), 0) AS lo FROM ch LEFT JOIN cn USING (chunk_id))"""
NEAR = f"{HASHES}, np AS (SELECT a.chunk_id AS a, b.chunk_id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM sh a JOIN sh b ON a.source_type = b.source_type AND a.chunk_id < b.chunk_id AND least(a.n_chars, b.n_chars) / greatest(a.n_chars, b.n_chars) >= 0.85 AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3)"


def prints(spark, d):
    c = chunks(spark, d)
    return dedup.simhash(c, "chunk_id", "text").join(c.select("chunk_id", F.col("source_type").alias("grp"), F.length("text").alias("n_chars")), "chunk_id").withColumnRenamed("chunk_id", "id")


CLASSES = "cs AS (SELECT source_type, n_chars, hi, lo, min(chunk_id) AS chunk_id FROM sh GROUP BY source_type, n_chars, hi, lo)"


@query("b4_simhash", f"WITH {HASHES} SELECT chunk_id, hi, lo FROM sh")
def b4(spark, d):
    return dedup.simhash(chunks(spark, d), "chunk_id", "text")


@query("c10_near_duplicate_pairs", f"WITH {NEAR.replace('FROM sh a JOIN sh b', 'FROM cs a JOIN cs b').replace('np AS', CLASSES + ', np AS')} SELECT a, b, distance FROM np")
def c10(spark, d):
    return dedup.near_pairs(prints(spark, d))


@query("c10_fingerprint_classes", f"WITH {HASHES}, {CLASSES} SELECT sh.chunk_id AS id, cs.chunk_id AS rep FROM sh JOIN cs USING (source_type, n_chars, hi, lo)")
def c10_classes(spark, d):
    return dedup.fingerprint_classes(prints(spark, d))


@query("c9_exact_duplicates", f"WITH {CHUNKS}, o AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY sha256(text)) AS owner FROM ch) SELECT chunk_id, owner FROM o WHERE chunk_id <> owner")
def c9(spark, d):
    rows = chunks(spark, d).select("chunk_id", F.sha2("text", 256).alias("h"))
    owners = rows.groupBy("h").agg(F.min("chunk_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    return rows.join(owners, "h").where("chunk_id <> owner").select("chunk_id", "owner")


@query("c3_too_short", f"WITH {CHUNKS} SELECT chunk_id, CAST(length(text) AS INTEGER) AS n_chars FROM ch WHERE length(text) < 80")
def c3(spark, d):
    return chunks(spark, d).select("chunk_id", F.length("text").alias("n_chars")).where("n_chars < 80")


@query("f4_rejections")
def f4(spark, d):
    c = chunks(spark, d).withColumn("h", F.sha2("text", 256))
    own = c.groupBy("h").agg(F.min("chunk_id").alias("owner"))
    rows = c.join(own, "h").select("chunk_id", "owner", F.length("text").alias("n_chars"))
    short = rows.where("n_chars < 80").select("chunk_id", F.lit("too_short").alias("reason"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("int").alias("distance"))
    exact = rows.where("n_chars >= 80 and chunk_id <> owner").select("chunk_id", F.lit("exact_duplicate").alias("reason"), F.col("owner").alias("duplicate_of"), F.lit(None).cast("int").alias("distance"))
    left = rows.where("n_chars >= 80 and chunk_id = owner").select(F.col("chunk_id").alias("id"))
    near = dedup.near_rejections(prints(spark, d).join(left, "id", "left_semi"))
    return short.union(exact).union(near.select(F.col("id").alias("chunk_id"), F.lit("near_duplicate").alias("reason"), "duplicate_of", "distance"))


@query("f1_corpus_stats", f"WITH {CHUNKS} SELECT source_type, count(*) AS n_chunks, count(DISTINCT source_path) AS n_paths, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, round(avg(length(text)), 6) AS mean_chars, CAST(quantile_disc(length(text), 0.5) AS DOUBLE) AS p50_chars, CAST(quantile_disc(length(text), 0.95) AS DOUBLE) AS p95_chars FROM ch GROUP BY source_type")
def f1(spark, d):
    rows = chunks(spark, d).withColumn("n", F.length("text")).groupBy("source_type")
    return rows.agg(F.count("*").alias("n_chunks"), F.count_distinct("source_path").alias("n_paths"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.round(F.avg("n"), 6).alias("mean_chars"), metrics.nearest_rank("n", 0.5).alias("p50_chars"), metrics.nearest_rank("n", 0.95).alias("p95_chars"))


@query("f2_quality_report", "SELECT coalesce(lower(trim(review_status)), 'unknown') AS review_status, coalesce(license_status, 'unknown') AS license_status, source_type, count(*) AS n_docs, count(DISTINCT sha256(text)) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY GROUPING SETS ((1), (2), (3)) ".replace("GROUPING SETS ((1), (2), (3))", "GROUPING SETS ((coalesce(lower(trim(review_status)), 'unknown')), (coalesce(license_status, 'unknown')), (source_type))"))
def f2(spark, d):
    rows = table(spark, d, "documents").select(F.coalesce(F.lower(F.trim("review_status")), F.lit("unknown")).alias("review_status"), F.coalesce("license_status", F.lit("unknown")).alias("license_status"), "source_type", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    return rows.groupingSets([["review_status"], ["license_status"], ["source_type"]], "review_status", "license_status", "source_type").agg(F.count("*").alias("n_docs"), F.count_distinct("h").alias("n_texts"), F.sum("n").alias("n_chars"))


@query("f3_template_lines", f"WITH l AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: lower({SQUEEZED.replace('{t}', 'x')})))) AS line FROM documents), c AS (SELECT line, count(*) AS n FROM l WHERE length(line) >= 12 GROUP BY line) SELECT count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_occurrences, round(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) / sum(n), 6) AS template_share FROM c")
def f3(spark, d):
    lines = F.array_distinct(F.transform(F.split("text", "\\r\\n|[\\n\\r]"), lambda x: F.lower(T.squeezed(x))))
    counts = table(spark, d, "documents").select(F.explode(lines).alias("line")).where(F.length("line") >= 12).groupBy("line").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_occurrences"), F.round(F.sum(F.when(F.col("n") >= 5, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("template_share"))


STRIP = "regexp_replace({t}, '^[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}]+|[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}]+$', '', 'g')"


@query("g1_paragraph_packing", f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.replace('{t}', 'x')}), lambda x: x <> '') AS ps FROM documents),
w AS (SELECT doc_id, ps, 1 AS i, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS done FROM p WHERE len(ps) > 0 UNION ALL
SELECT doc_id, ps, i + 1, CASE WHEN cur IS NOT NULL AND length(cur) + 2 + length(ps[i]) <= 800 THEN cur || chr(10) || chr(10) || ps[i] ELSE ps[i] END, CASE WHEN cur IS NOT NULL AND length(cur) + 2 + length(ps[i]) > 800 THEN cur END FROM w WHERE i <= len(ps)),
o AS (SELECT doc_id, done AS part FROM w WHERE done IS NOT NULL UNION ALL SELECT doc_id, cur FROM w WHERE i = len(ps) + 1)
SELECT doc_id, sha256(part) AS part_hash, CAST(length(part) AS INTEGER) AS n_chars FROM o""")
def g1(spark, d):
    rows = chunking.packed_paragraphs(table(spark, d, "documents"), "doc_id", "text", 800)
    return rows.select("doc_id", F.sha2("part", 256).alias("part_hash"), F.length("part").alias("n_chars"))


@query("g2_fixed_windows", f"WITH w AS (SELECT doc_id, {STRIP.replace('{t}', 'substr(text, i * 800 + 1, 800)')} AS part FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)) SELECT doc_id, sha256(part) AS part_hash FROM w WHERE part <> ''")
def g2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(chunking.fixed_windows(F.col("text"), 800)).alias("part")).select("doc_id", F.sha2("part", 256).alias("part_hash"))


@query("g5_sentence_chunks")
def g5(spark, d):
    return chunking.sentence_chunks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query("f24_chunk_quality", f"WITH {CHUNKS}, m AS (SELECT *, count(*) OVER (PARTITION BY source_path) AS n, row_number() OVER (PARTITION BY source_path ORDER BY chunk_id DESC) AS back FROM ch) SELECT source_type, round(avg(CASE WHEN length(text) < 210 THEN 1.0 ELSE 0.0 END), 6) AS short_share, round(avg(CASE WHEN back > 1 THEN CASE WHEN regexp_matches(rtrim(text, ' ' || chr(10)), '[。！？!?；;.…”）)]$') THEN 0.0 ELSE 1.0 END END), 6) AS mid_sentence_share FROM m GROUP BY source_type")
def f24(spark, d):
    c = chunks(spark, d)
    last = c.groupBy("source_path").agg(F.max("chunk_id").alias("chunk_id")).withColumn("is_last", F.lit(True))
    rows = c.join(last, ["source_path", "chunk_id"], "left")
    ended = F.rtrim("text", F.lit(" \n")).rlike("[。！？!?；;.…”）)]$")
    return rows.groupBy("source_type").agg(F.round(F.avg((F.length("text") < 210).cast("double")), 6).alias("short_share"), F.round(F.avg(F.when(F.col("is_last").isNull(), (~ended).cast("double"))), 6).alias("mid_sentence_share"))


@query("c21_reference_integrity", f"WITH {CASES}, {CHUNKS}, r AS (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca) SELECT case_id, chunk_id FROM r ANTI JOIN ch USING (chunk_id)")
def c21(spark, d):
    return cases(spark, d).select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id")).join(chunks(spark, d).select("chunk_id"), "chunk_id", "left_anti").select("case_id", "chunk_id")


@query("c4_label_chunks", f"WITH {CASES}, {CHUNKS}, r AS (SELECT case_id, unnest(relevant_chunk_ids) AS chunk_id FROM ca) SELECT case_id, chunk_id, source_type, source_path FROM r JOIN ch USING (chunk_id)")
def c4(spark, d):
    labels = cases(spark, d).select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    return labels.join(chunks(spark, d), "chunk_id").select("case_id", "chunk_id", "source_type", "source_path")


ISSUES = f"""{CASES}, iss AS (SELECT case_id, 'answerable_without_labels' AS issue FROM ca WHERE answerable AND coalesce(len(relevant_chunk_ids), 0) = 0 UNION ALL SELECT case_id, 'unanswerable_with_labels' FROM ca WHERE NOT answerable AND coalesce(len(relevant_chunk_ids), 0) > 0 UNION ALL SELECT case_id, 'missing_query' FROM ca WHERE coalesce(trim(query), '') = '' UNION ALL SELECT case_id, 'unknown_split' FROM ca WHERE split NOT IN ('train', 'dev', 'test') UNION ALL SELECT case_id, 'missing_points' FROM ca WHERE answerable AND coalesce(len(expected_points), 0) = 0 UNION ALL SELECT case_id, 'duplicate_case' FROM eval_cases GROUP BY case_id HAVING count(*) > 1)"""


@query("f31_dataset_issues", f"WITH {ISSUES} SELECT case_id, issue FROM iss")
def f31(spark, d):
    c = cases(spark, d)
    n = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    checks = F.array(
        F.when(F.col("answerable") & (n("relevant_chunk_ids") == 0), "answerable_without_labels"), F.when(~F.col("answerable") & (n("relevant_chunk_ids") > 0), "unanswerable_with_labels"),
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "missing_query"), F.when(~F.col("split").isin("train", "dev", "test"), "unknown_split"), F.when(F.col("answerable") & (n("expected_points") == 0), "missing_points"),
    )
    own = c.select("case_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("issue"))
    repeated = table(spark, d, "eval_cases").groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("duplicate_case").alias("issue"))
    return own.union(repeated)


@query("f32_corpus_issues", "WITH r AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty_text' END AS a, CASE WHEN license_status IS NULL OR license_status = 'unknown' THEN 'missing_license' END AS b, CASE WHEN title IS NULL THEN 'missing_title' END AS c, CASE WHEN published_at > collected_at THEN 'published_after_collection' END AS d FROM documents) SELECT doc_id, unnest(list_filter([a, b, c, d], lambda x: x IS NOT NULL)) AS issue FROM r")
def f32(spark, d):
    checks = F.array(F.when(F.coalesce("text", F.lit("")) == "", "empty_text"), F.when(F.col("license_status").isNull() | (F.col("license_status") == "unknown"), "missing_license"), F.when(F.col("title").isNull(), "missing_title"), F.when(F.col("published_at") > F.col("collected_at"), "published_after_collection"))
    return table(spark, d, "documents").select("doc_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("issue"))


@query("e9_nearest_rank", "SELECT event_type, count(*) AS n, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY event_type")
def e9(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), metrics.nearest_rank("value", 0.5).alias("p50"), metrics.nearest_rank("value", 0.95).alias("p95"))


@query("f14_grouped_metrics", f"WITH {CASES} SELECT category, split, count(*) AS n_cases, round(avg(CAST(answerable AS INTEGER)), 6) AS answerable_share, round(avg(coalesce(len(relevant_chunk_ids), 0)), 6) AS mean_labels FROM ca GROUP BY GROUPING SETS ((), (category), (split), (category, split))")
def f14(spark, d):
    n = F.greatest(F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)), F.lit(0))
    rows = cases(spark, d).groupingSets([[], ["category"], ["split"], ["category", "split"]], "category", "split")
    return rows.agg(F.count("*").alias("n_cases"), F.round(F.avg(F.col("answerable").cast("int")), 6).alias("answerable_share"), F.round(F.avg(n), 6).alias("mean_labels"))
