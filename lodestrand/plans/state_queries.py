"""Versions, tombstones, ownership, recall and sessions over the tables; scalars of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import corpus as C
from lodestrand.operators import dense, state
from lodestrand.plans.registry import query
from lodestrand.plans.retrieval_queries import UNIT, ranked
from lodestrand.session import table

UPDATES = "up AS (SELECT user_id, event_id, row_number() OVER w AS seq, row_number() OVER w - 1 - count(CASE WHEN event_id % 5 = 0 THEN 1 END) OVER w AS expected FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
FOLDED = f"{UPDATES}, fo AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS version, CAST(NULL AS BIGINT) AS event_id, false AS accepted FROM (SELECT DISTINCT user_id FROM up) UNION ALL SELECT up.user_id, up.seq, CASE WHEN up.expected = fo.version THEN fo.version + 1 ELSE fo.version END, up.event_id, up.expected = fo.version FROM fo JOIN up ON up.user_id = fo.user_id AND up.seq = fo.seq + 1)"


def updates(spark, d):
    """Every event as an update of its user's profile; those with numbers divisible by 5 let later ones expect less."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seq = F.count("*").over(w)
    return table(spark, d, "events").select("user_id", "event_id", seq.alias("seq"), (seq - 1 - F.count_if(F.col("event_id") % 5 == 0).over(w)).alias("expected"))


@query("l4_accepted_updates", f"WITH RECURSIVE {FOLDED} SELECT user_id, event_id, accepted, version FROM fo WHERE seq > 0")
def l4(spark, d):
    return state.accepted_updates(updates(spark, d), "user_id", "seq", "expected").select("user_id", "event_id", "accepted", "version")


@query("l6_current_rows", "SELECT user_id, event_type, event_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) WHERE event_id % 10 <> 0")
def l6(spark, d):
    return state.current_rows(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], F.col("event_id") % 10 == 0).select("user_id", "event_type", "event_id", "value")


OWNERS = "ow AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0)"


def owners(spark, d):
    return table(spark, d, "events").where("event_id % 3 = 0").select("user_id", "event_type")


@query("c25_owned_rows", f"WITH {OWNERS} SELECT event_id FROM events SEMI JOIN ow USING (user_id, event_type)")
def c25(spark, d):
    return state.owned(table(spark, d, "events"), owners(spark, d), ["user_id", "event_type"]).select("event_id")


@query("l9_out_of_scope", f"WITH {OWNERS} SELECT event_id FROM events ANTI JOIN ow USING (user_id, event_type)")
def l9(spark, d):
    return state.out_of_scope(table(spark, d, "events"), owners(spark, d), ["user_id", "event_type"]).select("event_id")


AS_OF = "2024-06-01 00:00:00"
MEMORIES = "me AS (SELECT source_type AS user_id, CAST(doc_id AS VARCHAR) AS memory_id, n_chars AS importance, collected_at, coalesce(lower(trim(review_status)) = 'reviewed', false) AS confirmed, license_status IS NOT NULL AS active, published_at AS expires_at FROM documents)"


def memories(spark, d):
    """Documents as memories of their source type."""
    return table(spark, d, "documents").select(
        F.col("source_type").alias("user_id"), F.col("doc_id").cast("string").alias("memory_id"), F.col("n_chars").alias("importance"), "collected_at", F.coalesce(F.lower(F.trim("review_status")) == "reviewed", F.lit(False)).alias("confirmed"),
        F.col("license_status").isNotNull().alias("active"), F.col("published_at").alias("expires_at"),
    )


@query("c26_available_memories", f"WITH {MEMORIES} SELECT user_id, memory_id FROM me WHERE confirmed AND active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')")
def c26(spark, d):
    return state.available(memories(spark, d), AS_OF).select("user_id", "memory_id")


@query("e4_top_memories", f"WITH {MEMORIES} SELECT user_id, memory_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, collected_at DESC, memory_id) AS INTEGER) AS rank FROM me QUALIFY rank <= 20")
def e4(spark, d):
    return state.top_memories(memories(spark, d), 20, F.desc("importance"), F.desc("collected_at"), "memory_id").select("user_id", "memory_id", "rank")


OWN = f"{UNIT}, mv AS (SELECT grp || '/' || source_type AS owner, chunk_id, source_type, unit, coalesce(TRY_CAST(split_part(chunk_id, '-', 2) AS BIGINT) % 10 / 10.0, 0.0) AS importance FROM un WHERE source_type IS NOT NULL), mq AS (SELECT owner, chunk_id AS query_id, unit FROM mv WHERE TRY_CAST(split_part(chunk_id, '-', 2) AS BIGINT) % 100 = 0), mp AS (SELECT query_id, v.chunk_id, v.source_type, v.importance, list_inner_product(q.unit, v.unit) AS cosine FROM mq q JOIN mv v ON q.owner = v.owner AND q.query_id <> v.chunk_id)"


def recalled(spark, d, boost: float, k: int):
    """The searches among the vectors of their own source type; a vector's importance is the last digit of its number."""
    v = dense.usable(table(spark, d, "chunk_vectors"), 64).where("source_type is not null")
    number = F.expr("try_cast(split_part(chunk_id, '-', 2) as bigint)")
    v = v.select(F.concat("embedding_version", F.lit("/"), "source_type").alias("grp"), "chunk_id", "source_type", "unit", F.coalesce(number % 10 / 10.0, F.lit(0.0)).alias("importance")).withColumn("boost", F.lit(boost) * F.col("importance")).withColumn("tie", -F.col("importance"))
    q = v.where(number % 100 == 0).select("grp", F.col("chunk_id").alias("query_id"), "unit")
    return dense.exact_top_k(q, v, k, positive_only=False)


@query("e5_semantic_recall", f"WITH {OWN}, rc AS (SELECT *, cosine AS score FROM mp) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {ranked('rc', 5, '-importance, source_type, chunk_id', 'true')}")
def e5(spark, d):
    return recalled(spark, d, 0.0, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("e6_boosted_recall", f"WITH {OWN}, rc AS (SELECT *, cosine + 0.1 * importance AS score FROM mp) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {ranked('rc', 5, '-importance, source_type, chunk_id', 'true')}")
def e6(spark, d):
    return recalled(spark, d, 0.1, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("e14_repeated_reads", "WITH m AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) - 1 AS later FROM events) SELECT user_id, count(*) AS n_messages, CAST(sum(least(later, 6)) AS BIGINT) AS n_reads, CAST(sum(greatest(least(later, 6) - 1, 0)) AS BIGINT) AS n_repeated FROM m GROUP BY user_id")
def e14(spark, d):
    return state.repeated_reads(table(spark, d, "events"), "user_id", ["ts", "event_id"], 6)


@query("l8_session_context", f"""WITH RECURSIVE {FOLDED}, h AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY seq) AS history FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 4) GROUP BY user_id),
mm AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC, event_id) AS memories FROM (SELECT * FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3) GROUP BY user_id),
pr AS (SELECT user_id, max(version) AS profile_version FROM fo WHERE accepted GROUP BY user_id)
SELECT u.user_id, coalesce(history, '') AS history, coalesce(memories, '') AS memories, profile_version FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN h USING (user_id) LEFT JOIN mm USING (user_id) LEFT JOIN pr USING (user_id)""")
def l8(spark, d):
    events = table(spark, d, "events")
    messages = updates(spark, d).select("user_id", "seq", F.col("event_id").alias("message_id"))
    own = events.where("event_type = 'purchase'").select("user_id", F.col("value").alias("importance"), F.col("event_id").alias("memory_id"))
    profiles = state.accepted_updates(updates(spark, d), "user_id", "seq", "expected").where("accepted").groupBy("user_id").agg(F.max("version").alias("version"))
    rows = state.session_context(events, messages, own, profiles, 4, 3)
    return rows.select("user_id", F.array_join("history", ",").alias("history"), F.array_join("memories", ",").alias("memories"), "profile_version")


@query("b16_vector_literals", f"WITH {UNIT} SELECT grp, chunk_id, '[' || array_to_string(list_transform(list_transform(unit, lambda x: round(x * 8) / 8 + 0.0), lambda x: format('{{:g}}', x)), ',') || ']' AS literal FROM un")
def b16(spark, d):
    rows = dense.usable(table(spark, d, "chunk_vectors"), 64)
    return rows.select(F.col("embedding_version").alias("grp"), "chunk_id", C.vector_literal(F.transform("unit", lambda x: F.round(x * 8) / 8)).alias("literal"))


@query("b26_fingerprints", """SELECT job_id, version, sha256('{"city":"' || coalesce(city, '') || '","platform":"' || source_platform || '","version":"' || CAST(version AS VARCHAR) || '"}') AS fingerprint FROM job_postings""")
def b26(spark, d):
    settings = F.create_map(F.lit("version"), F.col("version").cast("string"), F.lit("city"), F.coalesce("city", F.lit("")), F.lit("platform"), F.col("source_platform"))
    return table(spark, d, "job_postings").select("job_id", "version", C.fingerprint(settings).alias("fingerprint"))


MESSAGE = "CASE event_id % 6 WHEN 0 THEN 'HTTP 401 denied' WHEN 1 THEN 'got http  429' WHEN 2 THEN 'Http 503 upstream' WHEN 3 THEN 'Connection reset' WHEN 4 THEN 'missing API_KEY' ELSE 'odd ' || event_type END"


@query("b27_error_kinds", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'authentication_error' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'provider_5xx' WHEN 3 THEN 'connection_error' WHEN 4 THEN 'authentication_error' ELSE 'provider_error' END AS kind, event_id % 6 IN (1, 2, 3) AS transient FROM events")
def b27(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(MESSAGE).alias("m"))
    return rows.select("event_id", C.error_kind(F.col("m")).alias("e")).select("event_id", "e.kind", "e.transient")
