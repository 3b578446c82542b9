"""Queries by name with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows can be checked."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql.strip()
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk id that has a text."""
    return _one_a_chunk(table(spark, d, "chunks").where("text is not null"))


def _one_a_chunk(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("source_type", "source_path", "title", "text")))


MOST_IDS = 200_000  # ids that go to every task at once; more are joined


def chunks_in_place(spark: SparkSession, d: str) -> DataFrame:
    """``chunks`` for a single reading of all texts. Ids with several rows go to the chunks as long as they are few; only
    their rows are shuffled, the others stay where they lie."""
    rows = table(spark, d, "chunks").where("text is not null")
    many = staged(rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("many"), F.lit(True).alias("again")), "many")
    if many.limit(MOST_IDS + 1).count() > MOST_IDS:
        return chunks(spark, d)
    marked = rows.join(F.broadcast(many), F.col("chunk_id").eqNullSafe(F.col("many")), "left")  # a null id is an id
    one = marked.where("again is null").select("chunk_id", "source_type", "source_path", "title", "text")
    return one.union(_one_a_chunk(marked.where("again")))


def chunks_of(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """``chunks`` of the ids in ``hits``, which are read more than once. The ids go to the chunks as long as they are few, so no other text
    is shuffled."""
    ids = hits.select("chunk_id").distinct()
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    return _one_a_chunk(table(spark, d, "chunks").where("text is not null").join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """One row per case id."""
    rows = table(spark, d, "eval_cases")
    columns = ("query", "category", "split", "expected_intent", "expected_sources", "relevant_chunk_ids", "answerable", "expected_points", "human_reviewed")
    return rows.groupBy("case_id").agg(*(F.min(c).alias(c) for c in columns))


def searches(spark: SparkSession, d: str) -> DataFrame:
    """The stated set of searches: the cases whose number is divisible by 100, against all chunks."""
    rows = cases(spark, d).where("cast(substring(case_id, 5) as bigint) % 100 = 0")
    return rows.withColumnRenamed("case_id", "query_id")


CHUNKS = "ch AS (SELECT chunk_id, min(source_type) AS source_type, min(source_path) AS source_path, min(title) AS title, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id)"
CASES = "ca AS (SELECT case_id, min(query) AS query, min(category) AS category, min(split) AS split, min(expected_intent) AS expected_intent, min(expected_sources) AS expected_sources, min(relevant_chunk_ids) AS relevant_chunk_ids, min(answerable) AS answerable, min(expected_points) AS expected_points, min(human_reviewed) AS human_reviewed FROM eval_cases GROUP BY case_id)"
SEARCHES = CASES + ", se AS (SELECT *, case_id AS query_id FROM ca WHERE CAST(substring(case_id, 5) AS BIGINT) % 100 = 0)"
