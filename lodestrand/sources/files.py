"""Readers and writers of corpora, job lists, labels and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB_FIELDS = ("job_id", "company", "job_title", "city", "source_platform", "source_url", "description", "requirements", "first_seen_at", "last_seen_at", "status", "version", "content_hash")
TEXT_SUFFIXES = ("md", "txt")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(source_path, text)`` of all Markdown and text files below a folder, a row a file; others and empty ones are
    skipped."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(TEXT_SUFFIXES) + "}").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def jobs_json(spark: SparkSession, path: str) -> DataFrame:
    """Job rows from a JSON list, or from the ``jobs`` list of an object."""
    rows = spark.read.json(path, multiLine=True)
    return rows.select(F.explode("jobs").alias("j")).select("j.*") if rows.columns == ["jobs"] else rows


def jobs_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=", ".join(f"{c} string" for c in JOB_FIELDS))


def checked_jobs(rows: DataFrame) -> DataFrame:
    """Job rows with every field there and whole version numbers; a lack raises. Unknown states become ``unknown``."""
    missing = [c for c in JOB_FIELDS if c not in rows.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    version = F.col("version").try_cast("int")
    state = F.lower(F.trim("status"))
    return rows.select(
        *(c for c in JOB_FIELDS if c not in ("status", "version")), F.when(state.isin("active", "expired"), state).otherwise("unknown").alias("status"),
        F.when(version.isNull(), F.raise_error(F.concat(F.lit("version is no number: "), F.coalesce(F.col("version").cast("string"), F.lit("null"))))).otherwise(version).cast("int").alias("version"),
    )


LABEL_SCHEMA = "case_id string, query string, category string, split string, expected_intent string, expected_sources array<string>, relevant_chunk_ids array<string>, answerable boolean, expected_points array<string>, notes string, human_reviewed boolean"


def labels_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Label rows; malformed lines raise, and so do predictions among the labels."""
    if predicted := [c for c in spark.read.json(path).columns if c.startswith("predicted")]:
        raise ValueError(f"labels hold predictions: {', '.join(predicted)}")
    return spark.read.schema(LABEL_SCHEMA).json(path, mode="FAILFAST")


def write_version(rows: DataFrame, folder: str, version: str) -> None:
    """Replace one version of a table and leave the others as they are."""
    rows.withColumn("dataset_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_version").parquet(folder)


def write_run(rows: DataFrame, folder: str) -> None:
    """Write the results of a run; a folder that holds some already is refused."""
    rows.write.mode("errorifexists").parquet(folder)
