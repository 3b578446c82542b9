"""Comparisons of runs and gates over metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``(metric, passed)`` from ``metrics(metric, old, new)`` and ``gates(metric, direction, allowance)``: a metric
    that should be high may drop by the allowance, one that should be low may grow to the old value times it. A gate
    without values fails."""
    rows = gates.join(metrics, "metric", "left")
    ok = F.when(F.col("direction") == "higher", F.col("new") >= F.col("old") - F.col("allowance")).otherwise(F.col("new") <= F.col("old") * F.col("allowance"))
    return rows.select("metric", F.coalesce(ok, F.lit(False)).alias("passed"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, old, new, change)``: improved, regressed or same for keys of both runs."""
    rows = before.select(key, F.col(value).alias("old")).join(after.select(key, F.col(value).alias("new")), key)
    return rows.withColumn("change", F.when(F.round("new", 9) > F.round("old", 9), "improved").when(F.round("new", 9) < F.round("old", 9), "regressed").otherwise("same"))


def regressions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(case_id, status, passed)``: only ``fixed`` cases are judged, ``open`` ones stay unknown; a fixed case without
    a result fails."""
    rows = expected.join(actual.select("case_id", F.col("result").alias("actual")), "case_id", "left")
    ok = F.coalesce(F.col("actual") == F.col("result"), F.lit(False))
    return rows.select("case_id", "status", F.when(F.col("status") == "fixed", ok).alias("passed"))


def verdict(flags: DataFrame, key: str, flag: str) -> DataFrame:
    """``(key, unsupported)``: true as soon as one claim is unsupported, unknown if one is unknown, else false."""
    c = F.col(flag)
    return flags.groupBy(key).agg(F.when(F.coalesce(F.bool_or(c), F.lit(False)), F.lit(True)).when(F.count(c) < F.count(F.lit(1)), F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("unsupported"))
