"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1 << 24


def least_hashes(rows: DataFrame, n_rows: int, most: int) -> DataFrame:
    """At most ``most`` of ``rows(k, t, …)``, those whose key has the least hash, so the same ones each time. Only about
    twice as many rows are sent on before the choice, however many tasks read the table (``n_rows`` rows)."""
    h = F.xxhash64(F.col("k").cast("string"))
    share = min(1.0, 2.0 * most / max(n_rows, 1))
    return rows.withColumn("h", F.pmod(h, F.lit(SCALE))).where(F.col("h") <= int(share * SCALE)).orderBy("h", "k", "t").limit(most).drop("h")


def least_hashes_per_label(rows: DataFrame, label_counts: dict[str, int], most: int) -> DataFrame:
    """At most ``most`` of ``rows(k, label, t, …)`` whose label is counted in ``label_counts``: of each label those whose
    key has the least hash, an equal number of each, so that rare labels are there as well as common ones."""
    quota = -(-most // max(1, len(label_counts)))
    bound = F.create_map(*(F.lit(x) for label, n in label_counts.items() for x in (label, int(min(1.0, 2.0 * quota / max(n, 1)) * SCALE))))
    near = rows.where(F.col("label").isin(list(label_counts))).withColumn("h", F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(SCALE))).where(F.col("h") <= F.element_at(bound, F.col("label")))
    order = Window.partitionBy("label").orderBy("h", "k", "t")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota).drop("h", "place")
