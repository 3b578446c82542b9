"""Append-only logs, as batches or streams: the same functions take either kind of DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """A folder of appended files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """``(start, event_type, n, total)`` per tumbling window; a stream drops what comes later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of_key(events: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Events whose key was not seen before (within the watermark, for a stream)."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def append(rows: DataFrame, folder: str, checkpoint: str):
    """Write a stream to a folder once for all input there is; restarts go on where it stopped."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
