"""Lines repeated across the documents of one source.

Duplicate documents are collapsed into clusters first; a line is then counted over the distinct clusters that hold it,
and over their dates, and both decide. A line that many copies of one article carry thus shows one cluster, a notice that
every page carries shows many; the documents behind the clusters come from the same count.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import forms

_BLANKS, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")
LEAST_CHARS, LEAST_SHARE, LEAST_DOCS, LEAST_CLUSTERS, LEAST_DAYS = 12, 0.01, 5, 5, 2


def line_key(line: str, least_chars: int = LEAST_CHARS) -> str | None:
    """The key of a line in consistent form; None if it is shorter than ``least_chars`` before digits are merged."""
    line = _BLANKS.sub(" ", line.strip())
    return _DIGITS.sub("0", line) if len(line) >= least_chars else None


def keyed_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, date: F.Column | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per document: ``(k, source, day, cluster, lines)``; ``lines`` holds number and key of the long lines,
    ``cluster`` is a hash of all keys, equal for documents that differ in blanks, digits or codes only."""
    rows = df.select(F.col(id_col).alias("k"), F.col(source_col).alias("source"), (F.lit(None).cast("string") if date is None else date).alias("day"), F.col(text_col).alias("t"))
    rows = rows.where("k is not null and t is not null")
    kind = rows.schema["k"].dataType.simpleString()
    pair = pa.struct([("line_no", pa.int32()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            clusters, lines = [], []
            for text in forms.decode(*forms.consistent_batch(batch.column(3).to_pylist())):
                whole, own = xxhash.xxh3_64(), []
                for no, line in enumerate(text.split("\n"), 1):
                    key = line_key(line, 0).encode("utf-8", "surrogatepass")
                    whole.update(key + b"\n")
                    if line_key(line, least_chars) is not None:
                        own.append({"line_no": no, "key": xxhash.xxh3_64_intdigest(key) - (1 << 63)})
                clusters.append(whole.intdigest() - (1 << 63))
                lines.append(own)
            yield pa.record_batch([*batch.columns[:3], pa.array(clusters, pa.int64()), pa.array(lines, pa.list_(pair))], ["k", "source", "day", "cluster", "lines"])

    keyed = rows.mapInArrow(run, f"k {kind}, source string, day string, cluster long, lines array<struct<line_no:int,key:long>>")
    return keyed.groupBy("k").agg(F.min(F.struct("source", "day", "cluster", "lines")).alias("r")).select("k", "r.*")


def line_counts(docs: DataFrame) -> DataFrame:
    """``(source, key, n_docs, n_clusters, n_days)`` of every line of ``docs``, which comes from ``keyed_lines``. A
    cluster counts with its first date; a cluster without a date is a date of its own, as nothing tells it from others."""
    per_cluster = docs.groupBy("source", "cluster").agg(F.count("*").alias("n"), F.min("lines").alias("lines"), F.min("day").alias("day"))
    per_line = per_cluster.select("source", "n", "day", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    per_day = per_line.groupBy("source", "key", "day").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_clusters"))
    days = F.sum(F.when(F.col("day").isNull(), F.col("n_clusters")).otherwise(1))
    return per_day.groupBy("source", "key").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_clusters").alias("n_clusters"), days.alias("n_days"))


def repeated_lines(docs: DataFrame, least_share: float = LEAST_SHARE, least_docs: int = LEAST_DOCS, least_clusters: int = LEAST_CLUSTERS, least_days: int = LEAST_DAYS) -> DataFrame:
    """``(source, key, n_docs, n_clusters, n_days, n_source_docs)`` of the lines that stand in ``least_clusters`` distinct
    clusters of a source, of ``least_days`` distinct dates. Then the documents behind the clusters are counted: they have
    to be at least ``least_docs`` and ``least_share`` of the source's. However often one article is republished, its own
    lines are in one cluster and stay. Documents without a source form a source of their own (null)."""
    spread = line_counts(docs).where((F.col("n_clusters") >= least_clusters) & (F.col("n_days") >= least_days))
    totals = docs.groupBy("source").agg(F.count("*").alias("n_source_docs")).withColumnRenamed("source", "s")
    joined = spread.where(F.col("n_docs") >= least_docs).join(totals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.where(F.col("n_docs") >= least_share * F.col("n_source_docs"))


def found_lines(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(k, line_no)``: where the repeated lines stand."""
    at = docs.select("k", "source", F.explode("lines").alias("line")).select("k", "source", "line.line_no", "line.key")
    keys = repeated.select(F.col("source").alias("s"), F.col("key").alias("x"))
    return at.join(keys, (F.col("key") == F.col("x")) & F.col("source").eqNullSafe(F.col("s")), "left_semi").select("k", "line_no")


def without_lines(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, n_removed, text)``: every text without its found lines; texts without any stay as they are. Null ids
    and texts give no row, repeated ids one (least text)."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null").groupBy("k").agg(F.min("t").alias("t"))
    gone = found.groupBy("k").agg(F.collect_set("line_no").alias("gone"))  # at most the lines of one text
    kept = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda s: ~F.array_contains("gone", s["i"]))
    text = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return rows.join(gone, "k", "left").select(F.col("k").alias(id_col), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), text.alias(text_col))
