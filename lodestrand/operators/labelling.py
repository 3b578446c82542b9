"""Labels moved to the chunks that bear out their points best."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import ship_package, staged

BLOCK = 4096  # chunks of a path that are searched together
FEW = 64  # chunks of a path that are compared with each label as rows


def _best(path: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set of points the chunk of one block with most of them; rows are chunks ``(id, t)`` or sets ``(points)``."""
    table = pa.Table.from_batches(list(batches))
    chunks = sorted(zip(*(c.to_pylist() for c in table.filter(table["points"].is_null()).select(["id", "t"]).columns)))
    sets = table.filter(table["points"].is_valid())["points"].to_pylist()
    if not chunks or not sets:
        return
    # one string holds all texts of the block, so a point is sought once, whatever the number of sets that have it
    whole = "\0".join(t for _, t in chunks)
    ends, at = [], -1
    for _, t in chunks:
        at += len(t) + 1
        ends.append(at)
    holders: dict[str, list[int]] = {}
    for point in {p for s in sets for p in s if p is not None}:
        holders[point] = _holders(whole, ends, chunks, point)
    ids, most = [], []
    for s in sets:
        counts: dict[int, int] = {}
        for point in s:
            for c in holders[point] if point is not None else ():
                counts[c] = counts.get(c, 0) + 1
        n, c = min(((-n, c) for c, n in counts.items()), default=(0, 0))
        ids.append(chunks[c][0])
        most.append(-n)
    yield pa.record_batch([pa.array([path[0].as_py()] * len(sets), pa.string()), pa.array(sets, pa.list_(pa.string())), pa.array(ids, pa.string()), pa.array(most, pa.int32())], ["source_path", "points", "candidate", "n_points"])


def _holders(whole: str, ends: list[int], chunks: list[tuple], point: str) -> list[int]:
    """The places of the chunks whose text contains the point."""
    if not point or "\0" in point:  # an empty point stands in every text; one with the separator is sought text by text
        return [c for c, (_, t) in enumerate(chunks) if point in t]
    out, at = [], whole.find(point)
    while at >= 0:
        c = bisect_left(ends, at)
        out.append(c)
        at = whole.find(point, ends[c])
    return out


def remapped(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(case_id, chunk_id, candidate, n_points)``: for each of ``labels(case_id, chunk_id, points)`` the chunk of the same
    ``source_path`` whose match text contains most of its points, the least id among equals. ``chunks(chunk_id, source_path,
    t)`` has a row an id.

    Labels of equal points in a path are one. Where a path has more than ``FEW`` chunks, these are searched in blocks of about
    ``BLOCK``, so no pair of a label and a chunk becomes a row, however many chunks a path has."""
    ship_package(labels.sparkSession)
    chunks = staged(chunks.where("source_path is not null"), "texts")
    own = staged(labels.distinct().join(chunks.select("chunk_id", "source_path"), "chunk_id"), "labels")
    sizes = chunks.groupBy("source_path").agg(F.count("*").alias("held"))
    wanted = staged(own.select("source_path", "points").distinct().join(sizes, "source_path").withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")), "wanted")
    few, many = wanted.where(F.col("held") <= FEW), wanted.where(F.col("held") > FEW)
    counted = F.size(F.filter("points", lambda x: F.contains("t", x)))
    pairs = few.join(chunks, "source_path").select("source_path", "points", F.col("chunk_id").alias("candidate"), counted.alias("n_points"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    sets = many.select("source_path", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none("id", "string"), none("t", "string"), "points")
    block = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int").alias("block")
    texts = chunks.join(many.select("source_path", "blocks").distinct(), "source_path").select("source_path", block, F.col("chunk_id").alias("id"), "t", none("points", "array<string>"))
    found = sets.union(texts).groupBy("source_path", "block").applyInArrow(_best, "source_path string, points array<string>, candidate string, n_points int")
    rows = pairs.union(found)
    best = rows.groupBy("source_path", "points").agg(F.min(F.struct((-F.col("n_points")).alias("o"), "candidate")).alias("m"))
    return own.join(best, ["source_path", "points"]).select("case_id", "chunk_id", "m.candidate", (-F.col("m.o")).alias("n_points"))
