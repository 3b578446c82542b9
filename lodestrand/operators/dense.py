"""Exact vector retrieval for a set of queries against all vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.ranking import DIGITS, top_k
from lodestrand.session import shuffle_partitions

#: Vectors in a block at most and at least, and queries in a block: what one task holds and multiplies.
MOST_ROWS, LEAST_ROWS, QUERY_ROWS = 16_384, 1_024, 4_096


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """``(embedding_version, chunk_id, source_type, unit)``: one unit vector for each group and id; null, short and zero
    vectors drop out."""
    rows = vectors.where((F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull())).select("embedding_version", "chunk_id", "source_type", "embedding")

    def run(batches):
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            size = np.sqrt((x * x).sum(1))
            good = np.flatnonzero(size > 0)
            unit = (x[good] / size[good, None]).reshape(-1)
            ends = pa.array(np.arange(len(good) + 1, dtype=np.int32) * dimensions)
            take = pa.array(good)
            yield pa.record_batch([*(batch.column(i).take(take) for i in range(3)), pa.ListArray.from_arrays(ends, pa.array(unit))], ["embedding_version", "chunk_id", "source_type", "unit"])

    one = rows.groupBy("embedding_version", "chunk_id").agg(F.min("source_type").alias("source_type"), F.min("embedding").alias("embedding"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("embedding_version", "chunk_id", "source_type"))
    return one.mapInArrow(run, f"{kinds}, unit array<double>")


def _blocked(queries: DataFrame, vectors: DataFrame, compare: Callable, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``compare(queries, their numbers, vectors, table of the vectors, table of the queries)`` for all pairs of a
    block of vectors and a block of queries of one group. Blocks have a bounded number of rows, so their number follows
    the tables; a vector is sent once for each block of queries, a query once for each block of vectors."""
    n, m = vectors.count(), queries.count()
    tasks = 2 * shuffle_partitions(vectors.sparkSession)
    of_vectors = max(1, -(-n // MOST_ROWS), min(tasks, n // LEAST_ROWS))
    of_queries = max(1, -(-m // QUERY_ROWS))
    place = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select(F.col("grp").alias("v_grp"), place("chunk_id", of_vectors).alias("v_i"), each(of_queries).alias("v_j"), "chunk_id", "source_type", F.col("unit").alias("v_unit"), *(F.col(c) for c in extra))
    right = queries.select("grp", each(of_vectors).alias("i"), place("query_id", of_queries).alias("j"), "query_id", "unit")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            empty = {"query_id": b.column("query_id"), "chunk_id": a.column("chunk_id"), "source_type": a.column("source_type")}
            return pa.table([empty[c].slice(0, 0) if c in empty else pa.array([], pa.float64()) for c in names], names)
        x, q = (t.combine_chunks().column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t, c in ((a, "v_unit"), (b, "unit")))
        own = {k: i for i, k in enumerate(a.column("chunk_id").to_pylist())}
        mine = np.array([own.get(k, -1) for k in b.column("query_id").to_pylist()], np.int64)  # where a query stands itself
        return pa.table(compare(q, mine, x, a, b), names)

    return left.groupBy("v_grp", "v_i", "v_j").cogroup(right.groupBy("grp", "i", "j")).applyInArrow(run, schema)


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, positive_only: bool = True) -> DataFrame:
    """``(query_id, chunk_id, source_type, score, rank)``: the ``k`` nearest of ``vectors(grp, chunk_id, source_type,
    unit)`` for each of ``queries(grp, query_id, unit)`` of its group, itself left out.

    If ``vectors`` have a ``boost`` it is added to their scores (null as 0), and equal scores go to the lower ``tie`` if they have
    one. A block is one matrix product; it sends on what may be among the k best of a query, ties included, and the last
    choice is made over all blocks."""
    boosted, tied = "boost" in vectors.columns, "tie" in vectors.columns

    def compare(q, mine, x, a, b):
        at, by, scores = [], [], []
        boost = np.nan_to_num(a.column("boost").to_numpy().astype(np.float64)) if boosted else 0.0
        for first in range(0, len(q), 256):
            s = np.round(q[first : first + 256] @ x.T + boost, DIGITS + 3)
            here = np.flatnonzero(mine[first : first + 256] >= 0)
            s[here, mine[first : first + 256][here]] = -np.inf
            if positive_only:
                s[s <= 0] = -np.inf
            low = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            rows, columns = np.nonzero((np.round(s, DIGITS) >= np.round(low, DIGITS)[:, None]) & np.isfinite(s))
            by.append(rows + first)
            at.append(columns)
            scores.append(s[rows, columns])
        at, by = pa.array(np.concatenate(at)), pa.array(np.concatenate(by))
        return [b.column("query_id").take(by), a.column("chunk_id").take(at), a.column("source_type").take(at), pa.array(np.concatenate(scores)), *([a.column("tie").take(at)] if tied else [])]

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("chunk_id", "source_type")} | {"query_id": queries.schema["query_id"].dataType.simpleString()}
    hits = _blocked(queries, vectors, compare, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, source_type {kinds['source_type']}, score double" + ", tie double" * tied, ("boost",) * boosted + ("tie",) * tied)
    return top_k(hits, k, *["tie"] * tied, "source_type", "chunk_id")


def best_by_source(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(query_id, source_type, score)``: for each of ``queries(grp, query_id, unit)`` its best cosine among the
    ``vectors(grp, chunk_id, source_type, unit)`` of each source type and of its group, itself left out. A block sends
    on one number for a query and source type."""

    def compare(q, mine, x, a, b):
        sources = np.array(a.column("source_type").to_pylist(), object)
        by, of, scores = [], [], []
        for first in range(0, len(q), 256):
            s = q[first : first + 256] @ x.T
            here = np.flatnonzero(mine[first : first + 256] >= 0)
            s[here, mine[first : first + 256][here]] = -np.inf
            for source in dict.fromkeys(sources.tolist()):
                best = s[:, sources == source].max(1)
                rows = np.flatnonzero(np.isfinite(best))
                by += (rows + first).tolist()
                of += [source] * len(rows)
                scores += best[rows].tolist()
        return [b.column("query_id").take(pa.array(by, pa.int64())), pa.array(of, pa.string()), pa.array(scores, pa.float64())]

    found = _blocked(queries, vectors, compare, f"query_id {queries.schema['query_id'].dataType.simpleString()}, source_type {vectors.schema['source_type'].dataType.simpleString()}, score double")
    return found.groupBy("query_id", "source_type").agg(F.max("score").alias("score"))
