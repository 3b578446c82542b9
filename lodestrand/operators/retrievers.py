"""Retrievers by name, encoders and scorers as plain functions, approximate search, and dense indexes on disk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import overlap, token_set
from lodestrand.operators import dense, graph, lexical, ranking

#: An encoder turns a batch of texts into unit vectors (texts x dimensions), a scorer pairs of texts into numbers.
Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]


def encoded(rows: DataFrame, encoder: Encoder, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, unit)`` by any encoder, a batch at a time; rows without a text drop out. The encoder goes to the
    executors as it is, so what it holds should be small or be loaded there."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if len(batch):
                v = np.asarray(encoder(batch.column(1).to_pylist()), np.float64)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))], [id_col, "unit"])

    return rows.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, unit array<double>")


def scored(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """``pairs(query_id, chunk_id, rank, query, text)`` with the ``rerank_score`` of any scorer, a batch at a time."""
    rows = pairs.select("query_id", "chunk_id", "rank", "query", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])

    def run(batches):
        for batch in batches:
            score = np.asarray(scorer(batch.column(3).to_pylist(), batch.column(4).to_pylist()), np.float64) if len(batch) else np.zeros(0)
            yield pa.record_batch([*batch.columns[:3], pa.array(score)], ["query_id", "chunk_id", "rank", "rerank_score"])

    return rows.mapInArrow(run, f"{kinds}, rerank_score double")


def fixed_scores(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Scores looked up in ``known(query_id, chunk_id, rerank_score)``, 0 where there is none; for tests."""
    rows = pairs.select("query_id", "chunk_id", "rank").join(known, ["query_id", "chunk_id"], "left")
    return rows.select("query_id", "chunk_id", "rank", F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"))


def with_decision(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every hit with its query's decision, ranks numbered anew without gaps. Queries without a hit drop out."""
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).join(decisions, "query_id")


def lists_of(vectors: DataFrame, n_lists: int, sample_rows: int = 16_000, rounds: int = 10) -> np.ndarray:
    """Centres of ``n_lists`` lists by k-means over at most ``sample_rows`` of the ``vectors(chunk_id, unit)``, those of
    least hash; a bound on the hash spares the sort of all."""
    n = vectors.count()
    share = min(1.0, 2.0 * sample_rows / max(n, 1))
    h = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 24))
    rows = vectors.where(h <= int(share * (1 << 24))).orderBy(h, "chunk_id").limit(sample_rows).select("unit").toArrow()
    x = rows.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
    rng = np.random.default_rng(3)
    centres = x[rng.permutation(len(x))[: max(1, min(n_lists, len(x)))]]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def listed(vectors: DataFrame, centres: np.ndarray, probes: int, id_col: str) -> DataFrame:
    """``vectors`` once for each of the ``probes`` nearest lists; ``grp`` gets the list's number."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # lists x dimensions numbers
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    at_unit = vectors.columns.index("unit")

    def run(batches):
        for batch in batches:
            if len(batch):
                x = batch.column(at_unit).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes]
                take = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
                yield pa.record_batch([*(c.take(take) for c in batch.columns), pa.array(near.reshape(-1).astype(np.int32))], [*batch.schema.names, "list"])

    return vectors.mapInArrow(run, f"{schema}, list int").withColumn("grp", F.concat_ws("/", F.col("grp").cast("string"), F.col("list").cast("string"))).drop("list")


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int, n_lists: int = 64, probes: int = 8, sample_rows: int = 16_000) -> DataFrame:
    """As ``dense.exact_top_k``, within the ``probes`` lists nearest to each query. Every vector is in one list; lists are
    compared in blocks, so their size does not matter."""
    centres = lists_of(vectors, n_lists, sample_rows)
    return dense.exact_top_k(listed(queries, centres, probes, "query_id"), listed(vectors, centres, 1, "chunk_id"), k)


@dataclass(frozen=True)
class DenseIndex:
    """``vectors(grp, chunk_id, source_type, unit)`` with what made them."""

    vectors: DataFrame
    version: str
    encoder: str
    dimensions: int


def build_dense_index(chunks: DataFrame, encoder: Encoder, version: str, name: str, dimensions: int) -> DenseIndex:
    rows = encoded(chunks, encoder, "chunk_id", "text").join(chunks.select("chunk_id", "source_type"), "chunk_id")
    return DenseIndex(rows.select(F.lit(name).alias("grp"), "chunk_id", "source_type", "unit"), version, name, dimensions)


def save_dense_index(index: DenseIndex, folder: str) -> None:
    index.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    spark = index.vectors.sparkSession
    n = spark.read.parquet(f"{folder}/vectors").count()
    spark.createDataFrame([(index.version, index.encoder, index.dimensions, n)], "version string, encoder string, dimensions int, n long").write.mode("overwrite").parquet(f"{folder}/meta")


def load_dense_index(spark: SparkSession, folder: str, version: str, encoder: str) -> DenseIndex:
    """Read an index back; another version or encoder, or vectors that don't fit the record, raise."""
    meta = spark.read.parquet(f"{folder}/meta").first()
    vectors = spark.read.parquet(f"{folder}/vectors")
    if (meta.version, meta.encoder) != (version, encoder):
        raise ValueError(f"the index is of {meta.version} by {meta.encoder}")
    found = vectors.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.size("unit") == meta.dimensions), F.lit(True)).alias("fit")).first()
    if found.n != meta.n or not found.fit:
        raise ValueError("the vectors of the index do not agree with its record")
    return DenseIndex(vectors, meta.version, meta.encoder, meta.dimensions)


@dataclass(frozen=True)
class Store:
    """What retrievers read; a retriever asks for what it needs and raises without it."""

    chunks: DataFrame
    index: lexical.Bm25Index
    dense: DenseIndex | None = None
    encoder: Encoder | None = None
    graph: graph.Graph | None = None
    catalogue: DataFrame | None = None
    max_nodes: int = 80


def _dense(store: Store, queries: DataFrame, k: int) -> DataFrame:
    if store.dense is None or store.encoder is None:
        raise ValueError("dense retrieval needs an index and its encoder")
    asked = encoded(queries, store.encoder, "query_id", "query").select(F.lit(store.dense.encoder).alias("grp"), "query_id", "unit")
    return dense.exact_top_k(asked, store.dense.vectors, k)


def _graph(store: Store, queries: DataFrame, k: int) -> DataFrame:
    if store.graph is None or store.catalogue is None:
        raise ValueError("graph retrieval needs a graph and its catalogue")
    links = graph.mentions(queries, "query_id", "query", store.catalogue).select("query_id", graph.node_id(F.col("node_type"), F.col("name")).alias("node"))
    return graph.graph_hits(queries, store.graph, links, 2, k, store.max_nodes)


def _reranked(store: Store, queries: DataFrame, k: int) -> DataFrame:
    hits = _fused(_bm25, _keyword)(store, queries, 4 * k)
    rows = hits.join(queries.select("query_id", token_set("query").alias("q")), "query_id").join(store.chunks.select("chunk_id", token_set("text").alias("c")), "chunk_id")
    ranked = ranking.rerank(rows, overlap(F.col("q"), F.col("c")), k)
    return ranked.select("query_id", "chunk_id", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank"))


def _bm25(store: Store, queries: DataFrame, k: int) -> DataFrame:
    return lexical.bm25(store.index, queries, k)


def _keyword(store: Store, queries: DataFrame, k: int) -> DataFrame:
    return lexical.keyword(store.index, queries, k)


def _fused(a: Callable, b: Callable, keep_second: bool = False) -> Callable:
    fuse = ranking.fusion_or_second if keep_second else ranking.reciprocal_rank_fusion
    return lambda store, queries, k: fuse(a(store, queries, 4 * k), b(store, queries, 4 * k), k)


RETRIEVERS: dict[str, Callable[[Store, DataFrame, int], DataFrame]] = {
    "keyword": _keyword, "bm25": _bm25, "dense": _dense, "hybrid": _fused(_keyword, _dense), "bm25_hybrid": _fused(_bm25, _dense), "lexical_hybrid": _fused(_bm25, _keyword), "hybrid_rerank": _reranked, "graph": _graph, "graph_vector": _fused(_graph, _dense, True), "graph_lexical": _fused(_graph, _bm25, True),
}


def retrieve(name: str, store: Store, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` of ``queries(query_id, query)`` by the retriever of that name."""
    if name not in RETRIEVERS:
        raise ValueError(f"no such retriever: {name}; there are {', '.join(sorted(RETRIEVERS))}")
    return RETRIEVERS[name](store, queries, k).select("query_id", "chunk_id", "score", "rank")
