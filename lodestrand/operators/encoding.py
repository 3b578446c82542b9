"""A latent-semantic text encoder: hashed character n-grams, sublinear TF-IDF, truncated decomposition, unit length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import staged

BUCKETS, DIMENSIONS = 4096, 128


@dataclass(frozen=True)
class Encoder:
    """``idf`` by bucket and the ``basis`` (buckets x dimensions); both are learned from all texts."""

    idf: np.ndarray
    basis: np.ndarray
    low: int = 2
    high: int = 4

    def counts(self, texts: list[str]) -> np.ndarray:
        """How often each bucket's n-grams stand in each text; all texts' n-grams of one length are hashed at once."""
        lowered, width = [t.lower() for t in texts], len(self.idf)
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        owner = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the text's end
        out = np.zeros(len(texts) * width, np.int64)
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, self.high + 1):
            ahead = codes[n - 1 :]
            h = h[: len(ahead)] * np.uint64(0x9E3779B97F4A7C15) + ahead + np.uint64(1)
            if n >= self.low:
                whole = np.flatnonzero(left[: len(ahead)] >= n)
                mixed = h[whole] ^ (h[whole] >> np.uint64(29))
                bucket = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(width)
                out += np.bincount(owner[whole] * width + bucket.astype(np.int64), minlength=len(out))
        return out.reshape(len(texts), width)

    def features(self, texts: list[str]) -> np.ndarray:
        out = self.counts(texts).astype(np.float32)
        some = out > 0
        out[some] = 1 + np.log(out[some])
        out *= self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def encode(self, texts: list[str]) -> np.ndarray:
        v = self.features(texts) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many of ``rows(t)`` there are, and in how many of them each bucket occurs."""

    def run(batches):
        n, df = 0, np.zeros(BUCKETS, np.int64)
        raw = Encoder(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32))
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, len(batch), 500)):
                n += len(part)
                df += (raw.features(part.column(0).to_pylist()) > 0).sum(0)
        yield pa.record_batch([pa.array(np.arange(-1, BUCKETS, dtype=np.int32)), pa.array(np.concatenate([[n], df]))], ["i", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows
        out[r.i + 1] = r.n
    return int(out[0]), out[1:]


def _gram(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The products of all pairs of buckets, summed over the features of ``rows(t)``: one upper triangle a task."""

    def run(batches):
        x, out = Encoder(idf, np.zeros((BUCKETS, 1), np.float32)), np.zeros((BUCKETS, BUCKETS), np.float32)
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, len(batch), 500)):
                own = x.features(part.column(0).to_pylist())
                out += own.T @ own
        for i in range(0, BUCKETS, 64):
            yield pa.record_batch([pa.array(np.arange(i, i + 64, dtype=np.int32)), pa.array([out[j, j:] for j in range(i, i + 64)], pa.list_(pa.float32()))], ["i", "row"])

    def add(part: pa.Table) -> pa.Table:
        total = part.column("row").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64).sum(0)
        return pa.table([part.column("i").slice(0, 1), pa.array([total.astype(np.float32).tobytes()])], ["i", "row"])

    summed = rows.mapInArrow(run, "i int, row array<float>").groupBy("i").applyInArrow(add, "i int, row binary")
    out = np.zeros((BUCKETS, BUCKETS), np.float32)
    for r in summed.toLocalIterator():  # BUCKETS rows
        out[r.i, r.i :] = out[r.i :, r.i] = np.frombuffer(r.row, np.float32)
    return out


def _leading(gram: np.ndarray, dimensions: int, rounds: int = 12, spare: int = 32) -> np.ndarray:
    """The leading eigenvectors by subspace iteration, without a second matrix of the size of ``gram``."""
    q = np.random.default_rng(4).normal(size=(len(gram), min(len(gram), dimensions + spare))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(gram @ q)[0]
    values, turn = np.linalg.eigh((q.T @ (gram @ q)).astype(np.float64))
    return (q @ turn[:, np.argsort(-values)[:dimensions]].astype(np.float32)).astype(np.float64)


def fit(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> Encoder:
    """Learn from all texts. Each core makes one matrix of buckets x buckets, however large the table."""
    spark = df.sparkSession
    rows = staged(df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")), "texts").coalesce(spark.sparkContext.defaultParallelism)
    n, df_by_bucket = _frequencies(rows)
    n = max(n, 1)
    idf = (np.log((1 + n) / (1 + df_by_bucket)) + 1).astype(np.float32)
    basis = _leading(_gram(rows, idf), min(dimensions, n))
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)  # a sign that does not vary
    return Encoder(idf, basis.astype(np.float32))


def encode(df: DataFrame, encoder: Encoder, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, embedding)`` for every row with a text."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(encoder)  # buckets x dimensions numbers

    def run(batches):
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, len(batch), 500)):
                v = shared.value.encode(part.column(1).to_pylist()).astype(np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1)))
                yield pa.record_batch([part.column(0), rows], [id_col, "embedding"])

    return df.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")
