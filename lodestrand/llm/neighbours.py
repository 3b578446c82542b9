"""The k most similar vectors of every vector, by learned partitions.

On a bounded sample the neighbour graph is built exactly and cut into balanced parts that keep neighbours together; a
small softmax classifier then learns, for a vector, how its neighbours spread over the parts. Parts that hold many times
``rows_per_part`` vectors are parted again, each by a sample and a classifier of its own, fitted on the executors, so
parts keep their size as the collection grows. Every vector is indexed in its most probable part and looks for
neighbours in its most probable ones, as many as it takes to reach ``mass`` of the probability, at most ``probes``;
candidates are compared exactly there. Equal vectors form one class and are compared once. A crowded part is compared in
blocks, so it is spread over many tasks and nothing is left out. A vector is stored once and sent once to each part that
it is looked up in, in half precision where that holds its numbers exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import dropped, shuffle_partitions, staged


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds what the parts of a group, and of a part that is parted again, are learned from; all
    vectors are indexed. The models hold ``sample_rows / least_sample_per_part`` parts at most, each again so many."""

    k: int = 10
    dimensions: int = 64
    sample_rows: int = 16_000
    rows_per_part: int = 2_048
    least_sample_per_part: int = 32
    probes: int = 4
    mass: float = 0.98
    block_rows: int = 8_192
    graph_degree: int = 10
    epochs: int = 12


@dataclass(frozen=True)
class Router:
    weights: np.ndarray  # dimensions x parts
    bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


FINE = 1 << 16  # a part's number is that of its coarse part times this, plus its own


def route(x: np.ndarray, coarse: Router, fine: dict[int, Router], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, parts and ranks: the parts in which each vector is looked up, the most probable first."""
    rows, parts, share = _likeliest(np.arange(len(x)), coarse.probabilities(x), s)
    out = [(rows, parts * FINE, share)]
    if fine:
        known = np.isin(parts, np.fromiter(fine, np.int64))
        out = [(rows[~known], parts[~known] * FINE, share[~known])]
        for part in np.unique(parts[known]).tolist():
            at = np.flatnonzero(parts == part)
            r, sub, p = _likeliest(at, fine[part].probabilities(x[rows[at]]), s)
            out.append((rows[r], part * FINE + sub, share[r] * p))
    rows, parts, share = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((parts, -share, rows))
    rows, parts, share = rows[order], parts[order], share[order]
    first = np.searchsorted(rows, rows)
    rank = np.arange(len(rows)) - first
    before = np.cumsum(share) - share
    keep = (rank < s.probes) & (before - before[first] < s.mass)
    return rows[keep], parts[keep], rank[keep]


def _likeliest(rows: np.ndarray, p: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most probable columns of each row of ``p`` that reach the mass, at most ``probes`` of them."""
    most = min(s.probes, p.shape[1])
    top = np.argpartition(-p, most - 1, axis=1)[:, :most] if most < p.shape[1] else np.tile(np.arange(most), (len(p), 1))
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(p, top, 1), axis=1, kind="stable"), 1)
    share = np.take_along_axis(p, top, 1)
    keep = np.cumsum(share, axis=1) - share < s.mass
    return np.repeat(rows, keep.sum(1)), top[keep], share[keep].astype(np.float64)


def exact_neighbours(queries: np.ndarray, rows: np.ndarray, k: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and cosines of the ``k`` best rows for each query (unit vectors), best first."""
    k = min(k, len(rows))
    at, score = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), np.float32)
    for a in range(0, len(queries), block):
        s = queries[a : a + block] @ rows.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(rows) else np.tile(np.arange(k), (len(s), 1))
        own = np.take_along_axis(s, top, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        at[a : a + block], score[a : a + block] = np.take_along_axis(top, order, 1), np.take_along_axis(own, order, 1)
    return at, score


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 10, slack: float = 1.1) -> np.ndarray:
    """Cut a neighbour graph into parts of about equal size: halves along principal directions first, then moves of
    vectors to the part where most of their neighbours are, the keenest first and only into free places."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        label[rows] = first
        if n == 1 or len(rows) < 2:
            continue
        own = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = rows[np.argsort(own @ direction, kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    most = math.ceil(slack * len(x) / parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        rows = np.repeat(np.arange(len(x)), neighbours.shape[1])
        np.add.at(votes, (rows, label[neighbours.reshape(-1)]), 1)
        np.add.at(votes, (neighbours.reshape(-1), label[rows]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        if not len(movers):
            break
        free = most - np.bincount(label, minlength=parts)
        target = best[movers]
        order = np.argsort(target, kind="stable")
        place = np.empty(len(movers), np.int64)
        place[order] = np.arange(len(movers)) - np.searchsorted(target[order], target[order])
        moved = movers[place < free[target]]
        label[moved] = best[moved]
    return label


def learn(sample: np.ndarray, parts: int, s: Settings) -> Router:
    """A router learned from a sample of unit vectors; one part needs no learning."""
    if parts < 2 or len(sample) < 2 * parts:
        return Router(np.zeros((s.dimensions, 1), np.float32), np.zeros(1, np.float32))
    near, _ = exact_neighbours(sample, sample, s.graph_degree + 1, block=256)
    label = balanced_parts(sample, near[:, 1:], parts)
    target = np.zeros((len(sample), parts), np.float32)  # where a vector and its neighbours are
    np.add.at(target, (np.repeat(np.arange(len(sample)), near.shape[1]), label[near.reshape(-1)]), 1 / near.shape[1])
    rng = np.random.default_rng(6)
    w = np.stack([sample[label == p].mean(0) if (label == p).any() else np.zeros(s.dimensions) for p in range(parts)], axis=1).astype(np.float32) * 10
    b = np.zeros(parts, np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    step = 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(sample))
        for a in range(0, len(sample), 512):
            step += 1
            x, y = sample[order[a : a + 512]], target[order[a : a + 512]]
            z = x @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            z = z / z.sum(1, keepdims=True) - y
            for value, grad, m, v in ((w, x.T @ z / len(x), moments[0], moments[1]), (b, z.mean(0), moments[2], moments[3])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= 0.3 * 0.85**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Router(w.astype(np.float32), b.astype(np.float32))


def packed_rows(df: DataFrame, id_col: str, group_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """``(grp, k, cls, v)``: each vector as bytes of its floats, 16 bits wide if that loses nothing and 32 otherwise, and
    a hash of its unit vector; one row per group and id (the least of several)."""
    rows = df.select(F.col(group_col).alias("grp"), F.col(id_col).alias("k"), F.col(vector_col).cast("array<float>").alias("x"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("k").isNotNull() & (F.size("x") == dimensions) & F.forall("x", lambda e: e.isNotNull()))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("grp", "k")]

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimensions)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            x = x[good]
            with np.errstate(over="ignore"):
                half = x.astype(np.float16)
            fits = (half.astype(np.float32) == x).all(1)
            width = np.where(fits, 2, 4) * dimensions
            data = np.zeros(int(width.sum()), np.uint8)
            ends = np.concatenate([[0], np.cumsum(width)])
            for own, values in ((fits, half), (~fits, x)):
                if own.any():
                    size = values.itemsize * dimensions
                    data[(ends[:-1][own][:, None] + np.arange(size)).reshape(-1)] = values[own].view(np.uint8).reshape(-1)
            v = pa.BinaryArray.from_buffers(pa.binary(), len(good), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            unit = (x / norm[good, None]).astype(np.float32)
            cls = np.array([xxhash.xxh3_64_intdigest(u) for u in unit], np.uint64).view(np.int64)
            take = pa.array(good)
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(cls), v], ["grp", "k", "cls", "v"])

    out = rows.mapInArrow(run, f"grp {kinds[0]}, k {kinds[1]}, cls long, v binary")
    return out.groupBy("grp", "k").agg(F.min(F.struct("v", "cls")).alias("r")).select("grp", "k", "r.cls", "r.v")


def units(column, dimensions: int) -> np.ndarray:
    """Unit vectors from the bytes of ``packed_rows``."""
    raw = column.to_pylist()
    x = np.zeros((len(raw), dimensions), np.float32)
    half = np.fromiter((len(r) == 2 * dimensions for r in raw), bool, len(raw))
    for own, kind in ((half, np.float16), (~half, np.float32)):
        if own.any():
            x[own] = np.frombuffer(b"".join(r for r, o in zip(raw, own) if o), kind).reshape(-1, dimensions)
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))).astype(np.float32)


def _least(rows: DataFrame, keys: list[str], sizes: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each group with a row in ``sizes(*keys, n)``, those whose class has the least hash. Hashes
    are even, so a bound on them keeps enough and spares the sort of all."""
    bound = F.least(F.lit(1.0), 1.2 * most / F.col("n")) * (1 << 20)
    near = rows.join(F.broadcast(sizes), keys).where(F.pmod("cls", F.lit(1 << 20)) <= bound)  # one row a group or part
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("cls"), "cls")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)


def fit(classes: DataFrame, s: Settings) -> tuple[dict, dict]:
    """A router for each group, and one for each of its parts that is parted again, from bounded samples."""
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n"))
    samples: dict = {}
    for r in _least(classes, ["grp"], sizes, s.sample_rows).select("grp", "n", "v").toArrow().group_by("grp").aggregate([("v", "list"), ("n", "max")]).to_pylist():
        samples[r["grp"]] = (r["n_max"], r["v_list"])  # sample_rows vectors a group
    coarse = {}
    for grp in sorted(samples):
        n, v = samples[grp]
        x = units(pa.array(v, pa.binary()), s.dimensions)
        coarse[grp] = learn(x, max(1, min(n // s.rows_per_part, len(x) // s.least_sample_per_part)), s)
    if all(n < 2 * s.rows_per_part * len(coarse[grp].bias) for grp, (n, _) in samples.items()):
        return coarse, {}  # no part can be large on average
    shared = classes.sparkSession.sparkContext.broadcast(coarse)
    kind = classes.schema["grp"].dataType.simpleString()

    def home(batches):
        for batch in batches:
            x, groups = units(batch.column(2), s.dimensions), batch.column(0).to_pylist()
            part = np.zeros(len(x), np.int32)
            for grp in dict.fromkeys(groups):
                own = np.flatnonzero(np.array([g == grp for g in groups]))
                part[own] = shared.value[grp].probabilities(x[own]).argmax(1)
            yield pa.record_batch([*batch.columns, pa.array(part)], ["grp", "cls", "v", "part"])

    placed = staged(classes.select("grp", "cls", "v").mapInArrow(home, f"grp {kind}, cls long, v binary, part int"), "placed")
    large = placed.groupBy("grp", "part").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * s.rows_per_part)

    def learned(table: pa.Table) -> pa.Table:
        x = units(table.column("v"), s.dimensions)
        n = table.column("n")[0].as_py()
        router = learn(x, max(1, min(n // s.rows_per_part, len(x) // s.least_sample_per_part)), s)
        return pa.table([table.column("grp").slice(0, 1), table.column("part").slice(0, 1), pa.array([router.weights.tobytes()]), pa.array([router.bias.tobytes()])], ["grp", "part", "w", "b"])

    rows = _least(placed, ["grp", "part"], large, s.sample_rows).select("grp", "part", "n", "v")
    fine: dict = {}
    for r in rows.groupBy("grp", "part").applyInArrow(learned, f"grp {kind}, part int, w binary, b binary").toArrow().to_pylist():
        w, b = np.frombuffer(r["w"], np.float32), np.frombuffer(r["b"], np.float32)
        fine.setdefault(r["grp"], {})[r["part"]] = Router(w.reshape(s.dimensions, -1), b)
    dropped(placed)
    return coarse, fine


def neighbours(df: DataFrame, id_col: str = "chunk_id", group_col: str = "embedding_version", vector_col: str = "embedding", least_cosine: float = -1.0, settings: Settings | None = None) -> DataFrame:
    """``(group_col, id_col, neighbour_id, cosine, rank)``: the ``k`` most similar vectors of other ids of one group.

    Vectors that are null, of another length, all zero or not finite, and null ids and groups take no part; an id's
    repeated rows count once a group; ties go to the smaller id; ``least_cosine`` drops less similar neighbours; other
    columns are ignored; groups are few (each has a model of its own)."""
    s = settings or Settings()
    rows = staged(packed_rows(df, id_col, group_col, vector_col, s.dimensions), "vectors")
    classes = rows.groupBy("grp", "cls").agg(F.min("v").alias("v"))
    shared = df.sparkSession.sparkContext.broadcast(fit(classes, s))  # bounded by the settings
    grp_kind, id_kind = (rows.schema[c].dataType.simpleString() for c in ("grp", "k"))

    def routed(batches):
        coarse, fine = shared.value
        for batch in batches:
            x, groups = units(batch.column(2), s.dimensions), batch.column(0).to_pylist()
            found = []
            for grp in dict.fromkeys(groups):
                own = np.flatnonzero(np.array([g == grp for g in groups]))
                at, part, _ = route(x[own], coarse[grp], fine.get(grp, {}), s)
                found.append((own[at], part))
            at, part = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(batch) + 1)).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(part[order].astype(np.int32)))
            yield pa.record_batch([*batch.columns, parts], ["grp", "cls", "v", "parts"])

    placed = staged(classes.select("grp", "cls", "v").mapInArrow(routed, f"grp {grp_kind}, cls long, v binary, parts array<int>"), "routed")
    looks = placed.select("grp", "cls", F.posexplode("parts").alias("rank", "part"))
    sizes = looks.groupBy("grp", "part").agg(F.count_if(F.col("rank") == 0).alias("n"), F.count("*").alias("q")).where("n > 0")
    blocks = staged(sizes.select("grp", "part", F.ceil(F.col("n") / s.block_rows).cast("int").alias("bi"), F.ceil(F.col("q") / (4 * s.block_rows)).cast("int").alias("bj")), "blocks")
    each = placed.select("grp", "cls", "v", F.posexplode("parts").alias("rank", "part")).join(blocks, ["grp", "part"])
    each = each.withColumn("own_i", F.pmod("cls", "bi").cast("int")).withColumn("own_j", F.pmod(F.xxhash64("cls"), "bj").cast("int"))
    # a row comes once to each block of indexed vectors that it is compared with; indexed itself, it stands in its own
    query = each.select("grp", "part", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("i"), F.col("own_j").alias("j"), "cls", "v", "rank", "own_i")
    query = query.select("grp", "part", "i", "j", "cls", "v", F.lit(True).alias("asks"), ((F.col("rank") == 0) & (F.col("i") == F.col("own_i"))).alias("indexed"))
    more = each.where("rank = 0 and bj > 1").select("grp", "part", F.col("own_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("bj") - 1)).alias("j"), "cls", "v", "own_j")
    more = more.where("j <> own_j").select("grp", "part", "i", "j", "cls", "v", F.lit(False).alias("asks"), F.lit(True).alias("indexed"))
    key = ["grp", "part", "i", "j"]

    def compare(table: pa.Table) -> pa.Table:
        names, kind = ["grp", "cls", "found", "cosine"], pa.list_(pa.int64())
        table = table.combine_chunks()
        asks, indexed = (table.column(c).to_numpy() for c in ("asks", "indexed"))
        if not asks.any() or not indexed.any():
            return pa.table([table.column("grp").slice(0, 0), pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.list_(pa.float64()))], names)
        cls, x = table.column("cls").to_numpy(), units(table.column("v"), s.dimensions)
        ids, rows, own, q = cls[indexed], x[indexed], cls[asks], x[asks]
        at, _ = exact_neighbours(q, rows, s.k + 1)
        cosine = np.einsum("qd,qkd->qk", q.astype(np.float64), rows[at].astype(np.float64))
        keep = (ids[at] != own[:, None]) & (cosine >= least_cosine)
        some = np.flatnonzero(keep.any(1))
        ends = pa.array(np.concatenate([[0], np.cumsum(keep[some].sum(1))]).astype(np.int32))
        grp = table.column("grp").take(pa.array(np.flatnonzero(asks)[some])).combine_chunks()
        return pa.table([grp, pa.array(own[some]), pa.ListArray.from_arrays(ends, pa.array(ids[at][some][keep[some]])), pa.ListArray.from_arrays(ends, pa.array(cosine[some][keep[some]]))], names)

    meeting = query.union(more).repartition(4 * shuffle_partitions(df.sparkSession), *key)
    found = meeting.groupBy(*key).applyInArrow(compare, f"grp {grp_kind}, cls long, found array<long>, cosine array<double>")
    best = Window.partitionBy("grp", "cls").orderBy(F.desc("cosine"), "other")
    near = found.select("grp", "cls", F.inline(F.arrays_zip(F.col("found").alias("other"), F.col("cosine").alias("cosine")))).withColumn("r", F.row_number().over(best)).where(F.col("r") <= s.k).drop("r")
    # ids again: at most k + 1 of a class can be among anyone's k best, its least ones
    rank_in = Window.partitionBy("grp", "cls").orderBy("k")
    few = rows.select("grp", "cls", "k").withColumn("c", F.row_number().over(rank_in)).where(F.col("c") <= s.k + 1).select("grp", F.col("cls").alias("other"), F.col("k").alias("neighbour"))
    copies = few.groupBy("grp", "other").agg(F.count("*").alias("n")).where("n > 1").select("grp", F.col("other").alias("cls"), "other", F.lit(1.0).alias("cosine"))
    all_near = near.union(copies.select(near.columns))
    own = rows.select("grp", "cls", "k")
    pairs = own.join(all_near, ["grp", "cls"]).join(few, ["grp", "other"]).where("k <> neighbour")
    order = Window.partitionBy("grp", "k").orderBy(F.desc("cosine"), "neighbour")
    out = pairs.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= s.k) & (F.col("cosine") >= least_cosine))
    return out.select(F.col("grp").alias(group_col), F.col("k").alias(id_col), F.col("neighbour").alias("neighbour_id"), "cosine", "rank")
