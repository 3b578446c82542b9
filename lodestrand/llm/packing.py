"""Filling containers of fixed capacity with whole documents.

Bound-certified repacking: documents are dealt evenly to partitions, each partition is packed by best-fit decreasing,
and lower bounds from dual feasible functions certify its number of containers. Partitions whose number lies above
their bound keep their full containers and exchange the documents of the others among each other; these are packed
again, and the new packing counts if it takes fewer containers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.tokens import TOKENIZER, token_counts
from lodestrand.session import shuffle_partitions, staged

ITEMS_PER_PARTITION = 20_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item. Items are taken by falling size (ties in their order); each goes into the
    fullest container that has room. Open containers lie in stacks by room; one bit a room tells which are not empty."""
    out = np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            number = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, number = capacity, count
            count += 1
        out[i] = number
        left = room - size
        stacks[left].append(number)
        rooms |= 1 << left
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of containers that three families of dual feasible functions give."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // capacity)
    tail, weight = np.concatenate([np.cumsum(n[::-1])[::-1], [0]]), np.concatenate([np.cumsum((n * x)[::-1])[::-1], [0]])
    eps = np.arange(1, capacity // 2 + 1)
    # items too large to meet one of at least eps fill a container; smaller ones than eps count nothing
    whole = tail[capacity - eps + 1]
    between = weight[eps] - weight[capacity - eps + 1]
    best = max(best, int((whole + -(-between // capacity)).max()))
    for k in range(1, 21):  # staircase functions: k + 1 steps, with the exact multiples kept
        up = (k + 1) * x
        value = np.where(up % capacity == 0, x * k, (up // capacity) * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    for parts in range(2, 41):  # items above half: what is left to parts of eps; others from eps on: one part
        e = capacity / parts
        value = np.where(2 * x > capacity, parts - np.floor((capacity - x) / e + 1e-9), np.where(x >= e, 1, 0))
        best = max(best, int(np.ceil((n * value).sum() / parts - 1e-9)))
    return best


def pieces_of(df: DataFrame, capacity: int, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(k, piece, n_pieces, first_token, size)``: whole documents, and those above the capacity cut into the fewest
    pieces, all but the last full."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(token_counts(batch.column(1).to_pylist(), tokenizer))], ["k", "n"])

    sized = rows.mapInArrow(run, f"k {kind}, n long").groupBy("k").agg(F.min("n").alias("n"))
    cut = sized.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int"))
    cut = cut.select("k", "n", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    first = (F.col("piece").cast("long") * capacity).alias("first_token")
    return cut.select("k", "piece", "n_pieces", first, F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """Pack each ``part``: adds ``bin``, ``fill``, and the part's ``n_bins`` and ``bound``."""
    names = [f.name for f in items.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("k", "ascending"), ("piece", "ascending")]).combine_chunks()
        sizes = table.column("size").to_numpy().astype(np.int64)
        number = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(number, sizes).astype(np.int32)[number]
        n = len(table)
        extra = [pa.array(number.astype(np.int32)), pa.array(fill), pa.array(np.full(n, number.max(initial=-1) + 1, np.int32)), pa.array(np.full(n, lower_bound(sizes, capacity), np.int32))]
        return pa.table([*(table.column(c) for c in names), *extra], [*names, "bin", "fill", "n_bins", "bound"])

    return items.groupBy("part").applyInArrow(pack, f"{schema}, bin int, fill int, n_bins int, bound int")


def fill_containers(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, rounds: int = 3, items_per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """``(container_id, id_col, piece_no, n_pieces, first_token, n_tokens, fill, certified, partition, above_bound)``: one
    row per document, or per piece of a document that exceeds the capacity alone.

    ``certified`` tells that the container is full or its partition uses no more containers than its lower bound;
    ``above_bound`` is how many more the partition uses, 0 for certified containers. Null ids and
    texts give no row; a text without tokens is put somewhere at size 0; an id's repeated rows count once (the fewest
    tokens); other columns are ignored; the same table gives the same containers."""
    items = staged(pieces_of(df, capacity, id_col, text_col, tokenizer), "sizes")
    full = items.where(F.col("size") == capacity)
    rest = items.where(F.col("size") < capacity)
    n = rest.count()
    deal = lambda rows, count, salt: rows.withColumn("part", F.pmod(F.xxhash64(F.col("k").cast("string"), "piece", F.lit(salt)), F.lit(max(1, -(-count // items_per_partition)))).cast("int"))
    spread = lambda rows: rows.repartition(shuffle_partitions(df.sparkSession), "part")
    packed = staged(_packed(spread(deal(rest, n, 0)), capacity), "packed").withColumn("round", F.lit(0))
    done = []
    base = [f.name for f in rest.schema]
    for r in range(1, rounds + 1):
        gap = packed.where("n_bins > bound")
        open_rows = gap.where(F.col("fill") < capacity)
        loose = open_rows.select(*base)
        count = loose.count()
        if not count:
            break
        again = staged(_packed(spread(deal(loose, count, r)), capacity), "packed").withColumn("round", F.lit(r))
        bins = lambda rows: rows.select("part", "bin").distinct().count()
        if bins(again) >= bins(open_rows):
            break
        done.append(packed.where((F.col("n_bins") <= F.col("bound")) | (F.col("fill") >= capacity)))
        packed = again
    done.append(packed)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    name = F.concat_ws("-", F.lit("r"), "round", "part", "bin")
    columns = lambda container, fill, certified, partition, above: [container.alias("container_id"), F.col("k").alias(id_col), F.col("piece").alias("piece_no"), "n_pieces", "first_token", F.col("size").alias("n_tokens"), fill.alias("fill"), certified.alias("certified"), partition.alias("partition"), above.cast("int").alias("above_bound")]
    whole = full.select(*columns(F.concat_ws("-", F.lit("w"), F.col("k").cast("string"), "piece"), F.col("size"), F.lit(True), F.lit("w"), F.lit(0)))
    sure = (F.col("n_bins") <= F.col("bound")) | (F.col("fill") >= capacity)
    above = F.when(sure, 0).otherwise(F.col("n_bins") - F.col("bound"))
    return out.select(*columns(name, F.col("fill"), sure, F.concat_ws("-", F.lit("r"), "round", "part"), above)).union(whole)


def packing_report(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(n_containers, n_rows, n_tokens, least_containers, unused_share, n_uncertified, above_bound)``;
    ``least_containers`` is what the tokens alone need, ``n_uncertified`` counts the containers without a certificate and
    ``above_bound`` by how many their partitions exceed their bounds."""
    open_parts = containers.where("not certified").groupBy("partition").agg(F.max("above_bound").alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("above_bound"))
    total = containers.agg(F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count_distinct(F.when(~F.col("certified"), F.col("container_id"))).alias("n_uncertified"))
    unused = (1 - F.col("n_tokens") / F.nullif(F.col("n_containers") * capacity, F.lit(0))).alias("unused_share")
    return total.crossJoin(open_parts).select("n_containers", "n_rows", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), unused, "n_uncertified", "above_bound")  # one row each
