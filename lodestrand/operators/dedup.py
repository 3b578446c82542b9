"""Fingerprints and duplicate rejection of a corpus."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import length_ratio, quality_tokens
from lodestrand.session import staged


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, hi, lo)``: a 64-bit similarity hash in two halves of 32 bits. A bit is set when at least half of the
    distinct tokens have it; a text without tokens has the hash 0. Token hashes are counted in one aggregate with a
    column a bit, so no bit becomes a row."""
    tokens = docs.select(id_col, F.explode_outer(quality_tokens(text_col)).alias("token"))
    digest = F.sha2("token", 256)
    halves = tokens.select(id_col, "token", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("h"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").alias("l"))
    sums = halves.groupBy(id_col).agg(F.count("token").alias("n"), *(F.sum(F.getbit(half, F.lit(b))).alias(f"{half}{b}") for half in "hl" for b in range(32)))
    word = lambda half: sum((F.when(2 * F.col(f"{half}{b}") >= F.col("n"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(32)), F.lit(0).cast("long"))
    return sums.select(id_col, F.when(F.col("n") == 0, 0).otherwise(word("h")).cast("long").alias("hi"), F.when(F.col("n") == 0, 0).otherwise(word("l")).cast("long").alias("lo"))


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """``(id, rep)`` of ``prints(id, grp, n_chars, hi, lo)``: ids of one group with equal hashes and lengths form a class,
    which its least id stands for. All of a class are near to the same others, and to each other."""
    reps = prints.groupBy("grp", "n_chars", "hi", "lo").agg(F.min("id").alias("rep"))
    return prints.join(reps, ["grp", "n_chars", "hi", "lo"]).select("id", "rep")


def near_pairs(prints: DataFrame, distance: int = 3, least_ratio: float = 0.85) -> DataFrame:
    """``(a, b, distance)`` of the classes of ``prints(id, grp, n_chars, hi, lo)`` within a Hamming distance, by the ids
    that stand for them (``fingerprint_classes`` has the members).

    The 64 bits are cut into ``distance + 3`` bands; two hashes within the distance agree in three of them at least, so
    an equi-join on every three bands is complete. With distance 3 a key has 32 bits or so."""
    bands = distance + 3
    edges = [64 * i // bands for i in range(bands + 1)]
    mask = lambda i: ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
    keys = []
    for n, chosen in enumerate(combinations(range(bands), 3)):
        bits = sum(mask(i) for i in chosen)
        keys.append(F.xxhash64("grp", F.lit(n), F.col("hi").bitwiseAND(F.lit(bits >> 32)), F.col("lo").bitwiseAND(F.lit(bits & 0xFFFFFFFF))))
    reps = prints.groupBy("grp", "n_chars", "hi", "lo").agg(F.min("id").alias("id"))
    rows = staged(reps.select("grp", "id", "n_chars", "hi", "lo"), "prints")
    exploded = rows.select("*", F.explode(F.array(*keys)).alias("key"))
    a, b = exploded.alias("a"), exploded.alias("b")
    d = hamming(F.col("a.hi"), F.col("a.lo"), F.col("b.hi"), F.col("b.lo"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.grp") == F.col("b.grp")))
    near = met.where((d <= distance) & (length_ratio(F.col("a.n_chars"), F.col("b.n_chars")) >= least_ratio))
    return near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.cast("int").alias("distance")).distinct()


def near_rejections(prints: DataFrame, distance: int = 3, least_ratio: float = 0.85) -> DataFrame:
    """``(id, duplicate_of, distance)``: ids in order; an id falls to the first kept id that it is near to. Decided for
    classes: their members fall to the id that stands for them, or to what that one falls to."""
    reps = greedy_rejections(near_pairs(prints, distance, least_ratio))
    rows = fingerprint_classes(prints).join(reps.withColumnsRenamed({"id": "rep", "distance": "d"}), "rep", "left")
    out = rows.select("id", F.coalesce("duplicate_of", F.when(F.col("id") != F.col("rep"), F.col("rep"))).alias("duplicate_of"), F.coalesce("d", F.lit(0)).cast("int").alias("distance"))
    return out.where("duplicate_of is not null")


def greedy_rejections(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """``(id, duplicate_of, distance)``: ids in order; an id falls to the first kept id that it is near to.

    Each round settles all ids whose smaller neighbours are settled: one with a kept smaller neighbour falls, one
    without is kept. Rounds are written out; their number is the longest chain of ids that depend on each other."""
    links = staged(pairs.select("a", "b", "distance"), "links")
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    state = staged(ids.join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti").withColumn("kept", F.lit(True)), "state")
    for _ in range(rounds):
        open_ids = ids.join(state, "id", "left_anti")
        below = links.join(state.select(F.col("id").alias("a"), "kept"), "a", "left").join(open_ids.select(F.col("id").alias("b")), "b", "left_semi")
        facts = below.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("falls"), F.count_if(F.col("kept").isNull()).alias("waits"))
        settled = staged(facts.where("falls or waits = 0").select("id", (~F.col("falls")).alias("kept")), "settled")
        if settled.isEmpty():
            break
        state = staged(state.union(settled), "state")
    kept = state.where("kept").select(F.col("id").alias("a"))
    owner = links.join(kept, "a", "left_semi").join(state.where("not kept").select(F.col("id").alias("b")), "b", "left_semi")
    return owner.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "distance")).alias("m")).select("id", F.col("m.a").alias("duplicate_of"), F.col("m.distance").cast("int").alias("distance"))
