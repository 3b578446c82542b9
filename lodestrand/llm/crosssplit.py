"""Records that stand in several splits, exactly or almost.

Every record gets a similarity-hash fingerprint of 256 bits over the distinct 3-character substrings of its letters.
Fingerprints of the train side and of the other splits meet where a permuted block of their bits agrees, within one
topic (a shared relevant id, or "none"); pairs within the Hamming radius are then verified on the substrings. The
width of the blocks follows the size of the topic, so that a block holds about ``OCCUPANCY`` records however large the
topic is, and the number of blocks follows the width, so that the chance to meet stays the same. Records with equal
letters and topics form one unit; units are linked and counted, records come back through membership.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import forms
from lodestrand.llm.grams import distinct_grams, mixed
from lodestrand.session import staged

BITS = 256
NONE_TOPIC = ""
OCCUPANCY = 3  # a block holds about two to this power records of its topic
CODE = ["s0", "s1", "s2", "s3"]


def simhash(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (texts x 4 numbers of 64 bits) with the distinct 3-grams and their offsets."""
    g, at = distinct_grams(data, offsets, 3)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), 4), np.uint64)
    few, many = np.flatnonzero((sizes > 0) & (sizes < 1 << 16)), np.flatnonzero(sizes >= 1 << 16)
    lane = np.uint64(0x0001000100010001)
    for w in range(4):
        h = mixed(g, w + 1)
        if len(few):
            for bit in range(16):  # four counters of 16 bits at once
                own = (h >> np.uint64(bit)) & lane
                sums = np.add.reduceat(own, at[:-1][few])
                ends = at[1:][few]
                if len(many) or len(few) < len(sizes):  # texts in between must not count for the one before
                    total = np.concatenate([[np.uint64(0)], np.cumsum(own)])
                    sums = total[ends] - total[at[:-1][few]]
                for part in range(4):
                    ones = (sums >> np.uint64(16 * part)) & np.uint64(0xFFFF)
                    out[few, w] |= (2 * ones > sizes[few].astype(np.uint64)).astype(np.uint64) << np.uint64(16 * part + bit)
        for k in many.tolist():
            bits = np.unpackbits(h[at[k] : at[k + 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[k, w] = np.packbits(2 * bits.sum(0, dtype=np.int64) > sizes[k], bitorder="little").view(np.uint64)[0]
    return out, g, at


def bit_agreement(similarity: float) -> float:
    """The chance that a bit agrees for two sets of equal size and this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    p = 1 - bit_agreement(similarity)
    return math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p)))


def tables_for(width: int, similarity: float, recall: float) -> int:
    """How many blocks of ``width`` bits let a pair of this similarity meet with this chance."""
    return 1 if not width else math.ceil(math.log(1 - recall) / math.log(1 - bit_agreement(similarity) ** width))


def coded(df: DataFrame, id_col: str, text_col: str, split_col: str, topics_col: str) -> DataFrame:
    """One row per id: ``(k, split, topics, cls, s0..s3, grams)``. ``cls`` is a hash of the letters, equal for texts that
    differ in nothing else. Texts without three letters have no grams and take part in nothing."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(split_col).alias("split"), F.col(topics_col).alias("topics"))
    rows = rows.where("k is not null and t is not null and split is not null")
    rows = rows.groupBy("k").agg(F.min(F.struct("t", "split", "topics")).alias("r")).select("k", "r.*")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = forms.letters_batch(batch.column(1).to_pylist())
            codes, g, at = simhash(data, offsets)
            raw, ends = data.astype("<u4").tobytes(), (offsets * 4).tolist()
            cls = [xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(ends, ends[1:])]
            gram = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)))
            code = [pa.array(np.ascontiguousarray(codes[:, i]).view(np.int64)) for i in range(4)]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(cls, pa.int64()), *code, gram], ["k", "split", "topics", "cls", *CODE, "grams"])

    out = rows.mapInArrow(run, f"k {kind}, split string, topics array<string>, cls long, s0 long, s1 long, s2 long, s3 long, grams array<long>")
    return out.where("size(grams) > 0")


def block_width(n: np.ndarray) -> np.ndarray:
    """Bits in a block of a topic with ``n`` records."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1))) - OCCUPANCY, 0, 60).astype(int)


def _blocks(rows: DataFrame, similarity: float, recall: float) -> DataFrame:
    """``(block, topic, cls, train, s0..s3)``: one row for each block of a record's fingerprint."""
    names = ["block", "topic", "cls", "train", *CODE]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            width = block_width(batch.column(7).to_numpy())
            codes = np.stack([batch.column(3 + i).to_numpy().view(np.uint64) for i in range(4)], axis=1)
            topic = batch.column(0).to_numpy().view(np.uint64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                count = tables_for(w, similarity, recall)
                bits = np.unpackbits(codes[at].view(np.uint8), axis=1)
                powers = np.uint64(1) << np.arange(w, dtype=np.uint64)
                for first in range(0, count, 16):
                    tables = range(first, min(count, first + 16))
                    chosen = np.array([np.random.default_rng([w, t]).choice(BITS, w, replace=False) for t in tables], np.int64).reshape(len(tables), w)
                    value = bits[:, chosen].astype(np.uint64) @ powers if w else np.zeros((len(at), len(tables)), np.uint64)
                    block = mixed(mixed(value) ^ mixed(np.array(tables, np.uint64), 1)[None, :] ^ topic[at][:, None])
                    take = pa.array(np.repeat(at, len(tables)))
                    yield pa.record_batch([pa.array(block.reshape(-1).view(np.int64)), *(batch.column(c).take(take) for c in range(7))], names)

    return rows.select("topic", "cls", "train", *CODE, "n").mapInArrow(run, "block long, topic long, cls long, train boolean, s0 long, s1 long, s2 long, s3 long")


class CrossSplit:
    """Records of other splits whose text also stands in the train split: ``unit_links()`` and ``members``, spelled out
    by ``pairs()`` and counted by ``counts()``.

    Both have to share a topic, or both to have none (null and empty count as none). ``similarity`` is the least share
    of the distinct 3-character substrings of either that occur in both. Null ids, texts and splits take no part, nor
    do texts without three letters; an id's repeated rows count once; other columns are ignored; an empty table gives
    empty results."""

    def __init__(self, df: DataFrame, similarity: float = 0.65, id_col: str = "case_id", text_col: str = "query", split_col: str = "split", topics_col: str = "relevant_chunk_ids", train: str = "train", recall: float = 0.995) -> None:
        cases = coded(df, id_col, text_col, split_col, topics_col)
        topics = F.array_sort(F.filter(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))), lambda t: t.isNotNull()))
        cases = cases.withColumn("topics", F.when(F.size(topics) < 1, F.array(F.lit(NONE_TOPIC))).otherwise(topics)).withColumn("unit", F.xxhash64("cls", "topics"))
        cases = staged(cases.withColumn("train", F.col("split") == train), "cases")
        #: ``(k, split, train, unit)``, one row per record
        self.members = cases.select("k", "split", "train", "unit")
        units = cases.groupBy("unit", "train").agg(F.first("cls").alias("cls"), F.first("topics").alias("topics"), *(F.first(c).alias(c) for c in CODE))
        at = staged(units.select("unit", "train", "cls", *CODE, F.explode("topics").alias("t")).withColumn("topic", F.xxhash64("t")).drop("t"), "units")
        classes = at.groupBy("topic", "cls", "train").agg(*(F.first(c).alias(c) for c in CODE))
        sizes = classes.groupBy("topic").agg(F.count("*").alias("n"), F.count_if("train").alias("n_train")).where("n_train between 1 and n - 1").select("topic", "n")
        blocks = _blocks(classes.join(sizes, "topic"), similarity, recall)
        a = blocks.where("train").select("block", F.col("topic").alias("topic_a"), F.col("cls").alias("cls_a"), *(F.col(c).alias("a" + c) for c in CODE))
        b = blocks.where("not train").select("block", F.col("topic").alias("topic_b"), F.col("cls").alias("cls_b"), *(F.col(c).alias("b" + c) for c in CODE))
        apart = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in CODE), F.lit(0))
        near = a.join(b, "block").where((F.col("cls_a") != F.col("cls_b")) & (F.col("topic_a") == F.col("topic_b")) & (apart <= radius(similarity)))
        near = staged(near.select(F.col("topic_a").alias("topic"), "cls_a", "cls_b").distinct(), "near")
        wanted = near.select(F.col("cls_a").alias("cls")).union(near.select("cls_b")).distinct()
        grams = cases.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("grams").alias("grams"))
        texts = near.select("cls_a", "cls_b").distinct()
        texts = texts.join(grams.withColumnsRenamed({"cls": "cls_a", "grams": "ga"}), "cls_a").join(grams.withColumnsRenamed({"cls": "cls_b", "grams": "gb"}), "cls_b")
        both = F.size(F.array_intersect("ga", "gb"))
        alike = texts.where(both >= similarity * (F.size("ga") + F.size("gb") - both)).select("cls_a", "cls_b")
        own = classes.select("topic", F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")).distinct()
        links = near.join(alike, ["cls_a", "cls_b"]).select("topic", "cls_a", "cls_b").union(own)
        left = at.where("train").select("topic", F.col("cls").alias("cls_a"), F.col("unit").alias("train_unit"))
        right = at.where("not train").select("topic", F.col("cls").alias("cls_b"), F.col("unit").alias("other_unit"))
        self.linked = staged(links.join(left, ["topic", "cls_a"]).join(right, ["topic", "cls_b"]).select("train_unit", "other_unit").distinct(), "linked")

    def unit_links(self) -> DataFrame:
        """``(train_unit, other_unit)``: linked units, one with members in train, one with members elsewhere; a unit may
        be linked to itself."""
        return self.linked

    def pairs(self) -> DataFrame:
        """``(train_id, other_id, other_split)``, each pair once: as many rows as there are pairs of records."""
        left = self.members.where("train").select(F.col("unit").alias("train_unit"), F.col("k").alias("train_id"))
        right = self.members.where("not train").select(F.col("unit").alias("other_unit"), F.col("k").alias("other_id"), F.col("split").alias("other_split"))
        return self.linked.join(left, "train_unit").join(right, "other_unit").select("train_id", "other_id", "other_split")

    def counts(self, sources: DataFrame) -> DataFrame:
        """``(split, source, n_cases, n_pairs)``: leaked records and pairs per split and source, from the sizes of the
        units alone. ``sources(k, source)`` may have several rows a record; records without a source count under null."""
        n_train = self.members.where("train").groupBy(F.col("unit").alias("train_unit")).agg(F.count("*").alias("n"))
        leaked = self.linked.join(n_train, "train_unit").groupBy(F.col("other_unit").alias("unit")).agg(F.sum("n").alias("n"))
        others = self.members.where("not train").join(sources.where("source is not null").distinct(), "k", "left")
        per_unit = others.groupBy("unit", "split", "source").agg(F.count("*").alias("n_cases"))
        rows = per_unit.join(leaked, "unit").select("split", "source", "n_cases", (F.col("n_cases") * F.col("n")).alias("n_pairs"))
        return rows.groupBy("split", "source").agg(F.sum("n_cases").alias("n_cases"), F.sum("n_pairs").alias("n_pairs"))


def leak_counts(df: DataFrame, found: CrossSplit, id_col: str = "case_id", sources_col: str = "expected_sources") -> DataFrame:
    """``found.counts`` with the sources of ``df``: those of the greatest array of a record's rows."""
    sources = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(sources_col).alias("sources"))
    return found.counts(sources.select("k", F.explode("sources").alias("source")))
