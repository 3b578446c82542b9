"""Consistent forms of whole tables, and the records that only look the same."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import forms


def consistent_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, text_col, form)``: every text in consistent form, words that several scripts could write in the text's
    own script.

    Null ids and texts give no row; an empty text has the empty form; an id's repeated rows count once (least text);
    other columns, one named ``form`` included, are ignored."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    rows = rows.groupBy("k").agg(F.min("t").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = forms.resolved_batch(batch.column(1).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], ["k", "t", "form"])

    return rows.mapInArrow(run, f"k {kind}, t string, form string").withColumnsRenamed({"k": id_col, "t": text_col})


def form_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, form_key, text_key)``: 128-bit hashes of the consistent form and of the stored text, one row per id
    (the least keys of a repeated id). Null ids and texts give no row; other columns are ignored."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            data, offsets = forms.consistent_batch(texts)
            raw, at = data.astype("<u4").tobytes(), (offsets * 4).tolist()
            keys = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at, at[1:])]
            own = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(own, pa.binary())], ["k", "form_key", "text_key"])

    keyed = rows.mapInArrow(run, f"k {kind}, form_key binary, text_key binary")
    keyed = keyed.groupBy("k").agg(F.min(F.struct("text_key", "form_key")).alias("r"))
    return keyed.select(F.col("k").alias(id_col), "r.form_key", "r.text_key")


def confusables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, token, kind, spelling, n)``: the tokens of each text whose letters mislead, how often they stand there
    and how they are spelled consistently. ``kind`` is "mixed" or "whole_script" (see ``forms.confusable_tokens``). Null
    ids and texts and texts without such tokens give no row; an id's repeated rows count once (least text)."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    rows = rows.groupBy("k").agg(F.min("t").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n = Counter(forms.confusable_tokens(text))
                at += [i] * len(n)
                found += [(*x, c) for x, c in n.items()]
            columns = zip(*found) if found else ([], [], [], [])
            token, sort, to, count = (list(c) for c in columns)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(token, pa.string()), pa.array(sort, pa.string()), pa.array(to, pa.string()), pa.array(count, pa.int32())], ["k", "token", "kind", "spelling", "n"])

    return rows.mapInArrow(run, f"k {kind}, token string, kind string, spelling string, n int").withColumnRenamed("k", id_col)


def look_groups(keys: DataFrame, id_col: str, kind_col: str) -> DataFrame:
    """``(kind_col, id_col, form_key, text_key, n_spellings)`` of the records whose form has several spellings: the
    membership by which the pairs of ``spelling_pairs`` stand for all pairs of records."""
    forms_of = keys.groupBy(kind_col, "form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi")
    some = keys.join(forms_of.select(kind_col, "form_key"), [kind_col, "form_key"], "left_semi")
    spellings = some.select(kind_col, "form_key", "text_key").distinct().groupBy(kind_col, "form_key").agg(F.count("*").alias("n_spellings"))
    return some.join(spellings, [kind_col, "form_key"]).select(kind_col, id_col, "form_key", "text_key", "n_spellings")


def spelling_pairs(keys: DataFrame, kind_col: str) -> DataFrame:
    """``(kind_col, text_a, text_b)``: pairs of spellings (the lesser key first) that have one form, however many records
    have them."""
    spellings = keys.select(kind_col, "form_key", "text_key").distinct()
    several = spellings.groupBy(kind_col, "form_key").agg(F.count("*").alias("n")).where("n > 1").select(kind_col, "form_key")
    rows = spellings.join(several, [kind_col, "form_key"], "left_semi").select(kind_col, "form_key", "text_key")
    a, b = rows.withColumnRenamed("text_key", "text_a"), rows.withColumnRenamed("text_key", "text_b")
    return a.join(b, [kind_col, "form_key"]).where("text_a < text_b").select(kind_col, "text_a", "text_b")


def same_looks(keys: DataFrame, id_col: str, kind_col: str) -> DataFrame:
    """Pairs ``(kind_col, id_a, id_b)`` of one kind whose texts differ but have one consistent form, from rows
    ``(kind_col, id_col, form_key, text_key)``: the spelling pairs spelled out, so as many rows as there are pairs of
    records. Copies of one text are no pair."""
    pairs = spelling_pairs(keys, kind_col)
    a = keys.select(kind_col, F.col(id_col).alias("x"), F.col("text_key").alias("text_a"))
    b = keys.select(kind_col, F.col(id_col).alias("y"), F.col("text_key").alias("text_b"))
    rows = pairs.join(a, [kind_col, "text_a"]).join(b, [kind_col, "text_b"])
    return rows.select(kind_col, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
