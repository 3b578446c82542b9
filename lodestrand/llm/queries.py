"""Queries of the training-data operators, over whole tables with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import crosssplit, garbled, lines, looks, mixing, neardup, neighbours, packing, sentences, splitting
from lodestrand.session import staged, table

LIMIT, OVERLAP = 420, 60


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "chunks"), LIMIT, OVERLAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0 and n_pieces > 1").select("chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = crosssplit.CrossSplit(table(spark, d, "eval_cases"), 0.65).pairs()
    return pairs.select(F.least("train_id", "other_id").alias("case_id_a"), F.greatest("train_id", "other_id").alias("case_id_b"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases")
    return crosssplit.leak_counts(cases, crosssplit.CrossSplit(cases, 0.65))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "chunks"), 0.7).pairs()


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "chunks"), 0.7).links()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "chunks"), 0.7).groups()


def _form_keys(spark: SparkSession, d: str) -> DataFrame:
    chunks = looks.form_keys(table(spark, d, "chunks"), "chunk_id", "text").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("id"), "form_key", "text_key")
    cases = looks.form_keys(table(spark, d, "eval_cases"), "case_id", "query").select(F.lit("query").alias("record_kind"), F.col("case_id").alias("id"), "form_key", "text_key")
    return staged(chunks.union(cases), "forms")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.same_looks(_form_keys(spark, d), "id", "record_kind")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_groups(_form_keys(spark, d), "id", "record_kind")


def p5_confusables(spark: SparkSession, d: str) -> DataFrame:
    chunks = looks.confusables(table(spark, d, "chunks"), "chunk_id", "text").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("id"), "token", "kind", "spelling", "n")
    cases = looks.confusables(table(spark, d, "eval_cases"), "case_id", "query").select(F.lit("query").alias("record_kind"), F.col("case_id").alias("id"), "token", "kind", "spelling", "n")
    return chunks.union(cases)


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    chunks = looks.consistent_forms(table(spark, d, "chunks"), "chunk_id", "text").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("id"), "form")
    cases = looks.consistent_forms(table(spark, d, "eval_cases"), "case_id", "query").select(F.lit("query").alias("record_kind"), F.col("case_id").alias("id"), "form")
    return chunks.union(cases)


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "chunk_vectors"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.neighbours(table(spark, d, "chunk_vectors"), least_cosine=0.9)
    return near.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).distinct()


def _collected_day() -> F.Column:
    stamp = F.try_element_at("metadata", F.lit("collected_at"))
    tries = [F.try_to_timestamp(stamp, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd[ HH:mm:ss]", "yyyy/MM/dd[ HH:mm:ss]", "dd.MM.yyyy[ HH:mm:ss]")]
    seconds = F.timestamp_seconds(stamp.try_cast("double"))
    return F.coalesce(*(F.to_date(t) for t in tries), F.to_date(seconds)).cast("string")


def _chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return staged(lines.keyed_lines(table(spark, d, "chunks"), "chunk_id", "source_type", "text", _collected_day()), "lines")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _chunk_lines(spark, d)
    return lines.found_lines(docs, lines.repeated_lines(docs)).select(F.col("k").alias("chunk_id"), "line_no")


def p7_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_chunk_lines(spark, d)).withColumnRenamed("source", "source_type")


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = _chunk_lines(spark, d)
    return lines.without_lines(table(spark, d, "chunks"), lines.found_lines(docs, lines.repeated_lines(docs)), "chunk_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_containers(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.fitted_mix(table(spark, d, "documents"), targets, report=True), targets)


def p9_fit(spark: SparkSession, d: str) -> DataFrame:
    return mixing.fit_report(spark, mixing.fitted_mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from lodestrand.llm import oracle

    return oracle.SQL
