"""Judgements of answers: strict reading of graders' JSON, coverage, support, and comparisons of graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import match_text

POINTS = "judgments array<struct<point:string,verdict:string,answer_evidence:string,reason:string>>"
CLAIMS = "claims array<struct<claim:string,verdict:string,citation_ids:array<string>,evidence:array<struct<chunk_id:string,text:string>>,reason:string>>"
POINT_VERDICTS, CLAIM_VERDICTS = ("covered", "not_covered", "unknown"), ("supported", "unsupported", "unknown")


def _any(items: Column, bad) -> Column:
    return F.coalesce(F.exists(items, lambda x: F.coalesce(bad(x), F.lit(True))), F.lit(False))


def point_judgements(rows: DataFrame) -> DataFrame:
    """``(case_id, error, n_points, n_covered, coverage)`` of ``rows(case_id, raw, answer, expected)``: ``raw`` has to hold
    one judgement for each expected point, covered ones with evidence that stands in the answer. The first fault of a
    case is its ``error`` (``invalid_json``, ``no_list``, ``count``, ``field``, ``evidence``, ``points``); such a case has
    no coverage, nor has one with an unknown point."""
    parsed = rows.select("case_id", F.try_parse_json("raw").isNull().alias("broken"), F.from_json("raw", POINTS)["judgments"].alias("j"), match_text("answer").alias("a"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))
    field = _any(F.col("j"), lambda x: (F.coalesce(x["point"], F.lit("")) == "") | ~x["verdict"].isin(*POINT_VERDICTS) | x["answer_evidence"].isNull() | (F.coalesce(x["reason"], F.lit("")) == ""))
    evidence = _any(F.col("j"), lambda x: (x["verdict"] == "covered") & ((x["answer_evidence"] == "") | ~F.contains(F.col("a"), match_text(x["answer_evidence"]))))
    points = F.array_sort(F.transform("j", lambda x: x["point"])) != F.array_sort("expected")
    error = F.when(F.col("broken"), "invalid_json").when(F.col("j").isNull(), "no_list").when(F.size("j") != F.size("expected"), "count").when(field, "field").when(evidence, "evidence").when(F.coalesce(points, F.lit(True)), "points")
    judged = parsed.withColumn("error", error)
    n = lambda v: F.size(F.filter("j", lambda x: x["verdict"] == v))
    known = F.col("error").isNull() & (F.size("expected") > 0)
    return judged.select("case_id", "error", F.size("expected").alias("n_points"), F.when(F.col("error").isNull(), n("covered")).alias("n_covered"), F.when(known & (n("unknown") == 0), n("covered") / F.size("expected")).alias("coverage"))


def claim_judgements(rows: DataFrame, cited: DataFrame) -> DataFrame:
    """``(case_id, error, n_claims, n_supported, unsupported)`` of ``rows(case_id, raw, answer)`` against the cited chunks
    ``cited(case_id, chunk_id, text)``: claims have to stand in the answer, name cited chunks only, quote them, and
    supported ones need a citation and a quotation. ``unsupported`` is true if a claim is, unknown if one is unknown or
    the judgement is faulty. Quotations meet their chunks by an equi-join, so no case's context is gathered."""
    parsed = rows.select("case_id", F.try_parse_json("raw").isNull().alias("broken"), F.from_json("raw", CLAIMS)["claims"].alias("c"), match_text("answer").alias("a"))
    none = F.array().cast("array<string>")
    outside = _any(F.col("c"), lambda x: (F.coalesce(x["claim"], F.lit("")) == "") | ~F.contains(F.col("a"), match_text(x["claim"])))
    verdict = _any(F.col("c"), lambda x: ~x["verdict"].isin(*CLAIM_VERDICTS))
    bare = _any(F.col("c"), lambda x: (x["verdict"] == "supported") & ((F.size(F.coalesce(x["citation_ids"], none)) < 1) | (F.coalesce(F.size(x["evidence"]), F.lit(0)) < 1)))
    quotes = parsed.select("case_id", F.explode("c").alias("x")).select("case_id", F.explode(F.concat(F.transform(F.coalesce("x.citation_ids", none), lambda i: F.struct(i.alias("chunk_id"), F.lit("").alias("quote"))), F.coalesce(F.transform("x.evidence", lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["text"].alias("quote"))), F.array().cast("array<struct<chunk_id:string,quote:string>>")))).alias("q"))
    known = cited.select("case_id", "chunk_id", match_text("text").alias("t")).withColumn("there", F.lit(True))
    met = quotes.select("case_id", "q.*").distinct().join(known, ["case_id", "chunk_id"], "left")
    faults = met.groupBy("case_id").agg(F.bool_or(F.col("there").isNull()).alias("unknown_id"), F.bool_or(F.col("there") & ~F.contains("t", match_text("quote"))).alias("no_quote"))
    rows = parsed.join(faults, "case_id", "left")
    error = F.when(F.col("broken"), "invalid_json").when(F.col("c").isNull(), "no_list").when(outside, "claim").when(verdict, "verdict").when(F.coalesce("unknown_id", F.lit(False)), "citation").when(F.coalesce("no_quote", F.lit(False)), "quotation").when(bare, "bare")
    judged = rows.withColumn("error", error)
    n = lambda v: F.size(F.filter("c", lambda x: x["verdict"] == v))
    unsupported = F.when(F.col("error").isNotNull(), F.lit(None).cast("boolean")).when(n("unsupported") > 0, True).when(n("unknown") > 0, F.lit(None).cast("boolean")).otherwise(False)
    return judged.select("case_id", "error", F.when(F.col("error").isNull(), F.size("c")).alias("n_claims"), F.when(F.col("error").isNull(), n("supported")).alias("n_supported"), unsupported.alias("unsupported"))


def audit(cases: DataFrame, points: DataFrame, claims: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """``(case_id, coverage, unsupported, success)`` of ``cases(case_id, answerable, answered)``: an answerable case
    succeeds if it is answered, covered enough and not unsupported, unknown where either judgement is; others succeed
    without an answer."""
    rows = cases.join(points.select("case_id", "coverage"), "case_id", "left").join(claims.select("case_id", "unsupported"), "case_id", "left")
    good = (F.col("coverage") >= least_coverage) & ~F.col("unsupported")
    success = F.when(~F.col("answerable"), ~F.col("answered")).when(~F.col("answered"), False).otherwise(good)
    return rows.select("case_id", "coverage", "unsupported", success.alias("success"))


def relabelled(predictions: DataFrame, labels: DataFrame, key: str, flag: str) -> DataFrame:
    """``predictions`` with ``flag`` taken from ``labels(key, flag)`` where those have a value."""
    own = labels.select(key, F.col(flag).alias("label"))
    return predictions.join(own, key, "left").withColumn(flag, F.coalesce("label", flag)).drop("label")


def compared_coverage(rows: DataFrame) -> DataFrame:
    """One row for ``rows(case_id, answerable, lexical, semantic)``: means of both gradings over the answerable cases that
    have both, how many the second one sees higher, lower or alike, and how many it leaves unknown."""
    both = F.col("answerable") & F.col("lexical").isNotNull() & F.col("semantic").isNotNull()
    delta = F.when(both, F.round(F.col("semantic") - F.col("lexical"), 9))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(n(both).alias("n_comparable"), n(F.col("answerable") & F.col("semantic").isNull()).alias("n_unknown"), F.avg(F.when(both, F.col("lexical"))).alias("lexical_mean"), F.avg(F.when(both, F.col("semantic"))).alias("semantic_mean"), n(delta > 0).alias("n_improved"), n(delta < 0).alias("n_regressed"), n(delta == 0).alias("n_alike"))


def compared_cases(rows: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` comparable cases, those that differ before those that agree, with their ``delta``."""
    both = rows.where("answerable and lexical is not null and semantic is not null").withColumn("delta", F.round(F.col("semantic") - F.col("lexical"), 9))
    return both.orderBy(F.when(F.col("delta") != 0, 0).otherwise(1), "case_id").limit(k).select("case_id", "lexical", "semantic", "delta")


def run_states(rows: DataFrame) -> DataFrame:
    """``(status, n, n_grounded, n_success_ungrounded)`` of ``rows(status, success, grounded)``."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if("grounded").alias("n_grounded"), F.count_if(F.col("success") & ~F.coalesce("grounded", F.lit(False))).alias("n_success_ungrounded"))
