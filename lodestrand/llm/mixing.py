"""Mixing sources to target shares of the tokens.

Soft-membership mixing: a classifier learned from labelled rows gives each document a posterior over the domains, in
which a stated source counts with ``label_trust``. Projected gradient steps then fit a rate between 0 and the permitted
repeats for every document, so that the expected tokens of each domain meet their targets. A step needs the domains'
totals only; a document's rate is recomputed from the totals of all steps so far, so no state is kept anywhere.
Rates become whole repeats by hashed dithering, with one threshold per source that balances what rounding moved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.samples import least_hashes_per_label
from lodestrand.llm.tokens import TOKENIZER, token_ids
from lodestrand.session import staged

BUCKETS = 4096
SAMPLE_ROWS = 4000
TEXT_WEIGHT = 10.0
BINS = 4096
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes over hashed token numbers of the whole text and words of the other columns."""

    domains: list[str]
    prior: np.ndarray
    text: np.ndarray  # buckets x domains
    words: np.ndarray

    def posteriors(self, ids: list[list[int]], columns: list[str], labels: list[str | None], label_trust: float) -> np.ndarray:
        score = np.tile(self.prior, (len(ids), 1)).astype(np.float64)
        for a in range(0, len(ids), 256):
            counts = _counts(ids[a : a + 256])
            score[a : a + 256] += TEXT_WEIGHT * (counts @ self.text) / np.maximum(counts.sum(1, keepdims=True), 1)
        for i, text in enumerate(columns):
            for h in _hashed(text):
                score[i] += self.words[h]
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        at = {s: j for j, s in enumerate(self.domains)}
        for i, label in enumerate(labels):
            if label in at:
                p[i] *= 1 - label_trust
                p[i, at[label]] += label_trust
            elif label is not None:  # a source without a target is no domain at all
                p[i] = 0
        return p


def _counts(ids: list[list[int]]) -> np.ndarray:
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    bucket = (flat * 2654435761 >> 7) % BUCKETS
    return np.bincount(owner * BUCKETS + bucket, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS).astype(np.float32)


def _hashed(text: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) % BUCKETS for w in set(_WORD.findall(text.lower()))]


def learn(ids: list[list[int]], columns: list[str], labels: list[str], domains: list[str], counts: dict[str, int] | None = None) -> Classifier:
    """A classifier from labelled rows; rows whose label is no domain are left out. ``counts`` are the rows of each label
    in the whole table, if ``labels`` is a sample that has them in other proportions."""
    at = {s: j for j, s in enumerate(domains)}
    n = np.zeros(len(domains))
    text, words = np.full((BUCKETS, len(domains)), 0.5), np.full((BUCKETS, len(domains)), 0.05)
    for i, label in enumerate(labels):
        if (j := at.get(label)) is not None:
            n[j] += 1
            np.add.at(text[:, j], (np.asarray(ids[i], np.int64) * 2654435761 >> 7) % BUCKETS, 1)
            words[_hashed(columns[i]), j] += 1
    held = n if counts is None else np.array([counts.get(s, 0) for s in domains], float)
    return Classifier(domains, np.log((held + 1) / (held.sum() + len(domains))), np.log(text / text.sum(0)).astype(np.float32), np.log(words / (n + 0.1)).astype(np.float32))


def _steps(post: np.ndarray, cap: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far; each step moves a document by its domains' relative residuals."""
    rate = np.zeros(len(post))
    for step in history:
        rate = np.clip(rate + post @ step, 0, cap)
    return rate


def memberships(df: DataFrame, targets: dict[str, tuple[float, int]], id_col: str, text_col: str, label_col: str, column_cols: list[str], label_trust: float, tokenizer: str, sample_rows: int) -> DataFrame:
    """``(k, label, n_tokens, post)`` for every document."""
    domains = sorted(targets)
    rows = df.select(F.col(id_col).alias("k"), F.col(label_col).alias("label"), F.coalesce(F.concat_ws(" ", *column_cols), F.lit("")).alias("c"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    labelled = rows.where(F.col("label").isin(domains)).groupBy("label").agg(F.count("*").alias("n"))
    counts = {r.label: r.n for r in labelled.collect()}  # one row a domain
    picked = least_hashes_per_label(rows, counts, sample_rows).toPandas() if counts else rows.limit(0).toPandas()
    model = learn(token_ids(picked["t"].tolist(), tokenizer), picked["c"].tolist(), picked["label"].tolist(), domains, counts)
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x domains numbers
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in (batch.slice(a, 512) for a in range(0, len(batch), 512)):
                ids = token_ids(part.column(3).to_pylist(), tokenizer)
                p = shared.value.posteriors(ids, part.column(2).to_pylist(), part.column(1).to_pylist(), label_trust).astype(np.float32)
                post = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(np.array([len(x) for x in ids], np.int64)), post], ["k", "label", "n_tokens", "post"])

    out = rows.mapInArrow(run, f"k {kind}, label string, n_tokens long, post array<float>")
    return out.groupBy("k").agg(F.min(F.struct("n_tokens", "label", "post")).alias("r")).select("k", "r.label", "r.n_tokens", "r.post")


def mix(df: DataFrame, targets_df: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", column_cols: tuple[str, ...] = ("source_path", "source_type", "lang"), label_trust: float = 0.9, tokenizer: str = TOKENIZER, sample_rows: int = SAMPLE_ROWS, steps: int = 12, tolerance: float = 1e-4) -> DataFrame:
    """``(id_col, source_col, n_tokens, rate, repeats)``: the documents of the mix, each ``repeats`` times.

    ``targets_df`` holds ``source``, ``target_share`` and ``max_repeats`` (few rows; null sources and shares that are
    not above 0 are left out). The total is ``total_tokens``, or by default all tokens of the documents that belong to a
    targeted source. A source whose repeats don't suffice for its share of the total comes with all of its documents,
    ``max_repeats`` times each, and stays below its share; the others keep theirs, so the mix is smaller than the total
    by what is short. Null ids and texts take no part; documents without a source are mixed by their posterior; sources
    without a target stay out; an id's repeated rows count once."""
    return fitted_mix(df, targets_df, total_tokens, id_col, text_col, source_col, column_cols, label_trust, tokenizer, sample_rows, steps, tolerance).documents


@dataclass(frozen=True)
class Mix:
    """A mix with what is needed to judge it."""

    documents: DataFrame  # what ``mix`` gives
    supply: dict[str, int]  # the tokens that each targeted source has
    goals: dict[str, float]  # the tokens that each was to get: its share of the total, or all its repeats if they are less
    residuals: list[dict[str, float]]  # before each step, and after the last: goal less expected tokens, of each domain
    expected: dict[str, float]  # the expected tokens of each domain at the final repeats, by the posteriors


def fitted_mix(df: DataFrame, targets_df: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", column_cols: tuple[str, ...] = ("source_path", "source_type", "lang"), label_trust: float = 0.9, tokenizer: str = TOKENIZER, sample_rows: int = SAMPLE_ROWS, steps: int = 12, tolerance: float = 1e-4, report: bool = False) -> Mix:
    """What ``mix`` gives, with its supply, goals and residuals; with ``report`` also the expected totals."""
    found = targets_df.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("s"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("m")).collect()
    targets = {r.source: (float(r.s), int(r.m)) for r in found}
    domains = sorted(targets)
    kind = df.schema[id_col].dataType.simpleString()
    if not domains:
        nothing = df.select(F.col(id_col), F.col(source_col), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("repeats")).limit(0)
        return Mix(nothing, {}, {}, [], {})
    rows = staged(memberships(df, targets, id_col, text_col, source_col, list(column_cols), label_trust, tokenizer, sample_rows), "memberships")
    share, most = np.array([targets[s][0] for s in domains]), np.array([targets[s][1] for s in domains])

    at = {s: j for j, s in enumerate(domains)}

    def own_domain(post: np.ndarray, labels: list[str | None]) -> np.ndarray:
        """The stated source's number, that of the likeliest without one, -1 for sources without a target."""
        likely = post.argmax(1) if len(post) else np.zeros(0, int)
        return np.array([likely[i] if x is None else at.get(x, -1) for i, x in enumerate(labels)], np.int64)

    def caps(own: np.ndarray) -> np.ndarray:
        return np.where(own >= 0, most[own], 0).astype(float)

    def totals(history: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Expected tokens of each domain at the present rates and at rate 1, and both of its own documents alone."""

        def run(batches):
            for batch in batches:
                if len(batch):
                    post, n = batch.column(1).flatten().to_numpy().reshape(-1, len(domains)).astype(np.float64), batch.column(0).to_numpy()
                    own = own_domain(post, batch.column(2).to_pylist())
                    rate = _steps(post, caps(own), history)
                    sums = np.concatenate([(rate * n) @ post, n @ post, *(np.bincount(own[own >= 0], x[own >= 0], len(domains)) for x in (rate * n, n))])
                    yield pa.record_batch([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["i", "x"])

        got = rows.select("n_tokens", "post", "label").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # four rows a domain
        out = np.zeros(4 * len(domains))
        for r in got:
            out[r.i] = r.x
        return tuple(out.reshape(4, -1))

    _, supply, _, held_tokens = totals([])
    total = float(total_tokens) if total_tokens is not None else float(held_tokens.sum())
    goal = share / share.sum() * total
    short = goal >= held_tokens * most
    goal = np.minimum(goal, held_tokens * most)
    history: list[np.ndarray] = []
    residuals = []
    for step in range(steps + 1):
        now, _, got, _ = totals(history)
        residuals.append(goal - now)
        if step == steps or history and np.abs(residuals[-1]).max() <= tolerance * max(total, 1):
            break
        history.append(residuals[-1] / np.maximum(supply, 1e-9))
    # the posteriors give a domain part of other sources' documents; the shares are stated by source, so its own make up for it
    scale = np.where(got > 0, goal / np.maximum(got, 1e-9), 1.0)

    def rates(batches):
        for batch in batches:
            post = batch.column(3).flatten().to_numpy().reshape(-1, len(domains)).astype(np.float64) if len(batch) else np.zeros((0, len(domains)))
            own = own_domain(post, batch.column(1).to_pylist())
            rate = np.where(short[own], caps(own), np.minimum(_steps(post, caps(own), history) * scale[own], caps(own)))
            yield pa.record_batch([*batch.columns[:3], pa.array(rate), pa.array(own.astype(np.int32))], ["k", "label", "n_tokens", "rate", "own"])

    rated = rows.mapInArrow(rates, f"k {kind}, label string, n_tokens long, rate double, own int")
    known = F.array(*map(F.lit, domains))
    rated = rated.where("own >= 0").withColumn("domain", F.element_at(known, F.col("own") + 1)).withColumn("cap", F.element_at(F.create_map(*(F.lit(x) for s in domains for x in (s, int(targets[s][1])))), F.col("domain")))
    rated = rated.withColumn("rate", F.least("rate", F.col("cap").cast("double")))
    whole = F.floor(F.col("rate") + 1e-6).cast("int")
    part = F.greatest(F.col("rate") - whole, F.lit(0.0))
    place = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    # documents of a source come in the order of a hash over their fraction, so a higher threshold takes more of them
    rated = rated.withColumn("whole", F.least(whole, "cap")).withColumn("order", F.when((part > 1e-6) & (F.col("whole") < F.col("cap")), F.least(place / part / (1 + place / part), F.lit(0.999999))))
    rated = staged(rated.withColumn("bin", F.floor(F.col("order") * BINS).cast("int")), "rated")
    held = rated.groupBy("domain", "bin").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("whole")).alias("w")).collect()  # at most BINS + 1 rows a domain
    cut = {}
    for j, s in enumerate(domains):
        own = [r for r in held if r.domain == s]
        need = goal[j] - sum(r.w for r in own)
        bins = sorted((r.bin, r.n) for r in own if r.bin is not None)
        taken = np.concatenate([[0], np.cumsum([x for _, x in bins])])
        best = int(np.abs(taken - need).argmin())
        cut[s] = bins[best - 1][0] + 1 if best else 0
    threshold = F.element_at(F.create_map(*(F.lit(x) for s in domains for x in (s, int(cut[s])))), F.col("domain"))
    repeats = F.col("whole") + F.when(F.col("bin") < threshold, 1).otherwise(0)
    out = rated.withColumn("repeats", repeats.cast("int")).where("repeats > 0")

    def expected(batches):
        for batch in batches:
            if len(batch):
                post = batch.column(1).flatten().to_numpy().reshape(-1, len(domains)).astype(np.float64)
                yield pa.record_batch([pa.array(np.arange(len(domains), dtype=np.int32)), pa.array(batch.column(0).to_numpy().astype(np.float64) @ post)], ["i", "x"])

    taken = out.select("k", (F.col("n_tokens") * F.col("repeats")).alias("n")).join(rows.select("k", "post"), "k")
    sums = taken.select("n", "post").mapInArrow(expected, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")) if report else None
    by_domain = {r.i: r.x for r in sums.collect()} if report else {}  # one row a domain
    named = lambda x: {s: float(x[j]) for j, s in enumerate(domains)}
    documents = out.select(F.col("k").alias(id_col), F.col("domain").alias(source_col), "n_tokens", "rate", "repeats")
    return Mix(documents, {s: round(held_tokens[j]) for j, s in enumerate(domains)}, named(goal), [named(r) for r in residuals], {s: by_domain.get(j, 0.0) for j, s in enumerate(domains)} if report else {})


def fit_report(spark: SparkSession, found: Mix) -> DataFrame:
    """``(step, source, residual_share)``: what each domain lacked of its goal, as a part of all goals, before each step
    and after the last one."""
    total = max(1.0, sum(found.goals.values()))
    rows = [(step, s, x / total) for step, of in enumerate(found.residuals) for s, x in of.items()]
    return spark.createDataFrame(rows, "step int, source string, residual_share double")


def shares(found: Mix, targets_df: DataFrame, source_col: str = "source") -> DataFrame:
    """What each source got: ``(source_col, target_share, max_repeats, n_docs, n_tokens, actual_share, most_repeats,
    n_source_tokens, used_share, corpus_used_share, goal_tokens, expected_tokens, expected_share, residual_tokens)``.

    ``used_share`` is the part of the source's tokens that is in the mix, however often, ``corpus_used_share`` the same
    over all targeted sources; ``expected_tokens`` are the domain's by the posteriors of all documents in the mix (null
    unless the mix was made with ``report``), ``residual_tokens`` the goal less the tokens that the source got."""
    own = found.documents.groupBy(source_col).agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"), F.sum("n_tokens").alias("once"))
    whole = own.agg(F.sum("n_tokens").alias("total"), F.sum("once").alias("once_total"))
    goal = targets_df.where("source is not null").select(F.col("source").alias(source_col), "target_share", "max_repeats")
    rows = goal.join(own, source_col, "left").join(F.broadcast(whole))  # one row
    of = lambda d: F.try_element_at(F.create_map(*(F.lit(x) for pair in d.items() for x in pair)) if d else F.create_map().cast("map<string,double>"), F.col(source_col))
    zero = F.lit(0).cast("long")
    n, has = F.coalesce("n_tokens", zero), F.coalesce(of(found.supply).cast("long"), zero)
    expected = of(found.expected).cast("double")
    return rows.select(
        source_col, "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"), n.alias("n_tokens"), F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), has.alias("n_source_tokens"), F.when(has > 0, F.coalesce("once", zero) / has).otherwise(0.0).alias("used_share"),
        F.coalesce(F.col("once_total") / F.lit(max(1, sum(found.supply.values()))), F.lit(0.0)).alias("corpus_used_share"), F.coalesce(of(found.goals).cast("double"), F.lit(0.0)).alias("goal_tokens"),
        expected.alias("expected_tokens"), (expected / F.col("total")).alias("expected_share"), (F.coalesce(of(found.goals).cast("double"), F.lit(0.0)) - n).alias("residual_tokens"),
    )
