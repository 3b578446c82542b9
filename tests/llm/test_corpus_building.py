import random
from collections import Counter

import numpy as np
import pytest

from lodestrand.llm import garbled, mixing, packing, samples, tokens


def test_packing_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(10, 200))
        sizes = rng.integers(0, capacity + 1, int(rng.integers(0, 120)))
        bins = packing.best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, sizes) if len(sizes) else np.zeros(0)
        assert (fill <= capacity).all()
        assert packing.lower_bound(sizes, capacity) <= (bins.max() + 1 if len(sizes) else 0)
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([], int), 100) == 0


def naive_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_best_fit_equals_naive():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        assert packing.best_fit_decreasing(np.array(sizes), 100).max() + 1 == naive_best_fit(sizes, 100)


def test_containers(spark):
    rng = random.Random(1)
    texts = {i: "word " * rng.randint(1, 90) for i in range(200)} | {900: "long text " * 900, 901: "", 902: "x"}
    rows = [(k, t, "clash") for k, t in texts.items()] + [(5, texts[5], ""), (903, None, ""), (None, "x", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fill string")
    got = packing.fill_containers(df, 128, items_per_partition=60).collect()
    size = dict(zip(texts, tokens.token_counts(list(texts.values()))))
    by, fill = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert set(by) == set(texts) and max(fill.values()) <= 128
    for k, own in by.items():
        assert len(own) == max(1, -(-size[k] // 128)) and sum(r.n_tokens for r in own) == size[k]
        assert sorted(r.first_token for r in own) == [128 * i for i in range(len(own))]
    assert all(r.fill == fill[r.container_id] for r in got)
    assert len(fill) <= 1.05 * sum(size.values()) / 128 + 4
    report = packing.packing_report(packing.fill_containers(df, 128, items_per_partition=60), 128).first()
    assert report.n_containers == len(fill) and report.n_rows == len(got)
    assert report.n_uncertified == len({r.container_id for r in got if not r.certified})
    assert report.above_bound == sum({r.partition: r.above_bound for r in got if not r.certified}.values())
    assert all(r.certified == (r.above_bound == 0) for r in got) and all(r.certified for r in got if r.fill == 128)
    assert packing.fill_containers(df.limit(0), 128).count() == 0


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        s = "a" if i % 3 else rng.choice("bcd")
        rows.append((i, f"{s}word{rng.randint(0, 5)} " * rng.randint(5, 40), None if i % 97 == 0 else s, f"{s}/x{i}.md", "t", "en", 1.0))
    rows += [rows[1], (1000, None, "a", "p", "t", "en", 1.0), (None, "x", "a", "p", "t", "en", 1.0), (1001, "other", "zz", "p", "t", "en", 1.0), (1002, "", "b", None, None, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, source_path string, source_type string, lang string, rate double")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.2, 2), ("c", 0.2, 3), ("d", 0.2, 4), ("none", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


@pytest.mark.parametrize("total", [None, 20_000])
def test_mix_meets_shares(spark, sources, total):
    docs, targets = sources
    mixed = mixing.fitted_mix(docs, targets, total, report=True)
    rows = mixed.documents.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} <= set("abcd")
    cap = {"a": 1, "b": 2, "c": 3, "d": 4}
    assert all(1 <= r.repeats <= cap[r.source] for r in rows)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    goal = {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}
    assert all(abs(got[s].actual_share - goal[s]) < 0.02 for s in goal)
    assert got["none"].actual_share == 0.0
    n = sum(r.n_tokens * r.repeats for r in rows)
    assert all(abs(got[s].residual_tokens) <= 0.02 * n and abs(got[s].expected_share - goal[s]) < 0.1 for s in goal)
    assert abs(sum(got[s].expected_tokens for s in goal) - n) < 1e-3 * n
    lacking = {}
    for r in mixing.fit_report(spark, mixed).collect():
        lacking[r.step] = max(lacking.get(r.step, 0), abs(r.residual_share))
    assert lacking[max(lacking)] < 0.1 * lacking[0]


def test_scarce_source_does_not_shrink_the_mix(spark):
    rows = [(i, f"{s}word{i % 7} " * 30, s) for i, s in enumerate("ab" * 200)] + [(1000, "short", "c")]
    rows += [(1001 + i, f"dword{i} " * 30, "d") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'' as source_path", "'' as source_type", "'' as lang")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 1), ("c", 0.1, 1), ("d", 0.15, 20)], "source string, target_share double, max_repeats int")
    mixed = mixing.fitted_mix(docs, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    total = sum(mixed.supply.values())
    assert all(abs(got[s].n_tokens - share * total) < 0.02 * total for s, share in (("a", 0.4), ("b", 0.35), ("d", 0.15)))
    assert got["c"].n_docs == 1 and got["c"].most_repeats == 1 and 0 < got["c"].actual_share < 0.01
    assert got["d"].n_docs == 6 and 1 < got["d"].most_repeats <= 20 and got["d"].used_share == 1
    assert 0.7 < got["a"].corpus_used_share < 1
    large = mixing.mix(docs, targets, 100 * total).collect()  # nothing suffices, so all come as often as they may
    assert len(large) == len(rows) and all(r.repeats == {"d": 20}.get(r.source, 1) for r in large)


def test_mix_of_nothing(spark, sources):
    docs, targets = sources
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.fitted_mix(docs, targets.limit(0)), targets).count() == 5


def test_few_labels_fill_the_sample(spark):
    """Of 20,000 rows 1 % are labelled, one of the labels rarely: the sample takes its bound of each."""
    rows = [(i, "t", "c", None if i % 100 else "rare" if i % 2000 == 0 else "common") for i in range(20_000)]
    df = spark.createDataFrame(rows, "k long, t string, c string, label string")
    picked = [r.label for r in samples.least_hashes_per_label(df, {"rare": 10, "common": 190}, 100).collect()]
    assert picked.count("rare") == 10 and picked.count("common") == 50


def test_classifier_on_held_out_rows():
    rng = random.Random(3)
    make = lambda s: f"{s}alpha {s}beta common words {rng.random()} " * 4
    labels = [rng.choice("xyz") for _ in range(400)]
    ids = tokens.token_ids([make(s) for s in labels])
    model = mixing.learn(ids[:200], ["path"] * 200, labels[:200], ["x", "y", "z"])
    p = model.posteriors(ids[200:], ["path"] * 200, [None] * 200, 0.9)
    assert np.mean(p.argmax(1) == [("x", "y", "z").index(s) for s in labels[200:]]) > 0.9
    assert np.allclose(p.sum(1), 1) and model.posteriors(ids[:1], ["path"], ["x"], 1.0)[0, 0] == 1


CLEAN = ["为了节省调用费用，先拆分了重排服务，再调参数。", "Die Prüfung für Übergabe läuft, und Größe zählt.", "引き継ぎの日に検索の経路を移行したので、障害は再発しなかった。", "ทีมงานย้ายตัวตรวจการอ้างอิง", "Plain words only, no accents — at all…", "Naïve façade tests in São Velto.", "Âge moyen : 62 ans, coût 62 €."]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return garbled.Model([" ".join(rng.sample(CLEAN[:5], 3)) + f" {i}" for i in range(300)] + CLEAN)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp850", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", CLEAN[:3])
def test_garbled_text_comes_back(model, text, wrong):
    bad = "".join(map(garbled.byte_table(wrong).__getitem__, text.encode()))
    spans = model.spans([bad])
    out, end = [], 0
    for _, a, b, _, fixed in spans:
        out += [bad[end:a], fixed if fixed is not None else bad[a:b]]
        end = b
    assert "".join(out) + bad[end:] == text


def test_clean_text_stays(model):
    assert model.spans(CLEAN) == []
    assert model.spans(["", "ascii"]) == []


def test_restore_table(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample(CLEAN[:5], 3)), "clash") for i in range(200)]
    bad = CLEAN[0].encode().decode("latin-1")
    twice = "Prüfung für alle".encode().decode("latin-1").encode().decode("latin-1")
    lost = CLEAN[0].encode("gb18030").decode("utf-8", "replace")
    rows += [(500, "x " + bad + " y", ""), (500, "x " + bad + " y", ""), (501, twice, ""), (502, lost, ""), (503, None, ""), (None, bad, ""), (504, "", ""), (505, CLEAN[5], ""), (506, "a" * 200_000 + bad, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = {r.doc_id: r for r in garbled.restore(df).collect()}
    assert set(got) == {500, 501, 502, 506}
    assert got[500].restored == "x " + CLEAN[0] + " y" and got[501].restored == "Prüfung für alle" and got[506].restored == "a" * 200_000 + CLEAN[0]
    assert got[502].n_restored == 0
    assert garbled.restore(df.limit(0)).count() == 0


def test_languages_that_the_sample_lacks_are_found(spark):
    rng = random.Random(1)
    rare = "მოვიდა წერილი და შეხვედრა გადაიდო ხვალისთვის"
    rows = [(i, " ".join(rng.sample(CLEAN[:5], 3))) for i in range(300)] + [(1500 + i, f"{rare} {i}") for i in range(4)]
    rows += [(1510, "x " + "".join(map(garbled.byte_table("cp1251").__getitem__, rare.encode())) + " y"), (1511, "x " + "".join(map(garbled.byte_table("latin-1").__getitem__, rare.encode())) + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    picked = garbled.least_hashes(df.selectExpr("doc_id as k", "text as t"), len(rows), 12).collect()
    assert all(r.k < 1000 for r in picked)
    got = {r.doc_id: r.restored for r in garbled.restore(df, sample_rows=12).collect()}
    assert got == {1510: f"x {rare} y", 1511: f"x {rare} y"}


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
@pytest.mark.parametrize("text", ["Η εταιρεία ψάχνει μηχανικούς λογισμικού", "Компания ищет инженеров", "会社はエンジニアを探しています", "Zażółć gęślą jaźń, inżynier"])
def test_an_english_sample_suffices_for_other_scripts(text, wrong):
    english = [f"Plain English text number {i} about jobs." for i in range(500)]
    model = garbled.Model(english, garbled.text_counts(english))
    bad = "x " + "".join(map(garbled.byte_table(wrong).__getitem__, text.encode()))
    out, end = [], 0
    for _, a, b, _, fixed in model.spans([bad]):
        out += [bad[end:a], fixed or bad[a:b]]
        end = b
    assert "".join(out) + bad[end:] == "x " + text


def test_two_encodings_in_one_run(model):
    first, second = "für Größe".encode().decode("latin-1"), "省调用费用".encode().decode("cp1252", "ignore")
    spans = model.spans([first + second + " plain"])
    assert spans and spans[0][1] <= first.index("Ã")


def test_a_model_of_a_table_is_that_of_all_its_texts(spark):
    rows = [(i, f"{CLEAN[i % len(CLEAN)]} {i}\nplain {CLEAN[0]}") for i in range(2500)] + [(9000 + i, "x " + CLEAN[0].encode().decode("latin-1") + f" {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, local = garbled.fit(df), garbled.Model([t for _, t in rows])
    assert np.allclose(whole.gain[whole.row], local.gain[local.row]) and np.allclose(whole.clean[whole.row], local.clean[local.row])


def test_only_texts_that_may_be_garbled_are_searched(spark, monkeypatch):
    """Paths are searched where one may leave the clean state, with the same result as in all texts and of any grouping, and the
    fit keeps the garbled texts, not the others."""
    bad = ["".join(map(garbled.byte_table("cp1252").__getitem__, t.encode())) for t in ("Où est le café déjà payé ?", "Größe übrigens ähnlich")]
    texts = [f"{c} {i} é" for i in range(60) for c in CLEAN] + bad
    model, searched, paths = garbled.Model(texts), [], garbled.Model._paths
    monkeypatch.setattr(garbled.Model, "_paths", lambda self, gains: searched.append(len(gains)) or paths(self, gains))
    got = model.spans(texts)
    assert {k for k, *_ in got} == {len(texts) - 2, len(texts) - 1} and sum(searched) < len(texts) / 2
    monkeypatch.setattr(garbled, "SPAN_TEXTS", 7)
    assert model.spans(texts) == got
    monkeypatch.setattr(garbled.Model, "_candidates", lambda self, coded, starts: np.flatnonzero(np.diff(starts)).tolist())
    monkeypatch.setattr(garbled, "_may_leave", lambda *_: True)
    assert model.spans(texts) == got
    monkeypatch.undo()
    kept, staged = [], garbled.staged
    monkeypatch.setattr(garbled, "staged", lambda df, label: kept.append(df.count()) or staged(df, label))
    garbled.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept == [2]


def test_only_texts_with_something_believable_are_searched(model, monkeypatch):
    """Paths that leave the clean state at a rare sign or two only, whose spans are rejected, are not searched, with the same
    result as if they were, in blocks of any size; whether a text is garbled at all is told as by its spans."""
    rng = random.Random(2)
    searched, paths = [], garbled.Model._paths
    monkeypatch.setattr(garbled.Model, "_paths", lambda self, gains: searched.append(len(gains)) or paths(self, gains))
    signs = [f"Plain words \xa4\xa6 number {i}, and more plain words ‚„ after them." for i in range(50)]
    assert model.spans(signs) == [] and not searched
    letters = "éüÖß–“”„‚…\xa0\xa4\xa6为了检索をた障ทีมйЩжΩ" + garbled.LOST
    bad = [true.encode(t, "ignore").decode(w, "replace") for true in CLEAN for t, w in garbled.PAIRS]
    bad += ["".join(map(garbled.byte_table(w).__getitem__, true.encode())) for true in CLEAN for w in garbled.SINGLE_BYTE]
    texts = ["".join(rng.choice((" ", "ab ", "plain words here ", rng.choice(letters), rng.choice(letters), rng.choice(bad)[a : a + rng.randrange(1, 12)])) for _ in range(rng.randrange(1, 25)) if (a := rng.randrange(30)) >= 0) for _ in range(1500)]
    texts += signs + CLEAN + bad
    got, few = model.spans(texts), sum(searched)
    assert len({k for k, *_ in got}) > 300 and model.garbled(texts) == sorted({k for k, *_ in got})
    monkeypatch.setattr(garbled, "BLOCK_CHARACTERS", 5)
    assert model.spans(texts) == got
    searched.clear()
    monkeypatch.setattr(garbled.Model, "_believable", lambda self, chars, coded, high, starts: self._candidates(coded, starts))
    assert model.spans(texts) == got and sum(searched) > few // 2


def test_emissions_of_parts_are_those_of_lines():
    rng = random.Random(3)
    lines = ["".join(rng.choice("é为ทйã\x81 01ab~|检") for _ in range(rng.randrange(30))) for _ in range(3000)] + CLEAN
    for (true, wrong), (codes, n) in zip(garbled.PAIRS, garbled.emissions(lines)):
        data = "\n".join([*lines, ""]).encode(true, "ignore")
        read = [b - 128 for b in data if b > 127] if wrong in garbled.SINGLE_BYTE else [ord(c) for c in data.decode(wrong, "replace") if c > "\x7f"]
        assert {c: k for c, k in zip(codes.tolist(), n.tolist()) if k} == dict(Counter(read)), (true, wrong)
