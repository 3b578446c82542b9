import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import components, crosssplit, forms, grams, lines, neardup, neighbours


def gram_sets(texts, n):
    return {k: {s[i : i + n] for i in range(len(s) - n + 1)} for k, s in ((k, forms.letters_only(t)) for k, t in texts.items() if t)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def noisy(rng, text, share):
    return "".join(rng.choice("qwertyuiop") if rng.random() < share else c for c in text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(120)]
    out = {f"t{i:04}": t for i, t in enumerate(base)}
    for i, t in enumerate(base[:60]):
        out[f"u{i:04}"] = noisy(rng, t, rng.choice([0.005, 0.01, 0.02]))
        out[f"v{i:04}"] = t.upper() + "!"
    return out | {"short": "ab", "short2": "ab", "void": ""}


def test_grams_match_strings(texts):
    keys = list(texts)
    h, at = grams.distinct_grams(*forms.letters_batch(list(texts.values())), 5)
    want = gram_sets(texts, 5)
    for i, k in enumerate(keys):
        assert at[i + 1] - at[i] == len(want.get(k, ()))
    assert [len(x) for x in grams.grams(np.zeros(0, np.uint32), np.array([0, 0]), 5)] == [0, 2]


@pytest.mark.parametrize("leaf", [64, 4])
def test_near_duplicates_equal_brute_force(spark, texts, leaf, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    rows = [(k, t, "x") for k, t in texts.items()] + [("t0000", texts["t0000"], "again"), ("null", None, ""), (None, texts["t0001"], "")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, cls string")
    found = neardup.NearDuplicates(df, 0.7)
    got = [(r.chunk_id_a, r.chunk_id_b) for r in found.pairs().collect()]
    sets = gram_sets(texts, 5)
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.7}
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.chunk_id: r for r in found.groups().collect()}
    assert all(groups[a].group_id == groups[b].group_id for a, b in want) and groups["t0000"].n_copies == 2


def test_crowded_nodes_are_compared_whole(spark):
    """Texts so alike that no path parts them are compared as they stand, in one task or in blocks; no pair is lost."""
    rng = random.Random(5)
    base = " ".join(rng.choice(["alpha", "bravo", "delta", "echo", "golf", "hotel"]) + str(rng.randint(0, 99)) for _ in range(120))
    texts = {f"c{i:03}": base + f" tail{i:03}" for i in range(90)}
    df = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    members = neardup.members(df, "chunk_id", "text").withColumn("slack", F.lit(0))
    for settings in ({}, {"leaf": 8, "depth": 2}, {"leaf": 8, "hot": 16}):
        assert neardup.class_links(members.select("cls", "slack", *neardup.SKETCH), 10, **settings).count() == 90 * 89 // 2


def variants(n, words=150, seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(words)]
    return [" ".join(base[:70] + [f"order {i:06}"] + base[70:]) for i in range(n)]


@pytest.mark.parametrize("n", [130, 3000])
def test_variants_of_one_template_stay_linear(spark, n):
    """With the settings meant for production: every variant is linked to every other, and the links take linear room."""
    rng = random.Random(4)
    texts = variants(n)
    far = texts[0].split()
    far = " ".join(w if rng.random() < 0.93 else "xyz" + w[::-1] for w in far)  # linked to all or none, outside of the ball
    rows = [(f"v{i:05}", t) for i, t in enumerate(texts)] + [("copy", texts[5]), ("far", far), ("other", " ".join(variants(1, seed=9)))]
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "chunk_id string, text string"), 0.7)
    groups = {r.chunk_id: r for r in found.groups().collect()}
    sets = gram_sets({"far": far, "v0": texts[0], "v7": texts[7]}, 5)
    with_far = [jaccard(sets["far"], sets[v]) >= 0.7 for v in ("v0", "v7")]
    assert with_far in ([True, True], [False, False])
    assert {groups[f"v{i:05}"].n_links for i in range(n)} == {n - 1 + with_far[0]}
    assert groups["far"].n_links == n * with_far[0] and groups["other"].n_links == 0 and groups["copy"].n_copies == 2
    assert len({groups[f"v{i:05}"].group_id for i in range(n)}) == 1
    assert found.links().count() <= 2 * n
    if n < 1000:
        pairs = [(r.chunk_id_a, r.chunk_id_b) for r in found.pairs().collect()]
        assert len(pairs) == len(set(pairs)) == (n + 1) * n // 2 + (n + 1) * with_far[0]


def test_links_of_balls_equal_brute_force(spark):
    """Two balls and classes between them: some links follow from the distances, some are compared, some don't exist."""
    rng = random.Random(12)
    a, b = variants(90, words=60, seed=1), variants(90, words=60, seed=2)
    mixed = []
    for share in (0.05, 0.1, 0.15, 0.2, 0.3):
        for t in (a[0], b[0]):
            mixed += [" ".join(w if rng.random() > share else "q" + w[::-1] for w in t.split()) for _ in range(8)]
    bent = [" ".join(("zz" + w if i % 14 == 0 else w) for i, w in enumerate(t.split())) for t in a]
    texts = {f"k{i:04}": t for i, t in enumerate(dict.fromkeys([*a, *b, *mixed, *bent]))}
    sets = gram_sets(texts, 5)
    want = {(x, y) for x in sets for y in sets if x < y and jaccard(sets[x], sets[y]) >= 0.7}
    found = neardup.NearDuplicates(spark.createDataFrame(list(texts.items()), "chunk_id string, text string"), 0.7)
    got = [(r.chunk_id_a, r.chunk_id_b) for r in found.pairs().collect()]
    assert found.balls is not None and len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.999 * len(want)
    degree = {}
    for x, y in got:
        degree[x], degree[y] = degree.get(x, 0) + 1, degree.get(y, 0) + 1
    assert {r.chunk_id: r.n_links for r in found.groups().collect()} == {k: degree.get(k, 0) for k in texts}


def test_copies_are_members_of_one_class(spark):
    rows = [(f"k{i:02}", "the same text in many copies") for i in range(20)] + [("z", "the same text in many copies!s")]
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "chunk_id string, text string"), 0.7)
    assert found.links().count() == 1 and {r.n_copies for r in found.groups().collect()} == {1, 20}
    assert found.pairs().count() == 21 * 20 // 2


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    found = neardup.NearDuplicates(df)
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.component_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_cross_split_pairs_equal_brute_force(spark, texts):
    rng = random.Random(3)
    rows = []
    for i, (k, t) in enumerate(texts.items()):
        topics = rng.choice([None, [], ["c1"], ["c1", "c2"], [f"c{i}"]])
        rows.append((k, t[:90], rng.choice(["train", "dev", "test"]), topics, "x"))
    rows += [rows[0], ("null", None, "train", None, ""), ("nosplit", "some text here", None, None, ""), ("x1", texts["t0000"][:90], "train", None, ""), ("x2", texts["v0000"][:90], "test", [], "")]
    df = spark.createDataFrame(rows, "case_id string, query string, split string, relevant_chunk_ids array<string>, code string")
    found = crosssplit.CrossSplit(df, 0.65)
    pairs = found.pairs().collect()
    got = [(r.train_id, r.other_id) for r in pairs]
    by = {r[0]: r for r in rows if r[1] and r[2]}
    sets = gram_sets({k: r[1] for k, r in by.items()}, 3)
    topic = {k: set(r[3] or [""]) for k, r in by.items()}
    want = {(a, b) for a in by for b in by if by[a][2] == "train" and by[b][2] != "train" and topic[a] & topic[b] and jaccard(sets[a], sets[b]) >= 0.65}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want) and len(want) > 20
    want_cases, want_pairs = {}, {}
    for r in pairs:
        for source in by[r.other_id][3] or [None]:
            want_cases.setdefault((r.other_split, source), set()).add(r.other_id)
            want_pairs[r.other_split, source] = want_pairs.get((r.other_split, source), 0) + 1
    counts = {(r.split, r.source): (r.n_cases, r.n_pairs) for r in crosssplit.leak_counts(df, found, sources_col="relevant_chunk_ids").collect()}
    assert counts == {k: (len(want_cases[k]), want_pairs[k]) for k in want_pairs}
    assert crosssplit.CrossSplit(df.limit(0)).pairs().count() == 0


def test_a_common_query_takes_one_link(spark):
    rows = [(f"c{i:04}", "What does the job pay?", "train" if i % 2 else "test", None, ["jd"]) for i in range(400)]
    df = spark.createDataFrame(rows, "case_id string, query string, split string, relevant_chunk_ids array<string>, expected_sources array<string>")
    found = crosssplit.CrossSplit(df)
    assert found.unit_links().count() == 1 and found.pairs().count() == 200 * 200
    assert [tuple(r) for r in crosssplit.leak_counts(df, found).collect()] == [("test", "jd", 200, 40_000)]


def test_simhash_equals_its_definition():
    texts = ["the quick brown fox", "", "ab", "jumps over the lazy dog " * 3, "".join(chr(0x4E00 + i * 7 % 20000) for i in range(70_000))]
    data, offsets = forms.letters_batch(texts)
    codes, g, at = crosssplit.simhash(data, offsets)
    for k in range(len(texts)):
        own = g[at[k] : at[k + 1]]
        for w in range(4):
            h = grams.mixed(own, w + 1)
            want = sum(1 << b for b in range(64) if len(own) and 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(own))
            assert int(codes[k, w]) == want


def test_tables_reach_the_recall():
    for width in (6, 12, 18):
        n = crosssplit.tables_for(width, 0.65, 0.995)
        assert 1 - (1 - crosssplit.bit_agreement(0.65) ** width) ** n >= 0.995


@pytest.mark.parametrize("rows_per_part", [200, 25])
def test_neighbours_recall_and_ties(spark, rows_per_part):
    """With the smaller parts, the sample allows for fewer than are needed and they are parted again."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[10:30] = x[10]
    rows = [(f"c{i:05}", "r1" if i % 3 else "r2", [float(v) for v in x[i]], "clash") for i in range(len(x))]
    rows += [rows[0], ("zero", "r1", [0.0] * 16, ""), ("null", "r1", None, ""), ("few", "r1", [1.0], ""), (None, "r1", [1.0] * 16, ""), ("holes", "r1", [None] + [1.0] * 15, ""), ("nan", "r1", [float("nan")] + [1.0] * 15, ""), ("lone", "r3", [1.0] * 16, "")]
    df = spark.createDataFrame(rows, "chunk_id string, embedding_version string, embedding array<float>, part string")
    s = neighbours.Settings(dimensions=16, sample_rows=800 if rows_per_part > 100 else 320, rows_per_part=rows_per_part, block_rows=300 if rows_per_part > 100 else 20)
    got = {}
    for r in neighbours.neighbours(df, settings=s).collect():
        got.setdefault((r.embedding_version, r.chunk_id), []).append((r["rank"], r.neighbour_id, r.cosine))
    hit = total = 0
    for version in ("r1", "r2"):
        ids = [r[0] for r in rows[:3000] if r[1] == version]
        v = np.array([x[int(i[1:])] for i in ids], np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for i, k in enumerate(ids):
            own = sorted(got[version, k])
            assert [r for r, *_ in own] == list(range(1, 11)) and k not in [n for _, n, _ in own]
            cosine = v @ v[i]
            cosine[i] = -2
            best = {ids[j] for j in np.lexsort((np.arange(len(ids)), -np.round(cosine, 9)))[:10]}
            hit, total = hit + len(best & {n for _, n, _ in own}), total + 10
    assert hit / total >= (0.95 if rows_per_part > 100 else 0.85)  # parts of 25 vectors for ten neighbours are hard
    assert not {"zero", "null", "few", "holes", "nan", "lone"} & {k for _, k in got}
    assert neighbours.neighbours(df.limit(0), settings=s).count() == 0


def test_vectors_are_packed_without_loss(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    x[::2] = x[::2].astype(np.float16)
    x[1] = 1e30
    df = spark.createDataFrame([(f"c{i}", "g", [float(v) for v in r]) for i, r in enumerate(x)], "k string, g string, x array<float>")
    rows = sorted(neighbours.packed_rows(df, "k", "g", "x", 8).collect(), key=lambda r: int(r.k[1:]))
    assert [len(r.v) for r in rows] == [16 if i % 2 == 0 else 32 for i in range(50)]
    import pyarrow as pa

    got = neighbours.units(pa.array([bytes(r.v) for r in rows], pa.binary()), 8)
    wide = x.astype(np.float64)
    assert np.abs(got - wide / np.sqrt((wide * wide).sum(1, keepdims=True))).max() < 1e-6


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(8)
    notice, short = "Share this page with 12 friends", "Share 12345"
    rows = []
    for i in range(300):
        body = ["Unique line " + "".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(3)]
        if i % 10 == 0:
            body.insert(1, notice.replace("12", str(i)) + (" " if i % 20 else "\r"))
        if i % 5 == 0:
            body.append(short)
        rows.append((f"k{i:03}", "a" if i % 2 == 0 else "b", "\n".join(body), "x"))
    rows += [(f"r{i}", "c", "Same article line one\n\nSame article line two", "") for i in range(30)]
    rows += [rows[0], ("null", "a", None, ""), (None, "a", notice, ""), ("nosource", None, notice, ""), ("void", "a", "", "")]
    df = spark.createDataFrame(rows, "chunk_id string, source_type string, text string, lines string")
    docs = lines.keyed_lines(df, "chunk_id", "source_type", "text")
    got = {(r.k, r.line_no) for r in lines.found_lines(docs, lines.repeated_lines(docs, least_clusters=1, least_days=1)).collect()}
    by = {r[0]: r for r in rows if r[0] and r[2] is not None}
    keys = {k: [lines.line_key(forms.consistent(x)) for x in r[2].split("\n")] for k, r in by.items()}
    want = set()
    for k, r in by.items():
        same = [j for j in by if by[j][1] == r[1]]
        for no, key in enumerate(keys[k], 1):
            n = sum(key in keys[j] for j in same) if key else 0
            if n >= 5 and n >= 0.01 * len(same):
                want.add((k, no))
    assert got == want and want
    spread = lines.repeated_lines(docs)
    assert {r.source for r in spread.collect()} == {"a"}  # copies of one article are no boilerplate
    cleaned = {r.chunk_id: r for r in lines.without_lines(df, lines.found_lines(docs, spread), "chunk_id", "text").collect()}
    assert cleaned["k000"].n_removed == 1 and "Share this page" not in cleaned["k000"].text and cleaned["k001"].text == by["k001"][2]
    empty = lines.keyed_lines(df.limit(0), "chunk_id", "source_type", "text")
    assert lines.found_lines(empty, lines.repeated_lines(empty)).count() == 0


def test_repeated_dates_and_phone_lines_are_found(spark):
    rows = [(f"c{i}", "jd", f"Text number {'abcdefgh'[i]} stands alone\n2024-05-0{i + 1} 10:00\nTel: 030123456{i}\n2024-05-0{i + 1}") for i in range(8)]
    docs = lines.keyed_lines(spark.createDataFrame(rows, "chunk_id string, source_type string, text string"), "chunk_id", "source_type", "text")
    got = {(r.k, r.line_no) for r in lines.found_lines(docs, lines.repeated_lines(docs)).collect()}
    assert got == {(f"c{i}", n) for i in range(8) for n in (2, 3)}  # the last line has 10 characters only


def test_republished_articles_keep_their_lines(spark):
    """One article in 1,000 copies, a notice of one day, and a notice of several days."""
    rows = [(f"r{i}", "a", "The article says this in its first line\nAnd that in its second one", f"2024-01-{i % 28 + 1:02}") for i in range(1000)]
    rows += [(f"n{i}", "a", f"Text number {chr(97 + i % 26)}{chr(97 + i // 26)} is its own\nSubscribe to our newsletter today", f"2024-02-{i % 5 + 1:02}") for i in range(60)]
    rows += [(f"o{i}", "a", f"Story {chr(97 + i % 26)}{chr(97 + i // 26)} stands alone here\nLive from the fair of Saturday", "2024-03-01") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, source string, text string, day string")
    docs = lines.keyed_lines(df, "k", "source", "text", F.col("day"))
    got = lines.repeated_lines(docs).collect()
    assert [(r.n_docs, r.n_clusters, r.n_days, r.n_source_docs) for r in got] == [(60, 60, 5, 1120)]
    cleaned = {r.k: r for r in lines.without_lines(df, lines.found_lines(docs, lines.repeated_lines(docs)), "k", "text").collect()}
    assert cleaned["r7"].n_removed == cleaned["o3"].n_removed == 0 and cleaned["n3"].text == "Text number da is its own"
