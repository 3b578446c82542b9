"""Small inputs with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vectors as V
from lodestrand.operators import chunking, context, dedup, gates, graph, labelling, lexical, metrics, ranking, routing
from lodestrand.sources import files, html
from lodestrand.streaming import events


def one(spark, expression, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(expression.alias("x")).first().x


def test_tokens_bridge_han_pairs(spark):
    got = one(spark, T.mixed_tokens("t"), t="我用RAG做检索")
    assert got == ["rag", "我", "用", "做", "检", "索", "我用", "用做", "做检", "检索"]
    assert one(spark, T.mixed_tokens("t"), t="") == []
    assert one(spark, T.mixed_tokens("t"), t="Python Python 向量检索").count("python") == 2


def test_quality_tokens_keep_order_once(spark):
    assert one(spark, T.quality_tokens("t"), t="甲乙丙丁 Node.js 甲乙丙") == ["甲乙丙", "乙丙丁", "node.js"]


def test_jaccard_and_overlap_of_nothing(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty)) == 0.0
    assert one(spark, T.overlap(empty, F.array(F.lit("a")))) == 0.0


def test_vectors(spark):
    zero, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.unit(zero)) == [0.0, 0.0]
    assert one(spark, V.cosine(zero, a)) == 0.0
    assert one(spark, V.unit(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.dot(a, F.array(F.lit(1.0)))) is None


@pytest.fixture(scope="module")
def small(spark):
    rows = [("short", "jd", "Python RAG 检索"), ("long", "jd", "Python Python RAG 检索 评测 Agent Context"), ("resume", "resume", "简历包含 Python 项目")]
    return spark.createDataFrame(rows, "chunk_id string, source_type string, text string")


def test_bm25_ranks_and_filters(spark, small):
    q = spark.createDataFrame([("q", "Python RAG 检索")], "query_id string, query string")
    jd = spark.createDataFrame([("q", "jd")], "query_id string, source_type string")
    index = lexical.build_index(small)
    got = lexical.bm25(index, q, 1, jd).collect()
    assert len(got) == 1 and got[0].rank == 1 and got[0].source_type == "jd" and got[0].score > 0
    assert lexical.bm25(index, q, 5, jd.limit(0)).count() == 0
    assert lexical.bm25(index, q, 5).count() == 3
    assert [r.chunk_id for r in lexical.keyword(index, q, 1).collect()] == ["long"]


def ranks(spark, *ids):
    return spark.createDataFrame([("q", c, i) for i, c in enumerate(ids, 1)], "query_id string, chunk_id string, rank int")


@pytest.mark.parametrize(("a", "b", "k", "want"), [(["shared", "lexical"], ["shared", "dense"], 3, ["shared", "dense", "lexical"]), ([], ["b", "a"], 1, ["b"]), (["z"], ["a"], 2, ["a", "z"])])
def test_rank_fusion(spark, a, b, k, want):
    got = ranking.reciprocal_rank_fusion(ranks(spark, *a), ranks(spark, *b), k, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == want
    if not a:
        assert got[0].rank_a is None


def test_fusion_without_graph_hits_keeps_the_vector_ranking(spark):
    kind = "query_id string, chunk_id string, score double, rank int"
    a = spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 0.5, 2)], kind)
    b = spark.createDataFrame([("q", "y", 0.9, 1), ("q", "z", 0.8, 2), ("e", "v", 0.7, 1), ("e", "w", 0.6, 2), ("e", "u", 0.5, 3)], kind)
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 6)) for r in ranking.fusion_or_second(a, b, 2).collect()}
    assert got == {("q", 1): ("y", round(1 / 62 + 1 / 61, 6)), ("q", 2): ("x", round(1 / 61, 6)), ("e", 1): ("v", 0.7), ("e", 2): ("w", 0.6)}


def test_graph_vector_fusion_takes_both_lists(spark):
    from lodestrand.plans import core_queries

    rows = core_queries()["d19_graph_vector_fusion"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.rank_a for r in rows) and any(r.rank_b for r in rows) and all(r.chunk_id != r.query_id for r in rows if r.rank_b)
    assert len(rows) == len({(r.query_id, r.rank) for r in rows}) and all(1 <= r.rank <= 10 for r in rows)


def test_retrieval_metrics(spark):
    labels = spark.createDataFrame([("q", ["b", "d"]), ("none", None)], "query_id string, relevant array<string>")
    got = {r.query_id: r for r in metrics.per_query(ranks(spark, "a", "b", "c"), labels, 2).collect()}
    assert got["q"].recall == 0.5 and got["q"].reciprocal_rank == 0.5 and 0 < got["q"].ndcg < 1
    assert (got["none"].recall, got["none"].reciprocal_rank, got["none"].ndcg) == (0.0, 0.0, 0.0)


def test_unknown_stays_unknown(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None), ("c", False)], "k string, f boolean")
    assert {r.k: r.unsupported for r in gates.verdict(rows, "k", "f").collect()} == {"a": True, "b": None, "c": False}


def simhash(text):
    from hashlib import sha256

    t = "".join(text.lower().split())
    import re

    tokens = dict.fromkeys([t[i : i + 3] for i in range(len(t) - 2) if re.fullmatch("[一-鿿]{3}", t[i : i + 3])] + re.findall(r"[a-z][a-z0-9_+#.-]+", t))
    weight = [0] * 64
    for token in tokens:
        h = int.from_bytes(sha256(token.encode()).digest()[:8], "big")
        for b in range(64):
            weight[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if weight[b] >= 0) if tokens else 0


def test_simhash_and_pairs_are_complete(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(60)) for _ in range(12)]
    texts = {f"d{i:02}": t[: rng.choice([56, 58, 60])] for i, t in enumerate(base * 4)} | {"empty": ""}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {r.id: r.hi << 32 | r.lo for r in dedup.simhash(df, "id", "text").collect()}
    assert got == {k: simhash(t) for k, t in texts.items()}
    prints = dedup.simhash(df, "id", "text").join(df.select("id", F.lit("g").alias("grp"), F.greatest(F.length("text"), F.lit(1)).alias("n_chars")), "id")
    classes = {r.id: r.rep for r in dedup.fingerprint_classes(prints).collect()}
    assert all(classes[k] == min(x for x in texts if got[x] == got[k] and max(1, len(texts[x])) == max(1, len(texts[k]))) for k in texts)
    for distance in (0, 3, 6):
        found = {(r.a, r.b): r.distance for r in dedup.near_pairs(prints, distance).collect()}
        linked = lambda a, b: 0 if classes[a] == classes[b] else found.get(tuple(sorted((classes[a], classes[b]))))  # noqa: B023, E731
        pairs = {(a, b): d for a in texts for b in texts if a < b and (d := linked(a, b)) is not None}
        want = {(a, b): d for a in texts for b in texts if a < b and (d := (got[a] ^ got[b]).bit_count()) <= distance and min(len(texts[a]) or 1, len(texts[b]) or 1) / max(len(texts[a]) or 1, len(texts[b]) or 1) >= 0.85}
        assert pairs == want


def test_greedy_rejections_follow_order(spark):
    rng = random.Random(9)
    links = {(a, b) for a in range(60) for b in range(a + 1, min(60, a + 8)) if rng.random() < 0.25}
    kept, want = [], {}
    for b in range(60):
        near = [a for a in kept if (a, b) in links]
        if near:
            want[b] = near[0]
        else:
            kept.append(b)
    df = spark.createDataFrame([(a, b, 1) for a, b in links], "a long, b long, distance int")
    assert {r.id: r.duplicate_of for r in dedup.greedy_rejections(df).collect()} == want
    assert dedup.greedy_rejections(df.limit(0)).count() == 0


def test_near_rejections_by_class_equal_those_by_id(spark):
    rng = random.Random(11)
    hashes = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(80):
        h = rng.choice(hashes)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            h ^= 1 << rng.randrange(64)
        rows.append((f"d{i:02}", "g", 100, h >> 32, h & 0xFFFFFFFF))
    kept, want = [], {}
    of = {r[0]: r[3] << 32 | r[4] for r in rows}
    for k in sorted(of):
        near = [x for x in kept if (of[x] ^ of[k]).bit_count() <= 3]
        if near:
            want[k] = (near[0], (of[near[0]] ^ of[k]).bit_count())
        else:
            kept.append(k)
    df = spark.createDataFrame(rows, "id string, grp string, n_chars int, hi long, lo long")
    assert {r.id: (r.duplicate_of, r.distance) for r in dedup.near_rejections(df).collect()} == want


def test_chunking(spark):
    df = spark.createDataFrame([(1, "第一句很短。第二句也很短。第三句还是很短。第四句结束了。"), (2, "无" * 65), (3, "a\n\nb\n\n\n\nc"), (4, "")], "id long, t string")
    got = {}
    for r in chunking.sentence_chunks(df, "id", "t", 20, 0.5).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert len(got[1]) > 1 and all(len(c) <= 20 for c in got[1]) and got[1][0].endswith("。") and "".join(got[1]) == df.first().t
    assert all(10 <= len(c) <= 20 for c in got[2]) and "".join(got[2]) == "无" * 65
    assert got[3] == ["a\n\nb\n\nc"] and 4 not in got


def test_packing(spark):
    items = spark.createDataFrame([("q", 1, "jd-1", "jd", 40), ("q", 2, "jd-2", "jd", 40), ("q", 3, "resume-1", "resume", 40)], "query_id string, rank int, chunk_id string, source_type string, size int")
    required = spark.createDataFrame([("q", ["jd", "resume"])], "query_id string, sources array<string>")
    assert [r.chunk_id for r in context.source_balanced(items, required, 82).orderBy("rank").collect()] == ["jd-1", "resume-1"]
    assert [r.chunk_id for r in context.rank_prefix(items, 82).collect()] == ["jd-1", "jd-2"]
    large = items.withColumn("size", F.when(F.col("chunk_id") == "jd-1", 500).otherwise(10))
    assert "jd-1" not in [r.chunk_id for r in context.source_balanced(large, required, 82).collect()]
    rng = random.Random(3)
    sizes = [rng.randint(5, 60) for _ in range(30)]
    many = spark.createDataFrame([("q", i, f"c{i}", "x", s) for i, s in enumerate(sizes, 1)], items.schema)
    want, used = [], 0
    for i, s in enumerate(sizes, 1):
        if used + (2 if want else 0) + s <= 200:
            used, want = used + (2 if want else 0) + s, [*want, i]
    assert sorted(r["rank"] for r in context.source_balanced(many, required, 200).collect()) == want


def test_citations(spark):
    g = spark.createDataFrame([("a", True, []), ("b", False, ["x"]), ("c", True, ["x", "x", "y"])], "query_id string, sufficient boolean, cited array<string>")
    c = spark.createDataFrame([("c", "x"), ("b", "x")], "query_id string, chunk_id string")
    got = {(r.query_id, r.issue, r.chunk_id) for r in context.citation_issues(g, c).collect()}
    assert got == {("a", "missing_citation", None), ("b", "insufficient_with_citations", None), ("c", "duplicate_citation", "x"), ("c", "citation_not_found", "y")}


def test_rule_routes(spark):
    q = spark.createDataFrame([("a", "这个岗位的要求"), ("b", "hello"), ("c", "简历和面试"), ("d", "")], "query_id string, query string")
    got = {r.query_id: (r.intent, r.confidence) for r in routing.rule_routes(q).collect()}
    assert got == {"a": ("analyze_jd", 1.0), "b": ("unknown", 0.0), "c": ("match_resume", 0.5), "d": ("unknown", 0.0)}


def test_all_vectors_but_the_search_are_prototypes(spark):
    from lodestrand.operators import dense
    from lodestrand.plans import core_queries

    folder = "/root/testdata/sf0.001"
    vectors = {(r.embedding_version, r.chunk_id): (r.source_type, r.unit) for r in dense.usable(spark.read.parquet(f"{folder}/chunk_vectors.parquet"), 64).collect()}
    want = {}
    for (group, own), (_, a) in vectors.items():
        if (number := own.split("-")[1]).isdigit() and int(number) % 100 == 0:
            for (other_group, other), (source, b) in vectors.items():
                if group == other_group and own != other:
                    best = want.setdefault(own, {})
                    best[source] = max(best.get(source, -2.0), sum(x * y for x, y in zip(a, b)))
    got = {r.query_id: r for r in core_queries()["i2_semantic_routes"](spark, folder).collect()}
    assert set(got) == set(want) and want
    for k, best in want.items():
        first, second = sorted([*best.values(), *[0.0] * (len(best) < 2)], reverse=True)[:2]
        assert abs(got[k].score - first) < 2e-6 and abs(got[k].margin - (first - second)) < 2e-6


def test_graph_reaches_by_hops(spark, tmp_path):
    g = graph.Graph(
        spark.createDataFrame([("j", "job", "job"), ("s", "skill", "Python"), ("p", "project", "proj")], "node_id string, node_type string, name string"),
        spark.createDataFrame([("e1", "requires", "j", "s"), ("e2", "demonstrates", "p", "s")], "edge_id string, edge_type string, source_node_id string, target_node_id string"),
        spark.createDataFrame([("j", "c1"), ("s", "c1"), ("s", "c2"), ("p", "c2")], "node_id string, chunk_id string"),
        spark.createDataFrame([("e1", "c1"), ("e2", "c2")], "edge_id string, chunk_id string"),
    )
    links = spark.createDataFrame([("q", "j")], "query_id string, node string")
    queries = spark.createDataFrame([("q", "岗位要求")], "query_id string, query string")
    assert {(r.node, r.hops) for r in graph.reach(links, g.edges, 2).collect()} == {("j", 0), ("s", 1), ("p", 2)}
    assert {(r.node, r.hops) for r in graph.reach(links, g.edges, 2, 2).collect()} == {("j", 0), ("s", 1)}
    got = graph.graph_hits(queries, g, links, 2, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.hops) for r in got] == [("c1", 0), ("c2", 1)]
    assert graph.graph_hits(queries, g, links.limit(0), 2, 5).count() == 0
    graph.save_graph(g, str(tmp_path / "g"))
    assert graph.load_graph(spark, str(tmp_path / "g")).edges.count() == 2
    graph.save_graph(graph.Graph(g.nodes.limit(1), g.edges, g.node_chunks, g.edge_chunks), str(tmp_path / "g"))
    with pytest.raises(ValueError, match="do not agree"):
        graph.load_graph(spark, str(tmp_path / "g"))


def test_bounded_walk_is_first_in_first_out(spark):
    from collections import deque

    rng = random.Random(5)
    edges = [(f"e{i:03}", rng.choice("xyz"), f"n{rng.randint(0, 39):02}", f"n{rng.randint(0, 39):02}") for i in range(120)]
    starts = ["n03", "n17"]
    near: dict = {}
    for _, kind, a, b in edges:
        near.setdefault(a, set()).add((kind, b))
        near.setdefault(b, set()).add((kind, a))
    for bound in (1, 2, 7, 15, 30):
        queue, seen = deque((n, 0) for n in starts), {}
        while queue and len(seen) < bound:
            node, hops = queue.popleft()
            if node not in seen:
                seen[node] = hops
                if hops < 2:
                    queue.extend((n, hops + 1) for _, n in sorted(near.get(node, ())) if n not in seen)
        df = spark.createDataFrame(edges, "edge_id string, edge_type string, source_node_id string, target_node_id string")
        links = spark.createDataFrame([("q", n) for n in starts], "query_id string, node string")
        assert {r.node: r.hops for r in graph.reach(links, df, 2, bound).collect()} == seen


def test_path_counts_equal_listed_paths(spark):
    import itertools

    rng = random.Random(5)
    ends = {(t, *rng.sample("abcdefgh", 2)) for t in "xyz" for _ in range(9)} | {("x", "a", "a")} | {("y", "a", n) for n in "bcdefgh"}
    rows = [(f"e{i}", *x) for i, x in enumerate(sorted(ends))]
    edges = spark.createDataFrame(rows, "edge_id string, edge_type string, source_node_id string, target_node_id string")
    steps = [(s, t, e) for e, _, s, t in rows] + [(t, s, e) for e, _, s, t in rows if s != t]
    want = {}
    for n in (2, 3):
        paths = [((a, b), (e,)) for a, b, e in steps if a != b]
        for _ in range(n - 1):
            paths = [((*p, b), (*q, e)) for (p, q), (a, b, e) in itertools.product(paths, steps) if p[-1] == a and b not in p]
        for middle, _ in {(p[1] if n == 2 else q[1], frozenset(q)) for p, q in paths}:
            want[n, middle] = want.get((n, middle), 0) + 1
    assert {(r.hops, r.middle): r.n_paths for r in graph.path_counts(edges).collect()} == want
    assert graph.path_counts(edges.limit(0)).count() == 0


def test_html_and_files(spark, tmp_path):
    assert html.visible_text("<main>a</main>b<tr>c</tr><svg><svg>x</svg>y</svg> d<!-- <p> -->e<pre>f</pre><path d='>'>g &lt;p&gt;") == "a\nbc defg <p>"
    for tag in html.BLOCKS:
        assert html.visible_text(f"x<{tag} class='q'>y") == html.visible_text(f"x</{tag}>y") == "x\ny"
    for tag in html.HIDDEN:
        assert html.visible_text(f"x<{tag}>no <p>never</{tag}>y") == "xy"
    assert html.visible_text("<div>A&amp;B<script>x<b>y</b></script> c</div><p>d<br>e</p>") == "A&B c\nd\ne"
    df = spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "id long, h string")
    assert {r.id: r.text for r in html.pages_to_text(df, "id", "h").collect()} == {1: "x", 2: None}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("# hi")
    (tmp_path / "a/x.pdf").write_text("no")
    assert [r.text for r in files.text_files(spark, str(tmp_path)).collect()] == ["# hi"]
    row = {c: "x" for c in files.JOB_FIELDS} | {"version": "2", "status": " Active"}
    good = files.checked_jobs(spark.createDataFrame([row])).first()
    assert (good.version, good.status) == (2, "active")
    with pytest.raises(Exception, match="version is no number"):
        files.checked_jobs(spark.createDataFrame([row | {"version": "x"}])).collect()
    with pytest.raises(ValueError, match="missing fields"):
        files.checked_jobs(spark.createDataFrame([{"job_id": "x"}]))
    (tmp_path / "l.jsonl").write_text('{"case_id": "a", "predicted_intent": "x"}\n')
    with pytest.raises(ValueError, match="predictions"):
        files.labels_jsonl(spark, str(tmp_path / "l.jsonl"))


def test_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in/part"))
    stream = events.read_log(spark, str(tmp_path / "in/part"))
    q = events.first_of_key(stream, "event_id").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == batch.select("event_id").distinct().count()


def test_encoder_counts_every_text(spark):
    import numpy as np

    from lodestrand.operators import encoding

    rows = [(f"a{i}", f"plain text {i % 9}") for i in range(2300)] + [("z", "ꙮꙮꙮꙮ")]
    encoder = encoding.fit(spark.createDataFrame(rows, "id string, t string"), "id", "t", dimensions=40)
    x = encoder.features([t for _, t in rows]).astype(np.float64)
    df = (x > 0).sum(0)
    assert np.allclose(encoder.idf, np.log((1 + len(rows)) / (1 + df)) + 1, atol=1e-5)
    values, vectors = np.linalg.eigh(x.T @ x)
    few = vectors[:, np.argsort(-values)[:5]]
    assert np.allclose(few @ few.T, encoder.basis[:, :5] @ encoder.basis[:, :5].T, atol=1e-3)
    assert np.linalg.norm(encoder.features(["ꙮꙮꙮꙮ"]) @ encoder.basis) > 0.5


def test_encoder_finds_the_like(spark):
    import numpy as np

    from lodestrand.operators import encoding

    rng = random.Random(2)
    topics = {"a": "vector index search latency", "b": "gardening soil tomato seeds", "c": "检索增强生成与重排服务"}
    rows = [(f"{k}{i}", " ".join(rng.sample(t.split(), len(t.split()))) + f" {i}") for k, t in topics.items() for i in range(30)]
    df = spark.createDataFrame([*rows, ("none", None), ("void", "")], "id string, t string")
    encoder = encoding.fit(df, "id", "t", dimensions=8)
    got = {r.id: np.array(r.embedding) for r in encoding.encode(df, encoder, "id", "t").collect()}
    assert "none" not in got and len(got) == 91
    assert got["a1"] @ got["a2"] > 0.8 > abs(got["a1"] @ got["b2"])


def test_index_round_trip(spark, small, tmp_path):
    index = lexical.build_index(small)
    lexical.save_index(index, str(tmp_path / "i"))
    q = spark.createDataFrame([("q", "Python RAG 检索")], "query_id string, query string")
    again = lexical.load_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, lexical.bm25(again, q).collect())) == sorted(map(tuple, lexical.bm25(index, q).collect()))
    index.df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "i/df"))
    with pytest.raises(ValueError, match="do not agree"):
        lexical.load_index(spark, str(tmp_path / "i"))


def test_managed_context(spark):
    rows = [("q", "system", 0, "system", 10), ("q", "query", 0, "query", 30), ("q", "evidence", 1, "e001", 50), ("q", "evidence", 2, "e002", 40), ("q", "evidence", 3, "e003", 5), ("q", "history", 1, "h1", 1), ("q", "history", 2, "h2", 2), ("q", "memory", 1, "m1", 3)]
    rows += [("large", "system", 0, "system", 90), ("large", "query", 0, "query", 30), ("bare", "query", 0, "query", 3)]
    parts = spark.createDataFrame(rows, "query_id string, kind string, seq int, segment_id string, size int")
    take = lambda mode: {(r.query_id, r.segment_id, r.error) for r in context.managed_context(context.segments(parts, mode, 1), 105, 10).collect()}
    faulty = {("large", None, "budget"), ("bare", None, "missing_segment")}
    q = lambda *ids: {("q", i, None) for i in ids}
    assert take("no_memory") == faulty | q("system", "query", "e001", "e003")
    assert take("semantic_memory") == faulty | q("system", "query", "m1", "e001")
    assert take("recent_window") == take("no_memory") and take("full_history") == take("no_memory")
    with pytest.raises(ValueError, match="no such mode"):
        context.segments(parts, "other")


def test_pairs_of_queries_and_chunks_stay_in_their_task(spark, monkeypatch):
    """Only the best of a task are shuffled, whatever the number of chunks that share a word with a query; blocks of
    documents, of queries and of tokens change nothing."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = {f"c{i:03}": " ".join(["all", *rng.choices(words, k=rng.randint(1, 9))]) for i in range(300)}
    index = lexical.build_index(spark.createDataFrame([(c, rng.choice(["jd", "resume", None]), t) for c, t in texts.items()], "chunk_id string, source_type string, text string").repartition(3))
    queries = {"one": "all", "same": "ALL all", "two": "all w1 w2", "six": "w3 w4 w5 w6 w7 unknown", "none": "unknown", "void": "", "null": None}
    q = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    where = {r.chunk_id: r.source_type for r in index.documents.collect()}
    order = lambda c: (where[c] is not None, where[c] or "", c)

    def best(score):
        out = []
        for name, text in queries.items():
            s = {c: score(set((text or "").lower().split()), t.split()) for c, t in texts.items()}
            near = sorted((c for c in s if s[c] > 0), key=lambda c: (-round(s[c], 9), *order(c)))[:4]
            out += [(name, c, n, round(s[c], 6)) for n, c in enumerate(near, 1)]
        return sorted(out)

    df = {w: sum(w in t.split() for t in texts.values()) for w in ["all", *words]}
    length = sum(len(t.split()) for t in texts.values()) / len(texts)
    okapi = lambda q, t: sum(math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / length)) for w in q if w in t)
    share = lambda q, t: len(q & set(t)) / max(1, len(q))
    rows = lambda hits: sorted((r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in hits.collect())
    assert rows(lexical.bm25(index, q, 4)) == best(okapi) and rows(lexical.keyword(index, q, 4)) == best(share)
    plan = lexical.keyword(index, q, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "token#" not in plan  # no postings are joined
    for name, size in (("BLOCK_CHUNKS", 16), ("BLOCK_QUERIES", 2), ("MOST_TOKENS", 4)):
        monkeypatch.setattr(lexical, name, size)
    assert rows(lexical.bm25(index, q, 4)) == best(okapi) and rows(lexical.keyword(index, q, 4)) == best(share)


def test_labels_of_a_large_path_are_not_paired_with_its_chunks(spark, monkeypatch):
    monkeypatch.setattr(labelling, "BLOCK", 10)
    monkeypatch.setattr(labelling, "FEW", 5)
    rng = random.Random(8)
    parts = ["ab", "abc", "x\0y", "z", "q"]
    texts = {f"c{i:02}": ("hub" if i < 50 else f"p{i % 9}", "".join(rng.choices(parts, k=rng.randint(0, 4)))) for i in range(80)}
    labels = [(f"k{i}", rng.choice(list(texts)), rng.choice([["abc", "z"], ["ab", "ab", "q"], ["x\0y", None], ["", "nowhere"], ["nowhere"], ["bx", "y"]])) for i in range(60)]
    best = {(k, c): min((-sum(p is not None and p in t for p in points), d) for d, (path, t) in texts.items() if path == texts[c][0]) for k, c, points in labels}
    rows = labelling.remapped(spark.createDataFrame(labels + labels[:3], "case_id string, chunk_id string, points array<string>"), spark.createDataFrame([(c, *x) for c, x in texts.items()], "chunk_id string, source_path string, t string"))
    assert sorted(map(tuple, rows.collect())) == sorted((k, c, d, -n) for (k, c), (n, d) in best.items())


def test_linked_chunks_picks_the_first_of_each_node_beforehand(spark):
    held = spark.createDataFrame([("hub", f"c{i:03}") for i in range(0, 200, 2)] + [("side", f"c{i:03}") for i in range(1, 40, 3)], "node_id string, chunk_id string")
    links = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("b", "side"), ("d", "side")], "query_id string, node string")
    got = graph.linked_chunks(links, graph.Graph(None, None, held, None), 5)
    rows = {q: [r.chunk_id for r in got.where(f"query_id = '{q}'").orderBy("rank").collect()] for q in "abd"}
    assert rows == {"a": ["c000", "c002", "c004", "c006", "c008"], "b": ["c000", "c001", "c002", "c004", "c006"], "d": ["c001", "c004", "c007", "c010", "c013"]}
    assert graph.first_chunks(held, 5, "node_id").count() == 10


def test_reach_counts_agree_with_the_walks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SETS", 2)
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(40)} | {("n00", f"m{i}") for i in range(20)}
    edges = spark.createDataFrame([(f"e{i}", "uses", a, b) for i, (a, b) in enumerate(sorted(pairs))], "edge_id string, edge_type string, source_node_id string, target_node_id string")
    links = spark.createDataFrame([(f"q{i}", f"n{rng.randrange(30):02}") for i in range(6) for _ in range(3)] + [("lone", "nowhere"), ("copy", "n00"), ("like", "n00")], "query_id string, node string")
    want = graph.reach(links, edges, 2).groupBy("query_id", "hops").count()
    assert sorted(map(tuple, graph.reach_counts(links, edges, 2).collect())) == sorted(map(tuple, want.collect()))
