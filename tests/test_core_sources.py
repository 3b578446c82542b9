import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import corpus
from lodestrand.operators import graph, lexical, retrievers, state
from lodestrand.sources import corpus_files, files


def test_files_become_documents_and_chunks(spark, tmp_path):
    (tmp_path / "raw/jd").mkdir(parents=True)
    (tmp_path / "raw/jd/one.md").write_text("---\ncompany: Acme: East\nno value\ncity : X\n---\nFirst part.\n\nSecond part.")
    (tmp_path / "raw/jd/empty.txt").write_text("")
    root = str(tmp_path / "raw")
    docs = corpus_files.documents(files.text_files(spark, root), root)
    got = {r.title: r for r in docs.collect()}
    assert set(got) == {"one"} and got["one"].source_type == "jd" and got["one"].source_path == "jd/one.md"
    assert got["one"].metadata == {"company": "Acme: East", "city": "X"} and got["one"].text == "First part.\n\nSecond part."
    for strategy, want in (("paragraphs", ["First part.", "Second part."]), ("windows", ["First part.", "Second part."]), ("sentences", ["First part.", "Second part."])):
        rows = sorted(corpus_files.document_chunks(docs, 13, strategy).collect(), key=lambda r: int(r.metadata["chunk_index"]))
        assert [r.text for r in rows] == want
        assert rows[0].chunk_id.startswith("jd-one-0-") and rows[0].metadata["source_file_name"] == "one.md" and rows[0].metadata["city"] == "X"
    with pytest.raises(ValueError, match="no such strategy"):
        corpus_files.document_chunks(docs, 13, "other")
    private = corpus_files.private_records(docs, "2024-01-01").where("title = 'one'").first()
    assert private.source_url == "private://jd/one.md" and private.owner_scope == "private"
    (tmp_path / "raw/other").mkdir()
    (tmp_path / "raw/other/x.md").write_text("x")
    with pytest.raises(Exception, match="no source type"):
        corpus_files.documents(files.text_files(spark, root), root).collect()


def test_public_pages(spark):
    rows = [("a", "jd", "A", "u", "html", "<p>Top</p><p>Begin here</p><div>text</div><p>End</p>", "Begin", "End", None), ("b", "jd", "B", "u", "text", "  plain text  ", None, None, 5)]
    schema = "source_id string, source_type string, title string, url string, content_type string, content string, start_marker string, end_marker string, max_chars int"
    got = {r.source_id: r.text for r in corpus_files.public_documents(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "Begin here\ntext", "b": "plain"}
    with pytest.raises(Exception, match="no start marker"):
        corpus_files.public_documents(spark.createDataFrame([("c", "jd", "C", "u", "text", "x", "nowhere", None, None)], schema)).collect()


def test_artefacts_and_labels(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "jd", "jd/a.md", "a", "text", {"k": "v"})], "chunk_id string, source_type string, source_path string, title string, text string, metadata map<string,string>")
    docs = chunks.drop("chunk_id")
    corpus_files.write_artefacts(docs, chunks, chunks.select("chunk_id", F.lit("too_short").alias("reason")), docs.groupBy("source_type").count(), str(tmp_path / "build"), "v1")
    back = corpus_files.read_chunks(spark, str(tmp_path / "build/chunks")).first()
    assert (back.dataset_version, back.chunk_id, back.metadata) == ("v1", "c1", {"k": "v"})
    assert set(spark.read.json(str(tmp_path / "build/manifest")).columns) == {"source_type", "source_path", "title"}
    with pytest.raises(Exception, match="(?i)already exists"):
        corpus_files.write_chunks(chunks, str(tmp_path / "build/chunks"), "v2")
    (tmp_path / "g.jsonl").write_text(json.dumps({"case_id": "g1", "query": "q", "expected_strategy": "graph", "answerable": True}) + "\n\n")
    assert corpus_files.labels(spark, str(tmp_path / "g.jsonl"), "graph").first().expected_strategy == "graph"
    (tmp_path / "p.jsonl").write_text('{"case_id": "x", "predicted_intent": "y"}\n')
    for kind in corpus_files.LABELS:
        with pytest.raises(ValueError, match="predictions"):
            corpus_files.labels(spark, str(tmp_path / "p.jsonl"), kind)
    (tmp_path / "e.json").write_text('[{"name": "RAG", "node_type": "skill"}]')
    assert corpus_files.entity_catalogue(spark, str(tmp_path / "e.json")).first().aliases == []
    (tmp_path / "e.json").write_text('[{"name": "", "node_type": "skill"}]')
    with pytest.raises(ValueError, match="lacks"):
        corpus_files.entity_catalogue(spark, str(tmp_path / "e.json"))


def test_frozen_inputs(spark, tmp_path):
    from hashlib import sha256

    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / name).write_text(name)
    manifest = spark.createDataFrame([("a", sha256(b"a").hexdigest()), ("c", "0")], "name string, expected string")
    assert {r.name: r.same for r in corpus_files.frozen_inputs(spark, str(tmp_path / "in"), manifest).collect()} == {"a": True, "b": False, "c": False}


def test_retrievers_by_name(spark, tmp_path):
    def letters(texts):
        v = np.array([[t.lower().count(c) + 1e-3 for c in "abcdefghijklmnop"] for t in texts], float)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    rows = [("c1", "jd", "Python RAG jobs"), ("c2", "resume", "Python in a project"), ("c3", "jd", "nothing alike")]
    chunks = spark.createDataFrame([(*r, r[0]) for r in rows], "chunk_id string, source_type string, text string, title string")
    catalogue = spark.createDataFrame([("Python", "skill", [])], "name string, node_type string, aliases array<string>")
    index = retrievers.build_dense_index(chunks, letters, "v1", "letters", 16)
    retrievers.save_dense_index(index, str(tmp_path / "dense"))
    loaded = retrievers.load_dense_index(spark, str(tmp_path / "dense"), "v1", "letters")
    for version, name in (("v2", "letters"), ("v1", "other")):
        with pytest.raises(ValueError, match="the index is of"):
            retrievers.load_dense_index(spark, str(tmp_path / "dense"), version, name)
    store = retrievers.Store(chunks, lexical.build_index(chunks), loaded, letters, graph.extract(chunks, catalogue), catalogue)
    q = spark.createDataFrame([("q", "Python RAG")], "query_id string, query string")
    for name in retrievers.RETRIEVERS:
        got = retrievers.retrieve(name, store, q, 2).orderBy("rank").collect()
        assert [r.rank for r in got] == [1, 2] and (name == "dense" or {r.chunk_id for r in got} <= {"c1", "c2", "c3"})
    assert retrievers.retrieve("bm25", store, q, 2).orderBy("rank").first().chunk_id == "c1"
    with pytest.raises(ValueError, match="no such retriever"):
        retrievers.retrieve("x", store, q)
    with pytest.raises(ValueError, match="needs"):
        retrievers.retrieve("graph", retrievers.Store(chunks, store.index), q)


def test_scores_and_decisions(spark):
    pairs = spark.createDataFrame([("q", "a", 1, "x y", "x"), ("q", "b", 3, "x y", "x y")], "query_id string, chunk_id string, rank int, query string, text string")
    got = {r.chunk_id: r.rerank_score for r in retrievers.scored(pairs, lambda a, b: [len(t) for t in b]).collect()}
    assert got == {"a": 1.0, "b": 3.0}
    known = spark.createDataFrame([("q", "b", 0.7)], "query_id string, chunk_id string, rerank_score double")
    assert {r.chunk_id: r.rerank_score for r in retrievers.fixed_scores(pairs, known).collect()} == {"a": 0.0, "b": 0.7}
    decided = retrievers.with_decision(pairs.select("query_id", "chunk_id", "rank"), spark.createDataFrame([("q", "hybrid")], "query_id string, strategy string"))
    assert {(r.chunk_id, r["rank"], r.strategy) for r in decided.collect()} == {("a", 1, "hybrid"), ("b", 2, "hybrid")}


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([("g", f"c{i:04}", "jd", [float(e) for e in r]) for i, r in enumerate(x)], "grp string, chunk_id string, source_type string, unit array<double>")
    q = v.where("chunk_id < 'c0100'").select("grp", F.col("chunk_id").alias("query_id"), "unit")
    hit = 0
    for r in retrievers.approximate_top_k(q, v, 5, n_lists=20, probes=4, sample_rows=500).collect():
        i = int(r.query_id[1:])
        s = x @ x[i]
        s[i] = -2
        hit += int(r.chunk_id[1:]) in set(np.argsort(-s)[:5].tolist())
    assert hit / 500 >= 0.95


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    v = [1.0, -0.5, 1e-7, 123456789.123, 0.0, 1 / 3]
    assert one(corpus.vector_literal(F.array(*map(F.lit, v)))) == "[" + ",".join(f"{x:.10g}" for x in v) + "]"
    a, b = (one(corpus.fingerprint(F.create_map(*(F.lit(x) for x in m)))) for m in (("k", "1", "j", "2"), ("j", "2", "k", "1")))
    assert a == b and len(a) == 64
    assert tuple(one(corpus.error_kind(F.lit("HTTP 503")))) == ("provider_5xx", True)


def test_updates_are_accepted_in_order(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 5), ("b", 1, 1), ("b", 2, 0), (None, 1, 0), ("b", 3, None)]
    got = {(r.k, r.seq): (r.accepted, r.version) for r in state.accepted_updates(spark.createDataFrame(rows, "k string, seq int, e int"), "k", "seq", "e").collect()}
    assert got == {("a", 1): (True, 1), ("a", 2): (False, 1), ("a", 3): (True, 2), ("a", 4): (False, 2), ("b", 1): (False, 0), ("b", 2): (True, 1), ("b", 3): (False, 1), (None, 1): (False, 0)}


def test_tombstones_and_availability(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "x", False), ("b", 2, None, True)], "k string, v int, text string, gone_flag boolean")
    assert [(r.k, r.text) for r in state.current_rows(log, ["k"], ["v"], F.col("gone_flag")).collect()] == [("a", "y")]
    rows = spark.createDataFrame([(1, True, True, None), (2, True, True, "2024-01-01"), (3, True, True, "2025-01-01"), (4, False, True, None)], "id int, confirmed boolean, active boolean, e string")
    got = state.available(rows.withColumn("expires_at", F.col("e").cast("timestamp")), "2024-06-01")
    assert {r.id for r in got.collect()} == {1, 3}
