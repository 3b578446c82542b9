"""How often queries read the documents, and what leaves a task."""

from collections import namedtuple

import pyarrow as pa
import pytest

from lodestrand.operators import lexical
from lodestrand.plans import core_queries

FOLDER = "/root/testdata/sf0.001"
Words, Count = namedtuple("Words", "g n tokens allowed"), namedtuple("Count", "token df")


def plan(spark, name, folder=FOLDER):
    return core_queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stats", [None, (600, 3.0)])
def test_no_more_than_the_best_leave_a_task(monkeypatch, stats):
    """However many blocks the task reads, and however many chunks are equal."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 50)
    sets = [Words(7, 2, [Count("a", 600), Count("b", 300)], []), Words(8, 1, [Count("b", 300)], [])]
    tokens = [["a", *["b"] * (i % 2), "x"] for i in range(600)]
    rows = pa.record_batch([pa.array([f"c{(i * 7) % 600:03}" for i in range(600)]), pa.array(["jd"] * 600), pa.array(tokens)], ["chunk_id", "source_type", "tokens"])
    got = pa.Table.from_batches(lexical._Scorer(sets, 4, stats, 1.5, 0.75, False)(rows.slice(i, 70) for i in range(0, 600, 70))).to_pylist()
    assert sorted((r["g"], r["chunk_id"]) for r in got) == [(g, f"c{i:03}") for g in (7, 8) for i in (1, 3, 5, 7)]


def test_source_expansion_reads_the_first_attempt_once(spark):
    assert plan(spark, "h2_source_expansion", "/root/testdata/sf0.01").count("MapInArrow") == 1  # the second attempt


@pytest.mark.parametrize("stats", [None, (90, 2.0)])
def test_ranks_for_a_fusion_leave_a_task_once(monkeypatch, stats):
    """Better chunks in later blocks replace those of earlier ones; the last block may end with the task."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 30)
    sets = [Words(1, 3, [Count(w, 90) for w in "abc"], [])]
    rows = pa.record_batch([pa.array([f"c{i:02}" for i in range(90)]), pa.array([None] * 90, pa.string()), pa.array([list("abc"[: 1 + i // 30]) for i in range(90)])], ["chunk_id", "source_type", "tokens"])
    got = pa.Table.from_batches(lexical._Scorer(sets, 20, stats, 1.5, 0.75, False)([rows])).to_pylist()
    assert [r["chunk_id"] for r in got] == [f"c{i}" for i in range(60, 80)]


def test_a_matrix_of_retrievers_reads_the_documents_once_for_each_ranking(spark):
    """Both are kept, and neither is made again for the runs that build on it."""
    text = plan(spark, "o13_retrieval_matrix")
    assert "MapInArrow" not in text and "chunks.parquet" not in text


def test_packing_reads_the_texts_of_hits_only(spark, monkeypatch):
    """The ids go to the chunks, and other texts aren't shuffled; too many ids are joined with the same result."""
    from lodestrand.plans import registry

    assert "MapInArrow" not in plan(spark, "h4_source_balanced")
    hits = registry.chunks(spark, FOLDER).orderBy("chunk_id").limit(7).select("chunk_id")
    few = registry.chunks_of(spark, FOLDER, hits)
    monkeypatch.setattr(registry, "MOST_IDS", 3)
    many = registry.chunks_of(spark, FOLDER, hits)
    want = registry.chunks(spark, FOLDER).orderBy("chunk_id").limit(7).collect()
    assert sorted(few.collect()) == sorted(many.collect()) == sorted(want)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


def test_the_evidence_gate_takes_sources_from_the_hits(spark):
    assert "chunks.parquet" not in plan(spark, "h1_evidence_gate")


def test_rerank_deltas_read_the_documents_once(spark):
    text = plan(spark, "o11_rerank_deltas")
    assert "MapInArrow" not in text and "chunks.parquet" not in text


def test_equal_shares_leave_a_task_once(monkeypatch):
    """The first of the ties may stand in any block."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 10)
    rows = pa.record_batch([pa.array([f"c{99 - i:02}" for i in range(100)]), pa.array([["z", None, "y", "x"][i % 4] for i in range(100)]), pa.array([["a"]] * 100)], ["chunk_id", "source_type", "tokens"])
    got = pa.Table.from_batches(lexical._Scorer([Words(1, 2, [Count("a", 100)], [])], 5, None, 1.5, 0.75, False)([rows])).to_pylist()
    assert [(r["chunk_id"], r["source_type"], r["score"]) for r in got] == [(f"c{i:02}", None, 0.5) for i in (2, 6, 10, 14, 18)]


def test_the_index_shuffles_only_rows_of_repeated_ids(spark, monkeypatch, tmp_path):
    """A null id is an id; too many repeated ids are shuffled with all others, with the same result."""
    from lodestrand.plans import registry, retrieval_queries

    rows = [("a", "jd", "x"), ("a", None, "w"), ("b", "jd", "y"), ("c", None, None), (None, "jd", "z"), (None, "cv", "v"), ("d", None, "u"), ("d", None, "u"), ("e", "cv", "")]
    spark.createDataFrame([(c, s, "p", "t", x) for c, s, x in rows], "chunk_id string, source_type string, source_path string, title string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    monkeypatch.setattr(lexical, "build_index", lambda rows: rows)
    few = retrieval_queries.index_of(spark, str(tmp_path))
    text = few.select("text")._jdf.queryExecution().executedPlan().toString()
    assert "Union" in text and "Exchange hashpartitioning" not in text[: text.index("Aggregate")]
    monkeypatch.setattr(registry, "MOST_IDS", 2)
    many = registry.chunks_in_place(spark, str(tmp_path))
    assert "Union" not in many._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple((x is not None, x or "") for x in r)
    want = sorted(registry.chunks(spark, str(tmp_path)).collect(), key=key)
    assert len(want) == 5 and sorted(few.collect(), key=key) == sorted(many.collect(), key=key) == want


def test_the_gate_groups_only_chunks_of_repeated_ids(spark, monkeypatch, tmp_path):
    from lodestrand.plans import registry

    (tmp_path / "own").symlink_to(FOLDER)  # another path, so the index is built
    grouped, group = [], registry._one_a_chunk
    monkeypatch.setattr(registry, "_one_a_chunk", lambda rows: grouped.append(rows.count()) or group(rows))
    assert core_queries()["f28_metric_gate"](spark, str(tmp_path / "own")).count() == 2
    ids = [r.chunk_id for r in spark.read.parquet(f"{FOLDER}/chunks.parquet").where("text is not null").collect()]
    assert grouped == [sum(ids.count(c) > 1 for c in ids)] and grouped[0] < len(ids)
