"""The index under change: provenance, deletion, replay, summaries, questions, streaming."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import packing
from loomgraph.operators import graph
from loomgraph.plans import evaluation
from loomgraph.plans.engine import Engine
from loomgraph.sources import corpus
from loomgraph.streaming import feed

DOCS = [
    (1, "add", "mill", None, "Ada Byron leads Silk Mill Group. Silk Mill Group acquired Loom Works in spring.\n\nLoom Works develops the Jacquard Engine. The Jacquard Engine is used by Canal Traders."),
    (2, "add", "canal", None, "Silk Mill Group acquired Loom Works. Canal Traders is based in Port Weft."),
    (3, "add", "school", None, "Mary Shuttle founded Canal Traders. Mary Shuttle joined Weavers Institute."),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    e.apply(spark.createDataFrame(DOCS, feed.FEED))
    return e


def test_life_of_an_index(spark, engine):
    changes = spark.createDataFrame(DOCS, feed.FEED)
    assert engine.integrity().first().ok
    before = {r.relation_id: r.support for r in engine.relations().collect()}
    assert 2 in before.values()  # the acquisition has two documents

    # A replay changes nothing.
    version = engine.state.version()
    assert engine.apply(changes).noops == 3 and engine.state.version() == version

    # Summaries: none with a budget of 0, then all; drift is empty afterwards.
    assert engine.recompute(0) == 0
    assert engine.drain() > 0 and engine.staleness().first().dirty == 0
    assert all(not r.drifted for r in engine.communities().collect())

    asked = spark.createDataFrame([("Who founded Canal Traders?",), ("Who leads Silk Mill Group?",)], "question string")
    said = {r.question: r.answer for r in engine.query(asked).collect()}
    assert "Mary Shuttle" in said["Who founded Canal Traders?"] and "Ada Byron" in said["Who leads Silk Mill Group?"]

    # Deletion is the difference of chunk ids and no more.
    chunks = {r.chunk_id for r in engine.table("chunks").collect() if r.doc_id != "school"}
    kept = {(r.entity_id, r.chunk_id) for r in engine.table("mention").collect() if r.chunk_id in chunks}
    receipt = engine.apply(spark.createDataFrame([(9, "delete", "school", None, None)], feed.FEED))
    assert receipt.chunks_removed == 1 and receipt.entities_removed == 2 and receipt.entities_added == 0
    assert {(r.entity_id, r.chunk_id) for r in engine.table("mention").collect()} == kept
    assert engine.integrity().first().ok and engine.staleness().first().dirty > 0
    said = {r.question: r.answer for r in engine.query(asked).collect()}
    assert "Mary Shuttle" not in said["Who founded Canal Traders?"]
    assert engine.documents("deleted").first().text == ""

    # A second compaction moves nothing.
    engine.compact()
    assert engine.compact()["moved"] == 0
    assert {r.operation for r in engine.costs().collect()} == {"extract", "embed", "summarise", "answer"}
    assert engine.resolutions().count() > 0


def test_dry_run_prices_an_edit(spark, engine):
    edit = spark.createDataFrame([(5, "update", "mill", None, "A new lead paragraph.\n\n" + DOCS[0][4])], feed.FEED)
    assert set(engine.dry_run(edit).select("change").distinct().toPandas().change) <= {"added", "kept", "moved", "removed"}


def test_packing(spark):
    long = "One sentence here. " * 40
    got = spark.createDataFrame([(None,), ("",), ("a\n\nb",), (long,)], "t string").select(packing.pack(F.col("t"), 100).alias("c")).collect()
    assert got[1].c in ([], None) and got[2].c == ["a\n\nb"]
    assert all(len(c) <= 100 for c in got[3].c) and " ".join(got[3].c).split() == long.split()


def test_matching_is_greedy_by_overlap(spark):
    m = spark.createDataFrame([("a", "x", 5), ("a", "y", 4), ("b", "x", 3), ("b", "y", 1)], "old string, new string, overlap long")
    assert {(r.new, r.old) for r in graph.match_communities(m).collect()} == {("x", "a"), ("y", "b")}


def test_uploads(spark, tmp_path):
    (tmp_path / "good.md").write_text("Some text.")
    (tmp_path / "bad.exe").write_text("x")
    (tmp_path / "empty.txt").write_text("  \n")
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe\xe9")
    good, bad = corpus.intake(spark, str(tmp_path))
    assert [r.doc_id for r in good.collect()] == ["good"]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "not UTF-8", "unsupported suffix"]


def test_feed_stream(spark, tmp_path):
    spark.createDataFrame(DOCS[1:], feed.FEED).coalesce(1).write.json(str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "index"))
    feed.run_feed(e, feed.read_feed(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert e.stats().first().documents == 2 and e.integrity().first().ok


def test_scores(spark):
    q = spark.createDataFrame([("q1", "Loom Works", ["Loom"], ["Mill"], "base"), ("q2", "x", [], ["x"], "base")], "question string, answer string, must_include array<string>, must_exclude array<string>, kind string")
    a = spark.createDataFrame([("q1", "the loom works"), ("q2", "x marks")], "question string, answer string")
    got = {r.question: r for r in evaluation.score(q, a).collect()}
    assert got["q1"].em and got["q1"].correct and got["q2"].stale and got["q2"].recall == 1.0
