"""Row deltas, optimistic commits, bases and what a dead writer leaves."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import snapshots
from loomgraph.sources.snapshots import Conflict, Snapshots


def members(spark, pairs):
    return spark.createDataFrame(pairs, "entity_id string, comm string")


def held(state, version=None):
    return sorted((r.entity_id, r.comm) for r in state.read("membership", version).collect())


def written(spark, state, name, version):
    return spark.read.parquet(f"{state.root}/{name}/v={version}").count()


def test_deltas_in_proportion(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path), base_every=3)
    assert held(state) == [] and state.version() == 0
    first = [(f"e{i:03d}", f"c{i % 7}") for i in range(300)]
    state.commit({"membership": members(spark, first)})
    second = [*first[2:], ("e001", "c9"), ("e999", None)]  # one gone, one moved, one new without a community
    state.commit({"membership": members(spark, second)})
    assert written(spark, state, "membership", 2) == 3
    assert held(state) == sorted(second, key=lambda x: x[0]) and held(state, 1) == first
    costs = spark.createDataFrame([(2, "extract", 1)], "seq long, operation string, tokens_in long").selectExpr("seq", "operation", "tokens_in", "0L tokens_out", "0.0D usd", "false cache_hit", "'d' doc_id", "null comm")
    state.commit({"membership": members(spark, second)}, added={"costs": costs})
    assert written(spark, state, "membership", 3) == 0 and state.read("costs").count() == 1
    state.commit({"membership": members(spark, first)}, added={"costs": costs})  # the third delta: a base
    assert written(spark, state, "membership", 4) == 300 and held(state) == first and state.read("costs").count() == 2
    state.commit({"membership": members(spark, first[:10])})
    assert state.vacuum() > 0 and held(state) == first[:10] and state.read("costs").count() == 2
    assert {p.name for p in (tmp_path / "membership").glob("v=*/w=*")} == {p.name for v in (4, 5) for p in (tmp_path / "membership").glob(f"v={v}/w=*")}
    state.clear(keep=("costs",))
    assert held(state) == [] and state.read("costs").count() == 2


def test_one_of_two_writers_wins(spark, tmp_path):
    one, two = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    one.commit({"membership": members(spark, [("a", "c1")])})
    one.begin(), two.begin()
    two.commit({"membership": members(spark, [("a", "c1"), ("b", "c2")])})
    with pytest.raises(Conflict):
        one.commit({"membership": members(spark, [("a", "c3")])})
    one.end(), two.end()
    assert held(one) == held(two) == [("a", "c1"), ("b", "c2")]
    one.commit({"membership": members(spark, [("b", "c2")])})  # begun anew it goes through
    assert held(two) == [("b", "c2")]


def test_a_dead_writer_is_invisible(spark, tmp_path, monkeypatch):
    state = Snapshots(spark, str(tmp_path))
    state.commit({"membership": members(spark, [("a", "c1")])})
    monkeypatch.setattr(Snapshots, "_claim", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        state.commit({"membership": members(spark, [("z", "c9")])})
    monkeypatch.undo()
    assert held(state) == [("a", "c1")] and state.version() == 1
    marker = Path(tmp_path) / "_versions" / "2"
    marker.touch()  # died while it made its marker
    assert state.version() == 1
    with pytest.raises(Conflict):  # it may still be at work
        state.commit({"membership": members(spark, [("a", "c2")])})
    os.utime(marker, (1, 1))
    assert state.commit({"membership": members(spark, [("a", "c2")])}) == 2 and held(state) == [("a", "c2")]
    left = sum(1 for _ in (tmp_path / "membership").glob("v=2/w=*"))
    assert left == 3 and state.vacuum() >= 2 and held(state) == [("a", "c2")]


def test_changed_compares_nulls_and_arrays(spark):
    schema = "k string, x array<string>, y double"
    old = spark.createDataFrame([("a", ["p"], None), ("b", None, 1.0), ("c", [], 2.0)], schema)
    new = spark.createDataFrame([("a", ["p"], None), ("b", ["q"], 1.0), ("d", None, None)], schema)
    got = {(r.k, r["_gone"]) for r in snapshots.changed(old, new, ["k"]).select("k", F.col("_gone")).collect()}
    assert got == {("b", False), ("d", False), ("c", True)}
