"""The jobs on copies of small tables: growing input, replays and reruns."""

import json
import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import index_feed, service_report
from loomgraph.operators import facts

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, source string, lang string, batch long, kind string"  # with names that clash


def land(spark, folder, rows):
    """One more file of documents."""
    data = [(i, t, s, "en", 9, "x") for i, t, s in rows]
    spark.createDataFrame(data, DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def state(spark, out):
    return sorted((tuple(r) for r in index_feed.everything(spark, out).filter("kind <> 'receipt'").collect()), key=str)


def sums(spark, out):
    return {r.name: int(r.other) for r in index_feed.everything(spark, out).filter("kind = 'receipt'").collect()}


def wanted(spark, docs):
    """Facts of the documents as they are, in one pass."""
    rows = spark.createDataFrame([d for d in docs if d[1] is not None], "doc_id long, text string, source string")
    ch = facts.sentence_chunks(rows)
    men = facts.mentions(ch).select(F.lit("mention").alias("kind"), "doc_id", "chunk_id", "name", F.lit(None).cast("string").alias("other"))
    sup = facts.support(ch).select(F.lit("support").alias("kind"), "doc_id", "chunk_id", F.col("src").alias("name"), F.col("dst").alias("other"))
    return sorted((tuple(r) for r in men.unionByName(sup).collect()), key=str)


ONE = [(1, "Ada Byron leads Silk Mill. Silk Mill met Loom Works.", "a"), (2, "Canal Traders met Ada Byron. Canal Traders met Ada Byron.", "b"), (3, "", None), (4, None, "a"), (None, "Lost Page.", "a")]
TWO = [(1, "Ada Byron leads Silk Mill. Silk Mill left Loom Works.", "a"), (2, None, None), (3, "", None), (5, "Port Weft grew. " * 200, "c"), (6, "Twin Mill.", "a"), (6, "Twin Mill.", "a")]


def test_index_feed_over_growing_input(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    index_feed.run(spark, str(source), out)
    assert index_feed.everything(spark, out).collect() == []

    land(spark, source, ONE)
    index_feed.run(spark, str(source), out)
    first = state(spark, out)
    assert [r for r in first if r[0] != "document"] == wanted(spark, ONE[:4])
    assert sums(spark, out)["documents_read"] == 5 and sums(spark, out)["documents_unchanged"] == 1  # a withdrawal of what was not there

    land(spark, source, TWO)
    index_feed.run(spark, str(source), out)
    second, counted = state(spark, out), sums(spark, out)
    assert [r for r in second if r[0] != "document"] == wanted(spark, [TWO[0], TWO[2], TWO[3], TWO[4]])
    assert {(r[1], r[3], r[4]) for r in second if r[0] == "document"} == {(1, "2", "active"), (2, "1", "deleted"), (3, "1", "active"), (5, "1", "active"), (6, "1", "active")}
    assert counted["documents_read"] == 11 and counted["documents_updated"] == counted["documents_deleted"] == 1
    assert counted["chunks_kept"] == 1 and counted["chunks_removed"] == 3  # one sentence of the first document stays

    index_feed.run(spark, str(source), out)  # nothing new
    assert state(spark, out) == second and sums(spark, out) == counted

    marks = sorted((Path(out) / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    marks[-1].unlink()  # as if the last batch had died before it was committed
    (marks[-1].parent / f".{marks[-1].name}.crc").unlink(missing_ok=True)
    index_feed.run(spark, str(source), out)
    assert state(spark, out) == second and sums(spark, out) == counted


def test_index_feed_writes_in_proportion_to_the_change(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    land(spark, source, [(i, f"Mill {chr(65 + i % 26)} met Loom Works {i}.", "a") for i in range(200)])
    index_feed.run(spark, str(source), out)
    land(spark, source, [(7, "Mill Q closed.", "a")])
    index_feed.run(spark, str(source), out)
    by = {r.batch: r.n for r in index_feed.stored(spark, out, "chunks").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sorted(by.values()) == [1, 200]


EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double, day string, le double"


def test_service_report(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    at = lambda d, s: datetime(2024, 1, d, 0, s // 60, s % 60)
    rows = [(i, at(1 + i % 2, i), "view", float(i), "x", 0.0) for i in range(100)] + [(200, at(1, 5), None, None, None, None), (201, None, "view", 1.0, None, None), (202, at(1, 9), "big", 9e9, None, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(source)
    read = lambda: sorted(tuple(r) for r in service_report.everything(spark, out).collect())
    service_report.run(spark, source, out, first="2030-01-01")
    assert read() == []
    service_report.run(spark, source, out, last="2024-01-01")
    one = read()
    assert {str(r[0]) for r in one} == {"2024-01-01"}
    service_report.run(spark, source, out)
    both = read()
    assert [r for r in both if str(r[0]) == "2024-01-01"] == one and {str(r[0]) for r in both} == {"2024-01-01", "2024-01-02"}
    service_report.run(spark, source, out, first="2024-01-02", last="2024-01-02")
    assert read() == both
    got = {(str(r[0]), r[1], r[2]): r[3] for r in both}
    day = ("2024-01-01", "view")  # 0, 2, …, 98
    assert got[(*day, "events")] == 50 and got[(*day, "le_10")] == 6 and got[(*day, "le_inf")] == 50 and got[(*day, "total")] == 2450
    assert got[(*day, "p50")] == pytest.approx(25 + 25 * (25 - 13) / 13, abs=1e-4)
    assert got[("2024-01-01", "big", "p99")] == 5000 and got[("2024-01-01", "unknown", "le_inf")] == 0 and ("2024-01-01", "unknown", "p50") not in got
    assert got[("2024-01-01", "unknown", "share_of_day")] == pytest.approx(1 / 52, abs=1e-4)


def test_command_lines(spark, tmp_path):
    land(spark, tmp_path / "in", ONE[:2])
    config = tmp_path / "feed.json"
    config.write_text(json.dumps({"source": str(tmp_path / "in"), "out": "/nowhere"}))
    done = subprocess.run([sys.executable, str(ROOT / "jobs/index_feed.py"), "--config", str(config), "--out", str(tmp_path / "out")], capture_output=True, text=True, timeout=300, env=os.environ)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "documents_added 2" in done.stderr and state(spark, str(tmp_path / "out"))
