"""Payloads, quantiles, counters and merges on crafted rows."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import payload
from loomgraph.operators import entities, measures


def plain_object(raw):
    for text in (raw, *re.findall(r"(?s)\{.*\}", raw or "")[:1]):
        try:
            if isinstance(json.loads(text), dict):
                return json.loads(text)
        except (TypeError, ValueError):
            pass
    return {}


RAW = [
    None, "", "no", "{}", '{"a": 1}', ' {"a": 1}\n', 'Here: {"a": 1} ok', '{"a": 1', '{"a": 1} and }', 'x {"a": {"b": 2}} y', '[1, 2]', "7", '{"a": 1}{"a": 2}', '{"a": 1}, {"a": 2}',
    '{"a": 1}], [{"a": 2}', '{"a": 1}, "y": {"a": 2}', '{"a": 1}}, {"x": {"a": 2}', 'a\n{"a":\n3}\nb', '{"a": "\\u00e9}"}', "{a: 1}", '}{',
]


def test_lenient_payloads(spark):
    rows = spark.createDataFrame(list(enumerate(RAW)), "i int, raw string")
    got = {r.i: r.j for r in rows.select("i", payload.json_object(F.col("raw")).alias("j")).collect()}
    for i, raw in enumerate(RAW):
        assert json.loads(got[i]) == plain_object(raw), raw
    assert rows.filter("i = 17").select(payload.loads(F.col("raw"), "a int, b string").alias("x")).first().x.asDict() == {"a": 3, "b": None}


def test_bucket_quantiles(spark):
    values = [(g, float(v)) for g, vs in {"a": range(1, 101), "b": [0.5] * 4, "c": [9e9], "d": [-1.0, 3.0]}.items() for v in vs] + [("e", None)]
    buckets = measures.bucket_counts(spark.createDataFrame(values, "g string, x double"), ["g"], "x", [0.0, 10.0, 50.0])
    got = {(r.g, r.q): r.x for r in measures.bucket_quantiles(buckets, ["g"], [0.05, 0.3, 0.95]).collect()}
    assert got[("a", 0.05)] == pytest.approx(5.0) and got[("a", 0.3)] == pytest.approx(30.0) and got[("a", 0.95)] == 50.0
    assert got[("b", 0.3)] == pytest.approx(3.0) and got[("c", 0.3)] == 50.0 and got[("d", 0.3)] == 0.0
    assert not any(g == "e" for g, _ in got)


def test_increase_over_resets(spark):
    at = lambda m: datetime(2024, 1, 1, m // 60, m % 60)
    rows = [("a", at(0), 5.0), ("a", at(10), 8.0), ("a", at(20), 2.0), ("a", at(61), 6.0), ("b", at(0), 1.0)]
    got = {(r.k, r.start.hour): r.increase for r in measures.increase(spark.createDataFrame(rows, "k string, ts timestamp, value double"), ["k"], "1 hour").collect()}
    assert got == {("a", 0): 5.0, ("a", 1): 4.0, ("b", 0): 0.0}


def test_merge_keeps_every_chunk(spark):
    rows = [("Silk", "c1", "short", 1), ("Silk", "c2", "a longer one", 2), ("SILK", "c2", "said otherwise", 1), ("SILK", "c3", "said otherwise", 2), ("Loom", "c1", "x", 1)]
    frame = spark.createDataFrame(rows, "entity string, chunk_id string, description string, seq long")
    names = spark.createDataFrame([("Silk", "Silk", ["Seide"]), ("SILK", "SILK", ["Soie", "silk"]), ("Loom", "Loom", None), ("Mill", "Mill Co", None)], "entity string, name string, aliases array<string>")
    into = spark.createDataFrame([("SILK", "Silk", 1), ("Mill", "Loom", 1)], "entity string, target string, at int")
    folded = entities.merged(frame, into)
    assert sorted((r.entity, r.chunk_id, r.description, r.seq) for r in folded.collect()) == [("Loom", "c1", "x", 1), ("Silk", "c1", "short", 1), ("Silk", "c2", "said otherwise", 2), ("Silk", "c3", "said otherwise", 3)]
    assert {r.entity: r.description for r in entities.visible(entities.retained(folded, spark.createDataFrame([("c2",), ("c3",)], "chunk_id string"))).collect()} == {"Silk": "short", "Loom": "x"}
    assert sorted(tuple(r) for r in entities.aliases(names, into).collect()) == [("Loom", "Mill Co"), ("Silk", "Seide"), ("Silk", "Soie")]
