"""Keyed stream state against plain replays, over restarts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd

from loomgraph.streaming import state

FEED = "key string, seq long, op string, content string"


def plain_versions(rows):
    out, now = [], {}
    for key, seq, op, content in sorted(rows, key=lambda r: (r[0], r[1])):
        seen, version, held = now.get(key, (None, 0, None))
        if seen is not None and seq <= seen:
            continue
        new = None if op == "delete" else content
        if new == held:
            out.append((key, seq, "noop", version, 0, 0, 0))
        else:
            a, b = (Counter(s for s in state._CUT.split(x) if s) if x is not None else Counter() for x in (held, new))
            change = "deleted" if new is None else "updated" if version else "added"
            version += new is not None
            kept = (a & b).total()
            out.append((key, seq, change, version, b.total() - kept, a.total() - kept, kept))
        now[key] = (seq, version, new)
    return sorted(out)


def run(spark, folder, out, plan, schema):
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = plan(feed).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())


def test_versions_over_restarts(spark, tmp_path):
    state.use_rocksdb(spark)
    rng = random.Random(2)
    said = ["One. Two. Two.", "Two. Three.", "", "One. Two. Two. Four."]
    rows = [(f"d{rng.randrange(5)}", i, rng.choice(["update", "update", "add", "delete"]), rng.choice(said)) for i in range(60)]
    rows = [(k, i, op, None if op == "delete" else c) for k, i, op, c in rows]
    got = None
    for part in (rows[:20], rows[20:40] + rows[10:25], rows[40:], rows[:60:7]):  # with replays
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got = run(spark, tmp_path / "in", tmp_path / "out", state.document_versions, FEED)
    assert got == plain_versions(rows)


class Kept:
    """State of one key as a processor's handle gives it, with the calls counted."""

    def __init__(self):
        self.calls, self.value, self.items = 0, None, {}

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def _call(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._call(self.value is not None)

    def get(self):
        return self._call(self.value)

    def update(self, value):
        self.value = self._call(value)

    def iterator(self):
        return self._call(iter(list(self.items.items())))

    def updateValue(self, k, v):
        self._call(self.items.update({k: v}))

    def removeKey(self, k):
        self._call(self.items.pop(k))


def test_versions_of_one_call_write_the_last_chunks_only():
    kept, versions = Kept(), state.DocumentVersions()
    versions.init(kept)
    rows, calls, got = [("d", i, "update", None if i % 10 == 9 else f"A{i}. B{i}. C{i % 3}. C{i % 3}. D.") for i in range(48)], [], []
    for part in (rows[:24], rows[24:47], rows[30:47], rows[47:]):
        frames = [pd.DataFrame(p, columns=["key", "seq", "op", "content"]) for p in (part[::2], part[1::2]) if p]
        got += [tuple(r) for f in versions.handleInputRows(("d",), iter(frames), None) for r in f.itertuples(index=False)]
        calls.append(kept.calls - sum(calls))
    assert sorted(got) == plain_versions(rows)
    # the state is read, and what is left at the end written: four chunks each way at most
    assert calls[0] <= 2 + 4 and calls[1] <= 3 + 8 and calls[2] == 1 and calls[3] <= 3 + 8
    assert {k[0]: v[0] for k, v in kept.items.items()} == state._chunks(rows[-1][3])


def test_keys_fall_due_once(spark, tmp_path):
    state.use_rocksdb(spark)
    start = datetime(2024, 1, 1)
    at = lambda m: (start + timedelta(minutes=m)).isoformat()
    parts = [[("a", 1, at(0)), ("b", 2, at(1)), ("a", 3, at(2))], [("a", 3, at(2)), ("b", 4, at(8))], [("z", 5, at(30))], [("a", 6, at(31)), ("z", 7, at(60))]]
    got = None
    for part in parts:
        spark.createDataFrame(part, "key string, seq long, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got = run(spark, tmp_path / "in", tmp_path / "out", state.due_keys, "key string, seq long, ts timestamp")
    found = sorted((k, due.replace(tzinfo=None), n, first, last) for k, due, n, first, last in got)
    due = lambda m: start + timedelta(minutes=m)
    # the touch at 60 comes before the watermark has passed 40, so it is still of the queued change
    assert found == [("a", due(10), 2, 1, 3), ("a", due(41), 1, 6, 6), ("b", due(11), 2, 2, 4), ("z", due(40), 2, 5, 7)]


def plain_verdicts(rows, delay):
    out, newest, taken = [], {}, {}
    for key, arrival, event, at, value in sorted(rows, key=lambda r: r[1:3]):
        before = newest.get(key)
        late = before is not None and at < before - delay
        out.append((key, arrival, event, at, value, "late" if late else "repeat" if event in taken.get(key, ()) else "taken"))
        if not late:
            taken.setdefault(key, set()).add(event)
        newest[key] = at if before is None else max(before, at)
    return sorted(out)


def test_late_rows_and_repeats_are_outputs(spark, tmp_path):
    state.use_rocksdb(spark)
    rng, start = random.Random(4), datetime(2024, 1, 1)
    times = [start + timedelta(minutes=i + rng.randrange(-25, 5)) for i in range(90)]
    rows = [(f"u{rng.randrange(3)}", i, i, times[i], float(i % 7)) for i in range(90)]
    rows += [(k, n, e, at, v) for n, (k, _, e, at, v) in enumerate(rows[20:70:5], 90)]  # come again, soon or too late
    schema = "key string, arrival long, event_id long, ts timestamp, value double"
    nulls = [(None, 0, 0, times[0], 1.0), ("u0", 0, None, times[0], 1.0), ("u0", 0, 0, None, 1.0)]
    rows = [(k, 2 * (e if n < 90 else e + 3) + (n >= 90), e, at, v) for n, (k, _, e, at, v) in enumerate(rows)]
    rows.sort(key=lambda r: r[1])
    for part in (rows[:30], rows[30:31] + nulls, rows[31:70], rows[70:]):
        feed = [(k, n, e, at and at.isoformat(), v) for k, n, e, at, v in part]
        spark.createDataFrame(feed, schema.replace("ts timestamp", "ts string")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = state.judged(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        query = stream.writeStream.partitionBy("verdict").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
    want = plain_verdicts(rows, timedelta(minutes=10))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.key, r.arrival, r.event_id, r.ts.replace(tzinfo=None), r.value, r.verdict) for r in got.collect()) == want
    assert {r[-1] for r in want} == {"taken", "late", "repeat"} == {p.name.split("=")[1] for p in (tmp_path / "out").glob("verdict=*")}
    totals = Counter()
    for key, _, _, at, value, verdict in want:
        totals[(key, at.hour)] += value if verdict == "taken" else 0
    hours = spark.read.parquet(str(tmp_path / "out" / "verdict=taken")).selectExpr("key", "hour(ts) as h", "value").groupBy("key", "h").sum("value").collect()
    assert {(r.key, r.h): r["sum(value)"] for r in hours} == {k: v for k, v in totals.items() if any(w[0] == k[0] and w[3].hour == k[1] and w[-1] == "taken" for w in want)}
