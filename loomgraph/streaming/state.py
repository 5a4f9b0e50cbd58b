"""Keyed state for change feeds: document versions with chunk counters, and queues with timers.

Both run as ``transformWithStateInPandas`` over RocksDB state, so state lives with the
stream's checkpoint and a restart goes on from it.  Rows that come again, or after a
newer one of their key, change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
VERSIONS = "key string, seq long, change string, version long, chunks_added long, chunks_removed long, chunks_kept long"
DUE = "key string, due timestamp, changes long, first_seq long, last_seq long"
_CUT = re.compile(r"(?<=[.!?])[ \t\n\f\r]+")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _chunks(text: str) -> Counter:
    return Counter(_hash(s) for s in _CUT.split(text) if s)


class DocumentVersions(StatefulProcessor):
    """Versions of each key from (key, seq, op, content), and how often it holds each chunk.

    A null content is a delete, whatever ``op`` says.  Content that the active version
    has already and deletes of what is not there are ``noop``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._now = handle.getValueState("now", "seq long, version long, hash string, active boolean")
        self._held = handle.getMapState("chunks", "chunk string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        taken = frames[0] if len(frames) == 1 else pd.concat(frames)
        given = zip(taken["seq"].tolist(), taken["op"].tolist(), taken["content"].tolist(), strict=True)
        seq, version, held, active = self._now.get() or (None, 0, None, False)
        stored = chunks = None  # counts of the chunks as kept and as they are now: read and written once a call
        out = []
        for at, op, content in sorted(given, key=lambda r: (r[0], (0, r[2]) if isinstance(r[2], str) else (1, ""))):
            if seq is not None and at <= seq:
                continue  # a replay, or older than what is known
            seq = at
            gone = op == "delete" or not isinstance(content, str)
            mark = None if gone else _hash(content)
            if (gone and not active) or (active and mark == held):
                out.append((key[0], at, "noop", version, 0, 0, 0))
                continue
            if chunks is None:
                stored = chunks = Counter({k[0]: v[0] for k, v in self._held.iterator()}) if active else Counter()
            before, chunks = chunks, Counter() if gone else _chunks(content)
            change = "deleted" if gone else "updated" if version else "added"
            version, held, active = version + (not gone), mark, not gone
            kept = (before & chunks).total()
            out.append((key[0], at, change, version, chunks.total() - kept, before.total() - kept, kept))
        if chunks is not None:
            for chunk in stored.keys() - chunks.keys():
                self._held.removeKey((chunk,))
            for chunk, n in chunks.items():
                if stored[chunk] != n:
                    self._held.updateValue((chunk,), (n,))
        if out:
            self._now.update((seq, version, held, active))
        yield pd.DataFrame(out, columns=["key", "seq", "change", "version", "chunks_added", "chunks_removed", "chunks_kept"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


class DirtyQueue(StatefulProcessor):
    """A queue of touched keys from (key, seq, ts): each is due ``delay`` milliseconds after its first touch, by event time."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._queued = handle.getValueState("queued", "due long, changes long, first_seq long, last_seq long")
        self._seen = handle.getValueState("seen", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self._seen.get()[0] if self._seen.exists() else None
        taken = pd.concat(list(rows))
        taken = taken if seen is None else taken[taken["seq"] > seen]
        if len(taken):
            first, last, n = int(taken["seq"].min()), int(taken["seq"].max()), int(taken["seq"].nunique())
            self._seen.update((last,))
            if self._queued.exists():
                due, changes, earlier, _ = self._queued.get()
                self._queued.update((due, changes + n, earlier, last))
            else:
                due = int(taken["ts"].min().value // 1_000_000) + self.delay
                self._queued.update((due, n, first, last))
                self._handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._queued.exists():
            due, changes, first, last = self._queued.get()
            self._queued.clear()
            yield pd.DataFrame([(key[0], pd.Timestamp(due, unit="ms"), changes, first, last)], columns=["key", "due", "changes", "first_seq", "last_seq"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of several columns families needs this provider; set before a stream starts."""
    spark.conf.set(*PROVIDER)


def document_versions(changes: DataFrame) -> DataFrame:
    """One row for each change of a streaming feed (key, seq, op, content)."""
    rows = changes.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "op", "content").filter("key is not null and seq is not null")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=DocumentVersions(), outputStructType=VERSIONS, outputMode="Append", timeMode="None")


def due_keys(touches: DataFrame, delay: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """A row for each key of a streaming feed (key, seq, ts) once it is due."""
    delay_ms = int(pd.Timedelta(delay).value // 1_000_000)
    rows = touches.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts")).filter("key is not null and seq is not null and ts is not null")
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(statefulProcessor=DirtyQueue(delay_ms), outputStructType=DUE, outputMode="Append", timeMode="EventTime")


JUDGED = "key string, arrival long, event_id long, micros long, value double, verdict string"


class Punctuality(StatefulProcessor):
    """``taken``, ``late`` or ``repeat`` for each row of (key, arrival, event_id, micros, value), in order of arrival.

    A row is late if it is older than ``delay`` microseconds behind the newest row of its
    key that arrived before.  An id that the key has taken is a repeat; ids are forgotten
    once a row of their time would be late, so the state is bounded by the delay.
    """

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "micros long")
        self._taken = handle.getMapState("taken", "event_id long", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["arrival", "event_id", "micros"])
        newest = self._newest.get()[0] if self._newest.exists() else None
        known = {k[0]: v[0] for k, v in self._taken.iterator()}
        held = set(known)
        verdicts = []
        for event, micros in zip(given["event_id"].tolist(), given["micros"].tolist(), strict=True):
            if newest is not None and micros < newest - self.delay:
                verdicts.append("late")
            elif event in known:
                verdicts.append("repeat")
            else:
                verdicts.append("taken")
                known[event] = micros
            newest = micros if newest is None else max(newest, micros)
        self._newest.update((newest,))
        kept = {k: v for k, v in known.items() if v >= newest - self.delay}
        for event in held - kept.keys():
            self._taken.removeKey((event,))
        for event in kept.keys() - held:
            self._taken.updateValue((event,), (kept[event],))
        yield given.assign(verdict=verdicts)[["key", "arrival", "event_id", "micros", "value", "verdict"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def judged(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(key, arrival, event_id, ts, value, verdict) of a streaming feed (key, arrival, event_id, ts, value).

    Nothing is dropped: written with ``partitionBy("verdict")``, late rows and repeats are
    outputs of their own.  Rows without a key, arrival, id or time cannot be judged and are left out.
    """
    micros = int(pd.Timedelta(delay).value // 1000)
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("arrival").cast("long").alias("arrival"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("value").cast("double").alias("value"))
    rows = rows.filter("key is not null and arrival is not null and event_id is not null and micros is not null")
    made = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Punctuality(micros), outputStructType=JUDGED, outputMode="Append", timeMode="None")
    return made.select("key", "arrival", "event_id", F.timestamp_micros("micros").alias("ts"), "value", "verdict")
