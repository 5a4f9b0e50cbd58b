"""Structured Streaming: change feeds into the index, and windows over event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.shared import shared_dir

FEED = "seq long, op string, doc_id string, uri string, content string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_feed(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """JSON change files as they arrive; ``files_per_batch`` bounds a micro-batch."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).json(folder)


def run_feed(engine: Engine, feed: DataFrame, checkpoint: str, recompute: bool = True, once: bool = True) -> StreamingQuery:
    """Apply each micro-batch and spend one summary budget on it.

    A replayed batch is a set of no-ops, so results hold exactly once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        engine.apply(batch)
        if recompute:
            engine.recompute()

    writer = feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 seconds")).start()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream; ``folder`` is a folder or a pattern."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "event_type")
    return windows.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    windows = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return windows.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def collected(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming plan over what is there into the shared folder and return its rows."""
    path = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    write = "overwrite" if mode == "complete" else "append"

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode(write).parquet(f"{path}/rows")

    query = df.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
