"""Daily service figures from the event log: volumes, rates and latency quantiles.

    spark-submit jobs/service_report.py --config jobs/service_report.json --events PATH --out PATH --first 2024-01-01 --last 2024-01-31

Writes two tables, partitioned by day:

* ``buckets``: cumulative latency buckets of each operation
* ``metrics``: (operation, metric, value): events, share_of_day, total, peak_rate (events a second in the busiest
  window) and the quantiles p50, p95, … read off the buckets as the dashboards do

Only the partitions of the days asked for are overwritten, so a day is rerun or
filled in later with the same result, and other days stay as they are.

Cases: null times are left out; a null operation is ``unknown``; null values count as
events and are in no bucket, total or quantile; ``first`` and ``last`` are whole days
and both included, and either may be missing; a range without events writes
nothing; other columns are ignored.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomgraph.operators import measures

log = logging.getLogger("service_report")

# The latency buckets and quantiles of the dashboards.
EDGES = [1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0]
QUANTILES = [0.5, 0.95, 0.99]
BUCKETS = "operation string, le double, n long, day date"
METRICS = "operation string, metric string, value double, day date"


def _events(spark: SparkSession, path: str, first: str | None, last: str | None) -> DataFrame:
    rows = spark.read.parquet(path).filter("ts is not null")
    if first:
        rows = rows.filter(F.col("ts") >= F.lit(first).cast("date"))
    if last:
        rows = rows.filter(F.col("ts") < F.date_add(F.lit(last).cast("date"), 1))
    return rows.select(F.coalesce("event_type", F.lit("unknown")).alias("operation"), "ts", F.col("value").cast("double").alias("value"), F.to_date("ts").alias("day"))


def _put(rows: DataFrame, path: str) -> None:
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def run(spark: SparkSession, events: str, out: str, first: str | None = None, last: str | None = None, edges: list[float] | None = None, quantiles: list[float] | None = None, window: str = "5 minutes") -> DataFrame:
    """Write the days from ``first`` to ``last``; returns the metrics of all days so far."""
    by, edges = ["day", "operation"], list(edges or EDGES)
    rows = _events(spark, events, first, last)
    _put(measures.bucket_counts(rows, by, "value", edges), f"{out}/buckets")

    days = rows.select("day").distinct()
    written = spark.read.schema(BUCKETS).parquet(f"{out}/buckets").join(days, "day", "left_semi")
    quantile = measures.bucket_quantiles(written, by, list(quantiles or QUANTILES))
    quantile = quantile.select(*by, F.concat(F.lit("p"), F.format_string("%s", (F.col("q") * 100).cast("decimal(9,3)").cast("double").cast("string"))).alias("metric"), F.round("x", 4).alias("value"))
    quantile = quantile.withColumn("metric", F.regexp_replace("metric", r"\.0$", ""))
    seconds = F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {window}")) - F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    busy = rows.groupBy(*by, F.window("ts", window)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    each = busy.groupBy(*by).agg(F.sum("n").cast("double").alias("events"), F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("total"), F.round(F.max("n") / seconds, 6).alias("peak_rate"))
    whole = each.groupBy("day").agg(F.sum("events").alias("_all"))
    share = F.round(F.col("events") / F.col("_all"), 4)
    long = each.join(whole, "day").select(*by, F.explode(F.create_map(F.lit("events"), "events", F.lit("total"), "total", F.lit("peak_rate"), "peak_rate", F.lit("share_of_day"), share)).alias("metric", "value"))
    _put(long.unionByName(quantile), f"{out}/metrics")

    metrics = spark.read.schema(METRICS).parquet(f"{out}/metrics")
    read, n_days = (int(x or 0) for x in metrics.join(days, "day", "left_semi").filter("metric = 'events'").agg(F.sum("value"), F.countDistinct("day")).first())
    log.info("read %d events from %s, wrote %d days below %s", read, events, n_days, out)
    return metrics


def everything(spark: SparkSession, out: str) -> DataFrame:
    """(day, operation, metric, value): all metrics and, as ``le_EDGE``, all buckets."""
    buckets = spark.read.schema(BUCKETS).parquet(f"{out}/buckets")
    edge = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("long").cast("string"))
    rows = buckets.select("day", "operation", F.concat(F.lit("le_"), edge).alias("metric"), F.col("n").cast("double").alias("value"))
    return spark.read.schema(METRICS).parquet(f"{out}/metrics").select("day", "operation", "metric", "value").unionByName(rows)


def main() -> None:
    top = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    top.add_argument("--config", help="JSON file with any of the other arguments")
    for name in ("events", "out", "first", "last", "window"):
        top.add_argument(f"--{name}")
    said = {k: v for k, v in vars(top.parse_args()).items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("service_report").getOrCreate()
    try:
        config = said.pop("config", None)
        known = spark.read.json(config, multiLine=True).first().asDict() if config else {}
        run(spark, **(known | said))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
