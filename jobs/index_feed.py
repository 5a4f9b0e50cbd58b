"""Keep the facts of a document collection up to date as documents arrive.

    spark-submit jobs/index_feed.py --config jobs/index_feed.json --source PATH --out PATH

A file stream reads what is new below ``source`` (Parquet: doc_id, text, source, …).
Each micro-batch adds one partition ``batch=N`` to each of four tables below ``out``:

* ``documents``: the versions of the documents that the batch changed
* ``chunks``: the content-addressed chunks of those documents
* ``facts``: what the chunks mention and relate, further partitioned by kind
* ``receipts``: what the batch did, as (metric, value)

A document's newest row decides which of its chunks and facts hold (``current``), so an
update or withdrawal writes rows in proportion to itself.  A batch is a function of
its files and of earlier batches, and it overwrites its own partitions only: a
batch that is replayed after a failure gives the same tables.  ``checkpoint``
belongs to ``out``; remove both or none.

Cases: a null text withdraws its document; content that the active version already
has and withdrawals of unknown documents change nothing; of rows of one document in
a batch the one with the greatest content hash counts; a null ``doc_id`` is left out;
empty input leaves empty tables; other columns are ignored.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomgraph.functions import keys
from loomgraph.operators import facts, versions

log = logging.getLogger("index_feed")

SOURCE = "doc_id long, text string, source string"
TABLES = {
    "documents": ("doc_id long, source string, content_hash string, version long, status string, batch long", ["batch"]),
    "chunks": ("doc_id long, source string, pos long, chunk_id string, sentence string, batch long", ["batch"]),
    "facts": ("doc_id long, source string, chunk_id string, name string, other string, batch long, kind string", ["batch", "kind"]),
    "receipts": ("metric string, value long, batch long", ["batch"]),
}


def stored(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name][0]).parquet(f"{out}/{name}")


def _put(rows: DataFrame, out: str, name: str, batch: int) -> None:
    """Write the rows as the batch's partition of a table, in place of what a failed attempt left."""
    schema, parts = TABLES[name]
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    placed = rows.withColumn("batch", F.lit(batch).cast("long")).select(*columns)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{out}/{name}")


def newest(documents: DataFrame) -> DataFrame:
    """The newest row of each document."""
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch")))
    return documents.withColumn("_rn", last).filter("_rn = 1").drop("_rn")


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of ``chunks`` or ``facts`` that belong to the newest versions of active documents."""
    live = newest(stored(spark, out, "documents")).filter("status = 'active'").select("doc_id", "batch")
    return stored(spark, out, name).join(live, ["doc_id", "batch"], "left_semi")


def _changes(rows: DataFrame) -> DataFrame:
    op = F.when(F.col("text").isNull(), "delete").otherwise("update")
    hashed = rows.filter("doc_id is not null").select("doc_id", "source", op.alias("op"), F.col("text").alias("content"), keys.content_hash(F.col("text")).alias("seq"))
    return versions.latest(hashed)


def apply_batch(rows: DataFrame, batch: int, out: str) -> None:
    spark = rows.sparkSession
    asked = rows.select("doc_id").distinct()
    before = newest(stored(spark, out, "documents").filter(F.col("batch") < batch).join(asked, "doc_id", "left_semi"))
    changes = versions.mark_noops(_changes(rows), before)
    held = before.select("doc_id", F.col("version").alias("_version"), F.col("source").alias("_source"))
    joined = changes.join(held, "doc_id", "left")
    deleted = F.col("op") == "delete"
    version = F.coalesce("_version", F.lit(0)) + F.when(deleted, 0).otherwise(1)
    status = F.when(deleted, "deleted").otherwise("active")
    made = joined.filter(~F.col("noop")).select("doc_id", F.coalesce("source", "_source").alias("source"), F.col("seq").alias("content_hash"), version.cast("long").alias("version"), status.alias("status"))
    _put(made, out, "documents", batch)

    # From here on the written partition says which documents changed; texts are read once more.
    changed = stored(spark, out, "documents").filter(F.col("batch") == batch)
    active = changed.filter("status = 'active'").select("doc_id", "source", "content_hash")
    texts = rows.select("doc_id", "text").withColumn("content_hash", keys.content_hash(F.col("text"))).dropDuplicates(["doc_id", "content_hash"])
    _put(facts.sentence_chunks(active.join(texts, ["doc_id", "content_hash"])), out, "chunks", batch)

    chunks = stored(spark, out, "chunks").filter(F.col("batch") == batch)
    mentions = facts.mentions(chunks).select("doc_id", "source", "chunk_id", "name", F.lit(None).cast("string").alias("other"), F.lit("mention").alias("kind"))
    support = facts.support(chunks).select("doc_id", "source", "chunk_id", F.col("src").alias("name"), F.col("dst").alias("other"), F.lit("support").alias("kind"))
    _put(mentions.unionByName(support), out, "facts", batch)

    old = before.filter("status = 'active'").join(changed.select("doc_id"), "doc_id", "left_semi").select("doc_id", "batch")
    gone = stored(spark, out, "chunks").join(old, ["doc_id", "batch"], "left_semi")
    parts = [
        rows.select(F.lit("documents_read").alias("metric")),
        changes.filter("noop").select(F.lit("documents_unchanged").alias("metric")),
        changed.select(F.when(F.col("status") == "deleted", "documents_deleted").when(F.col("version") == 1, "documents_added").otherwise("documents_updated").alias("metric")),
        facts.diff_chunks(gone, chunks).select(F.concat(F.lit("chunks_"), "change").alias("metric")),
        stored(spark, out, "facts").filter(F.col("batch") == batch).select(F.concat("kind", F.lit("_rows")).alias("metric")),
    ]
    counted = None
    for part in parts:
        counted = part if counted is None else counted.unionByName(part)
    _put(counted.groupBy("metric").agg(F.count("*").alias("value")), out, "receipts", batch)


def run(spark: SparkSession, source: str, out: str, checkpoint: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """Take in what is new below ``source``; returns the receipts of all batches so far."""
    for name, (schema, parts) in TABLES.items():
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(f"{out}/{name}")
    feed = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = feed.writeStream.foreachBatch(lambda rows, batch: apply_batch(rows, batch, out))
    query = writer.option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    ran = sorted({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    log.info("read %d rows from %s in %d batches", sum(p["numInputRows"] for p in query.recentProgress), source, len(ran))
    receipts = stored(spark, out, "receipts")
    for r in receipts.filter(F.col("batch").isin(ran)).orderBy("batch", "metric").collect():  # a few rows a batch of this run
        log.info("wrote below %s, batch %d: %s %d", out, r.batch, r.metric, r.value)
    return receipts


def everything(spark: SparkSession, out: str) -> DataFrame:
    """(kind, doc_id, chunk_id, name, other): active and withdrawn documents, the facts that hold, and the sums of the receipts."""
    text = lambda c: F.col(c).cast("string")
    documents = newest(stored(spark, out, "documents")).select(F.lit("document").alias("kind"), "doc_id", F.col("content_hash").alias("chunk_id"), text("version").alias("name"), F.col("status").alias("other"))
    held = current(spark, out, "facts").select("kind", "doc_id", "chunk_id", "name", "other")
    sums = stored(spark, out, "receipts").groupBy("metric").agg(F.sum("value").alias("value"))
    receipts = sums.select(F.lit("receipt").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"), F.col("metric").alias("name"), text("value").alias("other"))
    return documents.unionByName(held).unionByName(receipts)


def main() -> None:
    top = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    top.add_argument("--config", help="JSON file with any of the other arguments")
    for name in ("source", "out", "checkpoint"):
        top.add_argument(f"--{name}")
    top.add_argument("--files_per_batch", type=int)
    said = {k: v for k, v in vars(top.parse_args()).items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_feed").getOrCreate()
    try:
        config = said.pop("config", None)
        known = spark.read.json(config, multiLine=True).first().asDict() if config else {}
        run(spark, **(known | said))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
