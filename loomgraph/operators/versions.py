"""Document versions: no-op test, upsert, latest change, scaled copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each document of a feed (seq, doc_id, …)."""
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))
    return changes.withColumn("_rn", last).filter("_rn = 1").drop("_rn")


def mark_noops(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """``noop``: a delete of a document that is not there, or content that the active version already has."""
    known = stored.select("doc_id", F.col("content_hash").alias("_hash"), (F.col("status") == "active").alias("_live"))
    joined = changes.join(known, "doc_id", "left")
    live = F.coalesce("_live", F.lit(False))
    same = live & F.coalesce(F.col("_hash") == keys.content_hash(F.col("content")), F.lit(False))
    return joined.withColumn("noop", F.when(F.col("op") == "delete", ~live).otherwise(same)).drop("_hash", "_live")


def upsert(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, version, status, content_hash) after adds and updates."""
    new = changes.select("doc_id", keys.content_hash(F.col("content")).alias("_new"))
    joined = stored.join(new, "doc_id", "full_outer")
    version = F.when(F.col("_new").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    status = F.when(F.col("_new").isNull(), F.col("status")).otherwise("active")
    return joined.select("doc_id", version.cast("long").alias("version"), status.alias("status"), F.coalesce("_new", "content_hash").alias("content_hash"))


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or replace by key, as an anti-join and a union."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def scale(docs: DataFrame, copies: int, names: list[tuple[str, str]]) -> DataFrame:
    """``copies`` of each document; from the second on, each name has the copy's letter where its pattern has ``{}``."""
    out = docs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    tag = F.char(F.lit(64) + F.col("copy"))
    made = F.col("text")
    for old, pattern in names:
        before, after = pattern.split("{}")
        made = F.replace(made, F.lit(old), F.concat(F.lit(before), tag, F.lit(after)))
    return out.withColumn("text", F.when(F.col("copy") == 0, F.col("text")).otherwise(made))
