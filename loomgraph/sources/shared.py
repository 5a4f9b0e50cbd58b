"""The shared folder for intermediate tables and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-shared-")
    return _FALLBACK[app]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan by a written table.

    A checkpoint would hand the size estimate of the old plan on; estimates of
    joins are products, so they would grow in length with every turn.  The size of
    a written table is known.
    """
    path = f"{shared_dir(df.sparkSession)}/loomgraph-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
