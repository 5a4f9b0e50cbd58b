"""Shared intermediate tables.

Long jobs cut their lineage by writing narrow tables to the folder that the
cluster names in ``spark.checkpoint.dir``; every executor can read them again
after another executor is lost.  The shuffle files of such a write are of no
more use once it has ended, so Spark's own clean-up is switched on for it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Scope:
    """The tables and broadcasts of one run; those of other runs are not its business."""

    outer: Scope | None = None
    paths: list[str] = field(default_factory=list)
    shared: list[Broadcast] = field(default_factory=list)


_FALLBACK: dict[str, str] = {}
_NOW: ContextVar[Scope] = ContextVar("scope", default=Scope())
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that a Python worker is sent at once; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on one machine."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _FALLBACK[app]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged and shared in between, and nothing else."""
    token = _NOW.set(Scope(_NOW.get()))
    try:
        yield
    finally:
        release(spark)
        _NOW.reset(token)


def new_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new folder that lives as long as the scope, or, with ``outer``, as the scope around it."""
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}/{name}"
    now = _NOW.get()
    (now.outer if outer and now.outer else now).paths.append(path)
    return path


def stage(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; see ``new_path``."""
    spark = df.sparkSession
    path = new_path(spark, name, outer)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of proven size until ``release``, and keep the batches of Python workers small."""
    small_batches(spark)
    shared = _NOW.get().shared
    shared.append(spark.sparkContext.broadcast(value))
    return shared[-1]


def forget(shared: Broadcast) -> None:
    """Destroy a broadcast whose jobs have ended."""
    _NOW.get().shared.remove(shared)
    shared.destroy()


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete the tables staged and the broadcasts shared in this scope."""
    now = _NOW.get()
    while now.shared:
        now.shared.pop().destroy()
    while now.paths:
        _delete(spark, now.paths.pop())


def drop(spark: SparkSession, path: str) -> None:
    """Delete one path of this scope."""
    _NOW.get().paths.remove(path)
    _delete(spark, path)
