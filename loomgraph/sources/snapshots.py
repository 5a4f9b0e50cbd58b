"""The state tables as row deltas: a commit writes what changed, readers merge.

    root/TABLE/v=N/w=WRITER   rows that version N put or removed (``_gone``)
    root/_versions/N          the writer whose version N is, and whether it is a base

A reader takes the deltas since the newest base and keeps the last row of each
key.  A commit compares the new tables with the version it began from, writes the
rows that differ, and then claims the next number by creating its marker, which
must not exist: of two writers that began from one version one wins, the other gets
``Conflict`` and its rows stay invisible, as do those of a writer that died.  After
``base_every`` deltas a commit writes whole tables, and ``vacuum`` removes what no
reader needs any more.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
VECTOR, NAMES = T.ArrayType(T.FloatType()), T.ArrayType(S)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TABLES = {
    "documents": _schema(doc_id=S, uri=S, content_hash=S, version=L, status=S, text=S, ingested_at=T.TimestampType(), updated_at=T.TimestampType()),
    "chunks": _schema(chunk_id=S, doc_id=S, text=S, pos=L, content_hash=S, embedding=VECTOR),
    "identity": _schema(entity_id=S, name=S, type=S, embedding=VECTOR, aliases=NAMES),
    "mention": _schema(entity_id=S, chunk_id=S, description=S, seq=L),
    "support": _schema(relation_id=S, source_id=S, target_id=S, kind=S, chunk_id=S, description=S, weight=D, seq=L),
    "membership": _schema(entity_id=S, comm=S),
    "communities": _schema(comm=S, level=L, title=S, summary=S, summary_hash=S, dirty=B, dirty_seq=L, dirty_since=T.TimestampType(), summarized=NAMES, embedding=VECTOR),
    "cache": _schema(cache_key=S, extraction=T.StringType()),
    "resolutions": _schema(seq=L, candidate=S, type=S, decision=S, matched=S, similarity=D, name_score=D, reason=S, chunk_id=S),
    "costs": _schema(seq=L, operation=S, tokens_in=L, tokens_out=L, usd=D, cache_hit=B, doc_id=S, comm=S),
}
#: Keys of the tables; the others are logs, which commits add to.
KEYS = {
    "documents": ["doc_id"],
    "chunks": ["chunk_id"],
    "identity": ["entity_id"],
    "mention": ["entity_id", "chunk_id"],
    "support": ["relation_id", "chunk_id"],
    "membership": ["entity_id"],
    "communities": ["comm"],
    "cache": ["cache_key"],
}


STALE = 600  # seconds after which a marker without content is of a dead writer


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


def changed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` has not or has otherwise, and, with ``_gone``, rows of ``old`` whose key ``new`` has not."""
    columns = new.columns
    before = old.select(*key, F.struct(*columns).alias("_old"))
    put = new.withColumn("_new", F.struct(*columns)).join(before, key, "left").filter(~F.col("_new").eqNullSafe(F.col("_old")))
    gone = old.join(new.select(*key), key, "left_anti").select(*[F.col(c) if c in key else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns])
    return put.select(*columns, F.lit(False).alias("_gone")).unionByName(gone.withColumn("_gone", F.lit(True)))


class Snapshots:
    """``read`` gives the tables of a version, ``commit`` writes the next one.

    ``begin`` fixes the version that is read, and from which the next commit goes out.
    """

    def __init__(self, spark: SparkSession, root: str, base_every: int = 10):
        self.spark, self.root, self.base_every = spark, root.rstrip("/"), base_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at: int | None = None

    # ------------------------------------------------------------ versions
    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _marker(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_versions/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "{}")
        finally:
            stream.close()

    def latest(self) -> int:
        """The newest version; a marker without content is of a writer that has not ended."""
        for version in sorted((int(n) for n in self._names(f"{self.root}/_versions") if n.isdigit()), reverse=True):
            if self._marker(version):
                return version
        return 0

    def version(self) -> int:
        return self.latest() if self._at is None else self._at

    def begin(self) -> int:
        self._at = self.latest()
        return self._at

    def end(self) -> None:
        self._at = None

    def _deltas(self, version: int) -> list[tuple[int, dict]]:
        """(version, marker) from the newest base on."""
        found = []
        while version:
            found.append((version, self._marker(version)))
            if found[-1][1]["base"]:
                break
            version -= 1
        return found[::-1]

    # ------------------------------------------------------------ reading
    def read(self, name: str, version: int | None = None) -> DataFrame:
        schema, key = TABLES[name], KEYS.get(name)
        deltas = self._deltas(self.version() if version is None else version)
        paths = [f"{self.root}/{name}/v={v}/w={m['writer']}" for v, m in deltas if name in m["tables"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("_gone", B), T.StructField("_v", L)])
        rows = self.spark.read.schema(stored).parquet(*paths)
        if key and len(paths) > 1:
            last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_v")))
            rows = rows.withColumn("_rn", last).filter("_rn = 1")
        return rows.filter("not _gone").select(*schema.names)

    # ------------------------------------------------------------ writing
    def commit(self, tables: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> int:
        """Make the given tables, and the rows ``added`` to others, the next version."""
        began = self.version()
        new, writer = began + 1, uuid.uuid4().hex
        base = began == 0 or sum(1 for _ in self._deltas(began)) >= self.base_every
        written = []
        for name, schema in TABLES.items():
            fit = lambda df: df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])  # noqa: B023, E731
            rows, more = tables.get(name), (added or {}).get(name)
            if rows is None and more is None and not base:
                continue
            old = self.read(name, began)
            if base or (rows is not None and name not in KEYS):
                whole = old if rows is None else fit(rows)
                delta = (whole if more is None else whole.unionByName(fit(more))).withColumn("_gone", F.lit(False))
            elif rows is None:
                delta = fit(more).withColumn("_gone", F.lit(False))
            else:
                delta = changed(old, fit(rows) if more is None else fit(rows).unionByName(fit(more)), KEYS[name])
            delta.withColumn("_v", F.lit(new).cast("long")).write.parquet(f"{self.root}/{name}/v={new}/w={writer}")
            written.append(name)
        self._claim(new, {"writer": writer, "base": base, "tables": written})
        if self._at is not None:
            self._at = new
        return new

    def _claim(self, version: int, marker: dict) -> None:
        path = self._path(f"{self.root}/_versions/{version}")
        if self._fs.exists(path) and not self._marker(version) and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > STALE:
            self._fs.delete(path, False)  # its writer died between creating and filling it
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            raise Conflict(f"version {version} is there already") from e
        stream.write(bytearray(json.dumps(marker).encode()))
        stream.close()

    def clear(self, keep: tuple[str, ...] = ()) -> int:
        """A base in which all tables but those of ``keep`` are empty."""
        every, self.base_every = self.base_every, 0
        try:
            return self.commit({n: self.spark.createDataFrame([], s) for n, s in TABLES.items() if n not in keep})
        finally:
            self.base_every = every

    def vacuum(self) -> int:
        """Delete the rows of versions before the newest base and of writers that did not win; returns how many folders went.

        Not while a writer is at work or a reader holds an older version.
        """
        deltas = self._deltas(self.latest())
        wanted = {(f"v={v}", f"w={m['writer']}") for v, m in deltas}
        gone = 0
        for name in TABLES:
            for v in self._names(f"{self.root}/{name}"):
                for w in self._names(f"{self.root}/{name}/{v}"):
                    if (v, w) not in wanted:
                        gone += bool(self._fs.delete(self._path(f"{self.root}/{name}/{v}/{w}"), True))
        return gone
