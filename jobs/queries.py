"""The jobs as registered queries: each runs twice into one new shared folder; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.catalog import MEN, SUP
from loomgraph.sources.shared import shared_dir

from . import index_feed, service_report


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive, and then nothing new."""
    out = _folder(spark, "job1_index_feed")
    for _ in range(2):
        index_feed.run(spark, f"{sf_dir}/documents*.parquet", out)
    return index_feed.everything(spark, out)


def job2_service_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days, and then all days again."""
    out = _folder(spark, "job2_service_report")
    for _ in range(2):
        service_report.run(spark, f"{sf_dir}/events.parquet", out)
    return service_report.everything(spark, out).withColumn("day", F.col("day").cast("string"))


JOB1_SQL = f"""
WITH {SUP.replace(' FROM documents', ' FROM (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL)')},
{MEN[MEN.rindex('men AS'):]},
n AS (SELECT 'documents_read' AS metric, count(*) AS v FROM documents UNION ALL SELECT 'documents_unchanged', count(*) FROM documents WHERE text IS NULL
  UNION ALL SELECT 'documents_added', count(*) FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'chunks_added', count(*) FROM ch
  UNION ALL SELECT 'mention_rows', count(*) FROM men UNION ALL SELECT 'support_rows', count(*) FROM sup)
SELECT 'document' AS kind, doc_id, substring(sha256(text), 1, 32) AS chunk_id, '1' AS name, 'active' AS other FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'mention', doc_id, chunk_id, name, NULL FROM men
UNION ALL SELECT 'support', doc_id, chunk_id, src, dst FROM sup
UNION ALL SELECT 'receipt', NULL, NULL, metric, CAST(v AS VARCHAR) FROM n WHERE v > 0
"""

_EDGES = "[" + ", ".join(str(e) for e in service_report.EDGES) + "]"
JOB2_SQL = f"""
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(event_type, 'unknown') AS operation, ts, value FROM events WHERE ts IS NOT NULL),
edge AS (SELECT CAST(unnest({_EDGES}) AS DOUBLE) AS le UNION ALL SELECT CAST('inf' AS DOUBLE)),
b AS (SELECT day, operation, le, count(*) FILTER (value <= le) AS n FROM e, edge GROUP BY ALL),
w AS (SELECT *, lag(n) OVER o AS under, lag(le) OVER o AS start, max(n) OVER (PARTITION BY day, operation) AS total FROM b WINDOW o AS (PARTITION BY day, operation ORDER BY le)),
q AS (SELECT *, q * total AS rank FROM w, (SELECT CAST(unnest([0.5, 0.95, 0.99]) AS DOUBLE) AS q) WHERE total > 0),
p AS (SELECT day, operation, 'p' || CAST(100 * q AS INTEGER) AS metric,
  round(CASE WHEN isinf(le) THEN start ELSE coalesce(start, 0) + (le - coalesce(start, 0)) * (rank - coalesce(under, 0)) / (n - coalesce(under, 0)) END, 4) AS value
  FROM q WHERE n >= rank AND (under IS NULL OR under < rank)),
r AS (SELECT day, operation, count(*) AS n FROM e GROUP BY day, operation, time_bucket(INTERVAL '5 minutes', ts)),
m AS (SELECT day, operation, CAST(sum(n) AS DOUBLE) AS n, round(max(n) / 300.0, 6) AS peak FROM r GROUP BY ALL),
t AS (SELECT day, operation, round(coalesce(sum(value), 0), 2) AS total FROM e GROUP BY ALL)
SELECT * FROM p
UNION ALL SELECT day, operation, 'events', n FROM m
UNION ALL SELECT day, operation, 'peak_rate', peak FROM m
UNION ALL SELECT day, operation, 'share_of_day', round(n / sum(n) OVER (PARTITION BY day), 4) FROM m
UNION ALL SELECT day, operation, 'total', total FROM t
UNION ALL SELECT day, operation, 'le_' || CASE WHEN isinf(le) THEN 'inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END, CAST(n AS DOUBLE) FROM b
"""

QUERIES = {"job1_index_feed": job1_index_feed, "job2_service_report": job2_service_report}
SQL = {"job1_index_feed": JOB1_SQL, "job2_service_report": JOB2_SQL}
