"""Registered queries over figures, keyed streams, placement, resolution and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, payload, vectors
from ..operators import budgets, entities, facts, measures, placement, resolver
from ..sources.shared import cut
from ..streaming import feed, state
from .catalog import MEN, chunks, query, table

# The latency buckets of the dashboards.
EDGES = [1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0]


@query(
    f"WITH edge AS (SELECT CAST(unnest([{', '.join(map(str, EDGES))}]) AS DOUBLE) AS le UNION ALL SELECT CAST('inf' AS DOUBLE)), b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, edge GROUP BY ALL), "
    "w AS (SELECT *, lag(n) OVER o AS under, lag(le) OVER o AS start, max(n) OVER (PARTITION BY event_type) AS total FROM b WINDOW o AS (PARTITION BY event_type ORDER BY le)), "
    "q AS (SELECT *, q * total AS rank FROM w, (SELECT CAST(unnest([0.5, 0.95, 0.99]) AS DOUBLE) AS q) WHERE total > 0) "
    "SELECT event_type, q, round(CASE WHEN isinf(le) THEN start ELSE coalesce(start, 0) + (le - coalesce(start, 0)) * (rank - coalesce(under, 0)) / (n - coalesce(under, 0)) END, 4) AS x FROM q WHERE n >= rank AND (under IS NULL OR under < rank)"
)
def bucket_quantiles(spark, d):
    """Quantiles as the dashboards read them off cumulative buckets."""
    buckets = measures.bucket_counts(table(spark, d, "events"), ["event_type"], "value", EDGES)
    return measures.bucket_quantiles(buckets, ["event_type"], [0.5, 0.95, 0.99]).withColumn("x", F.round("x", 4))


@query(
    "WITH s AS (SELECT user_id, event_type, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, value) AS before FROM events), "
    "g AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END AS step FROM s) "
    "SELECT user_id, event_type, time_bucket(INTERVAL '1 hour', ts) AS start, round(sum(step), 2) AS increase FROM g GROUP BY ALL"
)
def counter_increase(spark, d):
    """Growth of each user's counters by hour; a fall is a reset."""
    samples = table(spark, d, "events").select("user_id", "event_type", "ts", "value")
    return measures.increase(samples, ["user_id", "event_type"], "1 hour").withColumn("increase", F.round("increase", 2))


@query(
    "WITH l AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), "
    "c AS (SELECT conv_id, turn, CASE WHEN rn = 1 THEN 'added' WHEN text = before THEN 'noop' ELSE 'updated' END AS change FROM l) "
    "SELECT CAST(conv_id AS VARCHAR) AS key, turn AS seq, change, count(*) FILTER (change <> 'noop') OVER (PARTITION BY conv_id ORDER BY turn) AS version FROM c"
)
def stream_versions(spark, d):
    """The turns of a conversation as successive contents of one document, through keyed state."""
    before = spark.conf.get(state.PROVIDER[0], None)
    state.use_rocksdb(spark)
    try:
        schema = "conv_id long, turn long, role string, text string"
        turns = spark.readStream.schema(schema).parquet(f"{d}/conversations*.parquet")
        changes = turns.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit("update").alias("op"), F.col("text").alias("content"))
        return feed.collected(state.document_versions(changes), "append").select("key", "seq", "change", "version")
    finally:
        spark.conf.unset(state.PROVIDER[0]) if before is None else spark.conf.set(state.PROVIDER[0], before)


@query(
    "WITH a AS (SELECT *, event_id + (event_id * 37) % 101 AS arrival FROM events), "
    "x AS (SELECT user_id, event_id, ts, 0 AS again, 4 * arrival AS arrival FROM a UNION ALL SELECT user_id, event_id, ts, 1, 4 * arrival + 21 FROM a WHERE event_type = 'error'), "
    "y AS (SELECT *, ts < coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) - INTERVAL '10 minutes' AS late FROM x) "
    "SELECT CAST(user_id AS VARCHAR) AS key, event_id, arrival, CASE WHEN late THEN 'late' WHEN again = 1 THEN 'repeat' ELSE 'taken' END AS verdict FROM y"
)
def stream_verdicts(spark, d):
    """Events that arrive out of order, and errors that come again, through keyed state: none is dropped."""
    before = spark.conf.get(state.PROVIDER[0], None)
    state.use_rocksdb(spark)
    try:
        events = spark.readStream.schema(feed.EVENTS).parquet(f"{d}/events*.parquet")
        arrival = 4 * (F.col("event_id") + (F.col("event_id") * 37) % 101)
        again = F.when(F.col("event_type") == "error", F.array(F.lit(0), F.lit(21))).otherwise(F.array(F.lit(0)))
        rows = events.select(F.col("user_id").alias("key"), "event_id", "ts", "value", arrival.alias("first"), F.explode(again).alias("after"))
        return feed.collected(state.judged(rows.withColumn("arrival", F.col("first") + F.col("after"))), "append").select("key", "event_id", "arrival", "verdict")
    finally:
        spark.conf.unset(state.PROVIDER[0]) if before is None else spark.conf.set(state.PROVIDER[0], before)


_PLAIN = "lower(regexp_replace(name, '[_&-]+', ' ', 'g'))"


@query(
    f"WITH {MEN}, x AS (SELECT name, chunk_id, description, doc_id, pos FROM men JOIN (SELECT chunk_id, pos FROM ch) USING (chunk_id)), "
    f"t AS (SELECT name, min(name) OVER (PARTITION BY {_PLAIN}) AS target FROM (SELECT DISTINCT name FROM men)), "
    "m AS (SELECT target AS entity, chunk_id, min(doc_id) AS doc_id, min(pos) AS pos, min(description) AS description FROM x JOIN t USING (name) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY length(description) DESC, doc_id, pos) AS rn FROM m), "
    "a AS (SELECT target AS entity, string_agg(name, ',' ORDER BY name) AS aliases FROM t WHERE lower(name) <> lower(target) GROUP BY target) "
    "SELECT entity, n, substring(sha256(description), 1, 32) AS description_hash, coalesce(aliases, '') AS aliases FROM (SELECT entity, count(*) AS n FROM m GROUP BY entity) JOIN (SELECT entity, description FROM r WHERE rn = 1) USING (entity) LEFT JOIN a USING (entity)"
)
def merged_entities(spark, d):
    """Names alike but for case, ``_``, ``&`` and ``-`` folded into the smallest: mentions, aliases and the visible description."""
    men = facts.mentions(chunks(spark, d), "pos")
    # What is shown of a description is its hash, so sentences are not carried along.
    key = F.struct(F.length("description").alias("size"), F.unhex(keys.content_hash(F.col("description"))).alias("hash"))
    rows = men.select(F.col("name").alias("entity"), "chunk_id", key.alias("description"), (F.col("doc_id") * (1 << 32) + F.col("pos")).alias("seq"))
    names = cut(men.select(F.col("name").alias("entity")).distinct()).select("entity", F.col("entity").alias("name"), F.array().cast("array<string>").alias("aliases"))
    plain = F.lower(F.regexp_replace("name", "[_&-]+", " "))
    alike = names.withColumn("_p", plain)
    into = cut(alike.join(alike.groupBy("_p").agg(F.min("name").alias("target")), "_p").filter("name <> target").select("entity", "target", F.lit(0).alias("at")))
    also = entities.aliases(names, into).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))
    shown = entities.visible(entities.merged(rows, into), F.col("description.size"), F.count("*").alias("n"))
    return shown.select("entity", "n", F.lower(F.hex("description.hash")).alias("description_hash")).join(also, "entity", "left").fillna("", ["aliases"])


_DAMAGED = "CASE event_id % 5 WHEN 1 THEN 'Here it is: ' || props || ' Done.' WHEN 2 THEN substring(props, 1, length(props) - 1) WHEN 3 THEN props || ' and }' WHEN 4 THEN NULL ELSE props END"


@query(
    f"WITH r AS (SELECT event_id, {_DAMAGED} AS raw FROM events), p AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(regexp_extract(raw, '(?s)\\{{.*\\}}')) THEN regexp_extract(raw, '(?s)\\{{.*\\}}') ELSE '{{}}' END AS j FROM r) "
    "SELECT event_id, j = '{}' AS empty, CAST(json_extract(j, '$.k') AS BIGINT) AS k FROM p"
)
def lenient_payloads(spark, d):
    """Payloads that stand in prose, are cut short or have stray braces."""
    rows = table(spark, d, "events").select("event_id", F.expr(_DAMAGED).alias("raw"))
    return rows.select("event_id", (payload.json_object(F.col("raw")) == "{}").alias("empty"), payload.loads(F.col("raw"), "k long").getField("k").alias("k"))


@query()
def placed_in_order(spark, d):
    """Names placed one after another: those of documents with even ids are members of their source's community, the others new."""
    ch = chunks(spark, d)
    men = facts.mentions(ch)
    known = men.filter("doc_id % 2 = 0").groupBy("name").agg(F.min("source").alias("comm"))
    new = men.select("name").distinct().join(known, "name", "left_anti")
    rel = facts.relations(facts.support(ch)).withColumn("weight", F.lit(1.0))
    return placement.place_all(new, facts.both_ways(rel), known, 200)


def _new_names(spark, d):
    """(names of the documents as new entities, no known ones); written once, as the resolver reads them several times."""
    men = facts.mentions(chunks(spark, d)).select("name").distinct()
    new = cut(men.select(F.col("name").alias("entity_id"), "name", vectors.hash_embedding(64)("name").alias("embedding")))
    return new, new.limit(0).withColumn("aliases", F.array().cast("array<string>"))


@query()
def resolved_names(spark, d):
    """Which names of the documents are others under the two thresholds, by hashed embeddings of the names."""
    return resolver.matches(*_new_names(spark, d), 0.86, 0.9, 20)


_BUDGETS = [0, 5, 50, 500, None]
_SINCE = "coalesce(list_filter(queue, lambda q: q.key = k.key)[1].since, r.step + 1)"


@query(f"""
WITH RECURSIVE t AS (SELECT CAST(dense_rank() OVER (ORDER BY date_trunc('week', ts)) AS BIGINT) AS step, CAST(user_id AS VARCHAR) AS key FROM events),
u AS (SELECT step, key, count(*) AS tokens FROM t GROUP BY ALL),
l AS (SELECT step, list({{'key': key, 'tokens': tokens}}) AS touched FROM u GROUP BY step),
b AS (SELECT unnest([0, 5, 50, 500, 1000000000]) AS budget),
r AS (
  SELECT budget, CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(since BIGINT, key VARCHAR, tokens BIGINT)[]) AS served, CAST([] AS STRUCT(since BIGINT, key VARCHAR, tokens BIGINT)[]) AS queue FROM b
  UNION ALL
  SELECT budget, step, list_slice(o, 1, budget), list_slice(o, budget + 1, len(o)) FROM (
    SELECT r.budget, l.step, list_sort(list_concat(list_transform(touched, lambda k: {{'since': {_SINCE}, 'key': k.key, 'tokens': k.tokens}}), list_filter(queue, lambda q: NOT list_contains(list_transform(touched, lambda k: k.key), q.key)))) AS o
    FROM r JOIN l ON l.step = r.step + 1)),
s AS (SELECT budget, step, unnest(served) AS x FROM r),
p AS (SELECT budget, (SELECT count(*) FROM s WHERE s.budget = b.budget) AS recomputed, (SELECT coalesce(sum(x.tokens), 0) FROM s WHERE s.budget = b.budget) AS tokens, (SELECT max(s.step - x.since) FROM s WHERE s.budget = b.budget) AS longest_wait, (SELECT len(queue) FROM r WHERE r.budget = b.budget ORDER BY step DESC LIMIT 1) AS dirty FROM b)
SELECT CASE WHEN budget < 1000000000 THEN CAST(budget AS BIGINT) END AS budget, recomputed, CAST(tokens AS BIGINT) AS tokens, longest_wait, dirty, NOT EXISTS (SELECT 1 FROM p AS o WHERE o.tokens <= p.tokens AND o.dirty <= p.dirty AND (o.tokens < p.tokens OR o.dirty < p.dirty)) AS best FROM p
""")
def budget_sweep(spark, d):
    """Users that the events of a week touch, recomputed under five budgets a week."""
    week = F.dense_rank().over(Window.orderBy("week")).cast("long")
    seen = table(spark, d, "events").groupBy(F.date_trunc("week", "ts").alias("week"), F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("tokens"))
    weeks = seen.select("week").distinct().withColumn("step", week)
    return budgets.points(budgets.serve(seen.join(weeks, "week"), _BUDGETS), _BUDGETS)


@query()
def resolution_thresholds(spark, d):
    """Merges of the names of the documents under six thresholds."""
    return resolver.thresholds(*_new_names(spark, d), [0.6, 0.7, 0.8, 0.86, 0.92, 0.98], 0.9, 20)
