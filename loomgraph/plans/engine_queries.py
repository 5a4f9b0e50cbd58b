"""The whole engine as registered queries: a change feed applied, with the SQL of what must be left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources.shared import shared_dir
from .catalog import P, query, table
from .engine import Engine, Settings


def phrase_model(column):
    """A model that SQL can express: capitalised phrases are concepts, neighbouring ones are related."""
    names = text.phrases(column)
    entity = lambda n: F.struct(n.alias("name"), F.lit("concept").alias("type"), n.alias("description"))
    pairs = F.arrays_zip(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))).alias("a"), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))).alias("b"))
    related = lambda p: F.struct(p["a"].alias("source"), p["b"].alias("target"), F.lit("related_to").alias("kind"), F.lit("").alias("description"))
    return F.struct(F.transform(F.array_distinct(names), entity).alias("entities"), F.transform(F.array_distinct(pairs), related).alias("relations")).cast(rules.EXTRACTION)


def _feed(spark, d):
    turns = table(spark, d, "conversations")
    doc = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role", doc.alias("doc_id"), F.lit(None).cast("string").alias("uri"), F.col("text").alias("content"))


_KEY = lambda n: f"substring(sha256(lower({n}) || '|concept'), 1, 24)"
_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _facts_sql(content: str, where: str) -> str:
    """CTEs of documents t, chunks ch, phrases n, mentions men and support sup of the turns that ``where`` keeps."""
    return rf"""
WITH t AS (SELECT concat(conv_id, '-', turn) AS doc_id, role, {content} AS content, text FROM conversations),
p AS (SELECT doc_id, i, unnest(l) AS para, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, 1 AS i, string_split_regex({_STRIP('content')}, '\n[ \t\x0B\f\r]*\n\s*') AS l FROM t WHERE {where})),
u AS (SELECT doc_id, j, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, j, CASE WHEN length(para) <= 1 THEN [para] ELSE string_split(regexp_replace(para, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)) END AS l FROM (SELECT doc_id, j, {_STRIP('para')} AS para FROM p))),
c AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s ORDER BY j, k) - 1 AS occ FROM (SELECT doc_id, j, k, {_STRIP('s')} AS s FROM u) WHERE s <> ''),
ch AS (SELECT doc_id, s, concat(doc_id, '::', substring(sha256(s), 1, 16), CASE WHEN occ > 0 THEN '::' || occ ELSE '' END) AS chunk_id FROM c),
n AS (SELECT chunk_id, regexp_extract_all(s, {P}) AS l FROM ch),
men AS (SELECT DISTINCT {_KEY('name')} AS entity_id, chunk_id FROM (SELECT chunk_id, unnest(l) AS name FROM n)),
sup AS (SELECT DISTINCT substring(sha256(concat_ws('|', a, b, 'related_to')), 1, 24) AS relation_id, chunk_id FROM (SELECT chunk_id, {_KEY('l[i]')} AS a, {_KEY('l[i + 1]')} AS b FROM (SELECT chunk_id, l, unnest(range(1, len(l))) AS i FROM n)) WHERE a <> b)"""


@query(_facts_sql("CASE role WHEN 'assistant' THEN text || ' Edited Twice.' ELSE text END", "role <> 'user'") + """
SELECT 'document' AS kind, doc_id AS key, CASE role WHEN 'user' THEN 'deleted' ELSE 'active' END AS value, CASE role WHEN 'assistant' THEN 2 ELSE 1 END AS n FROM t
UNION ALL SELECT 'chunk', chunk_id, substring(sha256(s), 1, 32), 1 FROM ch
UNION ALL SELECT 'entity', entity_id, min(chunk_id), count(*) FROM men GROUP BY entity_id
UNION ALL SELECT 'relation', relation_id, min(chunk_id), count(*) FROM sup GROUP BY relation_id
UNION ALL SELECT 'homeless', 'entities', NULL, 0 UNION ALL SELECT 'integrity', 'ok', 'true', 0
""")
def engine_under_change(spark, d):
    """Turns of conversations as documents: all are added, then the users' are deleted and the assistants' edited, and the edit comes again.

    What is left of documents, chunks, entities and relations, the entities without a community, and the integrity report.
    """
    engine = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", Settings(chunk_size=1, tau_sim=2.0, max_community=24), model=phrase_model)
    feed = _feed(spark, d)
    engine.apply(feed.select("seq", F.lit("add").alias("op"), "doc_id", "uri", "content"))
    op = F.when(F.col("role") == "user", "delete").otherwise("update")
    edited = F.when(F.col("role") == "assistant", F.concat("content", F.lit(" Edited Twice."))).otherwise(F.col("content"))
    change = feed.select("seq", op.alias("op"), "doc_id", "uri", edited.alias("content"))
    for _ in range(2):
        engine.apply(change)
    none, n = F.lit(None).cast("string"), lambda x: F.lit(x).cast("long").alias("n")
    documents = engine.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), F.col("status").alias("value"), F.col("version").alias("n"))
    chunks = engine.table("chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.col("content_hash").alias("value"), n(1))
    count = [F.min("chunk_id").alias("value"), F.countDistinct("chunk_id").alias("n")]
    entities = engine.table("mention").groupBy(F.lit("entity").alias("kind"), F.col("entity_id").alias("key")).agg(*count)
    relations = engine.table("support").groupBy(F.lit("relation").alias("kind"), F.col("relation_id").alias("key")).agg(*count)
    homeless = engine.table("mention").join(engine.table("membership"), "entity_id", "left_anti").agg(F.countDistinct("entity_id").alias("n")).select(F.lit("homeless").alias("kind"), F.lit("entities").alias("key"), none.alias("value"), "n")
    report = engine.integrity().select(F.lit("integrity").alias("kind"), F.lit("ok").alias("key"), F.col("ok").cast("string").alias("value"), (F.col("orphans") + F.col("unsupported") + F.col("ghosts") + F.col("dangling")).alias("n"))
    return documents.unionByName(chunks).unionByName(entities).unionByName(relations).unionByName(homeless).unionByName(report)


_PAID = "greatest(1, length({}) // 4)"


@query(_facts_sql("text", "true") + f""",
x AS (SELECT count(*) AS calls, count(*) - count(DISTINCT s) AS hits FROM ch),
y AS (SELECT sum({_PAID.format("s")}) AS paid FROM (SELECT DISTINCT s FROM ch)),
v AS (SELECT sum({_PAID.format("s")}) AS chunks FROM ch),
w AS (SELECT sum(greatest(1, (2 * size + 2) // 4)) AS names FROM (SELECT max(length(name)) AS size FROM (SELECT chunk_id, unnest(l) AS name FROM n) GROUP BY lower(name)))
SELECT 'extract' AS operation, CAST(hits AS BIGINT) AS cache_hits, CAST(paid AS BIGINT) AS tokens_in FROM x, y
UNION ALL SELECT 'embed', 0, CAST(chunks + names AS BIGINT) FROM v, w
""")
def metered_build(spark, d):
    """Cost rows of adding all turns: a text is extracted once and then a hit, chunks and entities are embedded."""
    engine = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", Settings(chunk_size=1, tau_sim=2.0, max_community=24), model=phrase_model)
    engine.apply(_feed(spark, d).select("seq", F.lit("add").alias("op"), "doc_id", "uri", "content"))
    return engine.table("costs").groupBy("operation").agg(F.count_if("cache_hit").alias("cache_hits"), F.sum("tokens_in").alias("tokens_in"))
