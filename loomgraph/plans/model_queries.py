"""Registered queries over the offline model and the chunk lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, rules, text
from ..operators import facts
from .catalog import CH, CUT, MEN, chunks, query, table

_WORD = r"[\p{L}\p{N}\p{M}_]"
_EDGE = (r"(^|[^\p{L}\p{N}\p{M}_])", r"($|[^\p{L}\p{N}\p{M}_])")
_STOP = ", ".join(f"'{w}'" for w in rules.STOP)


def _matches(value: str, pattern: str) -> str:
    """``pattern`` between Unicode word edges; DuckDB's ``\\b`` knows ASCII only."""
    return f"regexp_matches(lower({value}), '{_EDGE[0]}({pattern.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b').replace(chr(92) + 'w', _WORD)}){_EDGE[1]}')"


def _cases(value: str, patterns) -> str:
    return " ".join(f"WHEN {_matches(value, p)} THEN '{name}'" for name, p in patterns)


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def estimated_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.model_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, substring(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 32) AS flat_hash FROM documents")
def flattened_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.content_hash(text.flat(F.col("text"))).alias("flat_hash"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(ltrim(line, '-')), '^\[[^\]]+\]\s*', ''), '\s*\[relations:[^\]]*\]\s*$', '')) AS line FROM "
       r"(SELECT doc_id, concat('- [', doc_id, '] ', trim(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200)), ' [relations: part of -> ', source, ']') AS line FROM documents)")
def cleaned_lines(spark, d):
    shown = F.trim(F.substring(text.flat(F.col("text")), 1, 200))
    line = F.concat(F.lit("- ["), F.col("doc_id").cast("string"), F.lit("] "), shown, F.lit(" [relations: part of -> "), F.col("source"), F.lit("]"))
    return table(spark, d, "documents").select("doc_id", rules.clean_line(line).alias("line"))


@query(f"WITH {CH} SELECT kind, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE {_cases('sentence', rules.VERBS)} ELSE 'related_to' END AS kind FROM ch) GROUP BY kind")
def sentence_relations(spark, d):
    kind = F.coalesce(rules.first_case(rules.VERBS, F.col("sentence")), F.lit("related_to"))
    return chunks(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT p_partkey, CASE {_cases('p_name', rules.NAME_TYPES)} ELSE 'concept' END AS kind FROM (SELECT p_partkey, p_name || ' ' || ['Institute', 'river', 'API', 'Summit', 'thing'][1 + p_partkey % 5] AS p_name FROM part)")
def typed_names(spark, d):
    tail = F.get(F.array(*[F.lit(x) for x in ("Institute", "river", "API", "Summit", "thing")]), (F.col("p_partkey") % 5).cast("int"))
    name = F.concat("p_name", F.lit(" "), tail)
    return table(spark, d, "part").select("p_partkey", rules.type_of(name, name).alias("kind"))


@query(
    "WITH g AS (SELECT r_regionkey, list(n_name || ' (nation): ' || n_nationkey ORDER BY n_name) AS e, list(n_name || ' --in--> ' || r_name ORDER BY n_name) AS r FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey), "
    "n AS (SELECT *, list_transform(e, lambda x: string_split(x, ' (')[1]) AS names FROM g) "
    "SELECT r_regionkey, substring(names[1] || ' and related entities', 1, 80) AS title, 'This community covers ' || len(names) || ' entities, centred on ' || array_to_string(names[1:3], ', ') || '. Recorded relations: ' || array_to_string(r[1:8], '; ') || '.' || "
    "CASE WHEN len(names) > 3 THEN ' It also includes ' || array_to_string(names[4:12], ', ') || '.' ELSE '' END AS summary FROM n"
)
def template_summaries(spark, d):
    both = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    entity = F.concat("n_name", F.lit(" (nation): "), F.col("n_nationkey").cast("string"))
    listed = both.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(entity)).alias("e"), F.array_sort(F.collect_list(F.concat("n_name", F.lit(" --in--> "), "r_name"))).alias("r"))
    return listed.select("r_regionkey", rules.summarise(F.col("e"), F.col("r")).alias("s")).select("r_regionkey", "s.*")


_SET = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '{_WORD}+')), lambda w: w NOT IN ({_STOP}))"


@query(
    f"WITH p AS (SELECT a.conv_id, a.turn, a.text AS q, string_split(b.text, chr(10)) AS l FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'), "
    r"x AS (SELECT conv_id, turn, q, i, trim(regexp_replace(trim(ltrim(trim(line), '-')), '^\[[^\]]+\]\s*', '')) AS line FROM (SELECT conv_id, turn, q, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM p)), "
    f"s AS (SELECT conv_id, turn, i, line, CAST(len(list_intersect({_SET('q')}, {_SET('line')})) AS DOUBLE) / sqrt(greatest(len({_SET('q')}) * len({_SET('line')}), 1)) AS score FROM x WHERE length(line) >= 8), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) AS rn, max(score) OVER (PARTITION BY conv_id, turn) AS top FROM s WHERE score > 0), "
    f"a AS (SELECT conv_id, turn, string_agg(line, ' ' ORDER BY rn) AS said FROM r WHERE top >= {rules.FLOOR} AND (rn = 1 OR (rn = 2 AND score >= {rules.NEAR_TIE} * top)) GROUP BY ALL) "
    f"SELECT p.conv_id, p.turn, coalesce(substring(said, 1, 400), '{rules.NO_ANSWER}') AS answer FROM p LEFT JOIN a USING (conv_id, turn)"
)
def extractive_answers(spark, d):
    """Each question of a user against the lines of the turn that follows."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    return turns.filter("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", "turn", rules.answer(F.col("text"), F.col("context")).alias("answer"))


@query(r"SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || c_name || ' & Co., Ltd.'), '[^\w\s]', ' ', 'g'), '\b(inc|incorporated|ltd|limited|llc|plc|corp|corporation|co|gmbh|sa|nv|ag|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM customer")
def plain_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.normal_name(F.concat(F.lit("The "), "c_name", F.lit(" & Co., Ltd."))).alias("plain"))


@query(f"WITH {CH} SELECT doc_id, string_agg(chunk_id, ',' ORDER BY pos) AS chunk_ids FROM ch GROUP BY doc_id")
def chunks_of_documents(spark, d):
    """The chunks of each document in order of place."""
    return facts.chunks_in_order(chunks(spark, d)).select("doc_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"WITH {MEN} SELECT chunk_id, count(DISTINCT name) AS n, min(name) AS first_name, max(name) AS last_name FROM men GROUP BY chunk_id")
def entities_of_chunks(spark, d):
    """The entities that each chunk mentions."""
    rows = facts.mentions(chunks(spark, d)).groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return rows.select("chunk_id", F.size("names").cast("long").alias("n"), F.array_min("names").alias("first_name"), F.array_max("names").alias("last_name"))


@query(f"WITH {MEN}, p AS (SELECT name, chunk_id, doc_id, pos FROM men JOIN (SELECT chunk_id, pos FROM ch) USING (chunk_id)) SELECT name, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) AS rn FROM p) WHERE rn = 1")
def first_seen_entities(spark, d):
    """The chunk in which each entity stands first."""
    ch = chunks(spark, d)
    met = facts.mentions(ch).join(ch.select("chunk_id", "pos"), "chunk_id")
    return met.groupBy("name").agg(F.min_by("chunk_id", F.struct("doc_id", "pos")).alias("chunk_id"))


@query(f"WITH {MEN}, pair AS (SELECT name, lower(name) AS into_name FROM men GROUP BY ALL), f AS (SELECT DISTINCT into_name AS name, chunk_id FROM men JOIN pair USING (name)) SELECT name, count(*) AS n, min(chunk_id) AS first_chunk FROM f GROUP BY name")
def folded_mentions(spark, d):
    """Mentions of names that differ in case only, folded into one."""
    men = facts.mentions(chunks(spark, d))
    into = men.select("name", F.lower("name").alias("into")).distinct()
    return facts.fold(men, into).groupBy("name").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"))


@query(
    f"WITH t AS (SELECT doc_id, source, {CUT} AS l FROM documents), u AS (SELECT source, count(*) AS n, CAST(sum(len(l)) AS BIGINT) AS sentences FROM t GROUP BY source) "
    "SELECT source, n, sentences, CAST(sum(n) OVER (ORDER BY source) AS BIGINT) AS upto FROM u"
)
def running_documents(spark, d):
    """Documents and sentences of each source, with the running count that the cost sweep plots."""
    by = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size(text.sentences(F.col("text")))).cast("long").alias("sentences"))
    return by.withColumn("upto", F.sum("n").over(Window.orderBy("source")))  # a row a source
