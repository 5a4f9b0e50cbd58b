"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, packing, text, vectors
from ..operators import facts, graph, measures, ranking, versions
from ..streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d):
    return facts.sentence_chunks(table(spark, d, "documents"))


P = r"'\p{Lu}[\p{L}\p{N}_&\-]*(?: \p{Lu}[\p{L}\p{N}_&\-]*)*'"
CUT = r"string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1))"
CH = f"""sent AS (SELECT doc_id, source, CAST(i - 1 AS BIGINT) AS pos, s AS sentence FROM
  (SELECT doc_id, source, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, source, {CUT} AS l FROM documents)) WHERE s <> ''),
ch AS (SELECT *, concat(doc_id, '::', substring(sha256(sentence), 1, 16), CASE WHEN occ > 0 THEN '::' || occ ELSE '' END) AS chunk_id FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) - 1 AS occ FROM sent))"""
MEN = CH + f""",
men AS (SELECT name, chunk_id, doc_id, source, sentence AS description FROM (SELECT *, unnest(list_distinct(regexp_extract_all(sentence, {P}))) AS name FROM ch))"""
SUP = CH + f""",
sup AS (SELECT DISTINCT src, dst, chunk_id, doc_id, source FROM (SELECT *, l[i] AS src, l[i + 1] AS dst FROM
  (SELECT *, unnest(range(1, len(l))) AS i FROM (SELECT *, regexp_extract_all(sentence, {P}) AS l FROM ch))) WHERE src <> dst)"""
REL = SUP + """,
rel AS (SELECT src, dst, count(DISTINCT chunk_id) AS support FROM sup GROUP BY ALL),
nbr AS (SELECT src AS name, dst AS other, support FROM rel UNION ALL SELECT dst, src, support FROM rel),
deg AS (SELECT name, count(*) AS degree FROM nbr GROUP BY name)"""

# ---------------------------------------------------------------- documents and chunks


@query("SELECT doc_id, substring(sha256(text), 1, 32) AS content_hash FROM documents")
def doc_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT substring(sha256(text), 1, 32) AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_docs(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", keys.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


@query(r"""SELECT page_id, CASE WHEN s <> '' THEN s ELSE substring(sha256(url), 1, 12) END AS slug FROM (SELECT page_id, url,
  substring(regexp_replace(regexp_replace(lower(regexp_replace(string_split(url, '/')[-1], '^(.+)\.[^.]*$', '\1')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS s FROM pages)""")
def page_slug(spark, d):
    return table(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query(f"WITH {CH} SELECT doc_id, pos, sentence FROM ch")
def chunk_documents(spark, d):
    return chunks(spark, d).select("doc_id", "pos", "sentence")


@query(f"WITH {CH} SELECT doc_id, pos, CAST(occ AS BIGINT) AS occ, chunk_id FROM ch")
def chunk_occurrence_ids(spark, d):
    return chunks(spark, d).select("doc_id", "pos", "occ", "chunk_id")


def _walk(src: str, joiner: str, width: int, size: int) -> str:
    """SQL of greedy packing of ``src`` (g, i, s): each unit's next start is looked up, the starts are walked from the first on."""
    return f"""{src}_c AS (SELECT g, i, s, sum(length(s) + {width}) OVER (PARTITION BY g ORDER BY i) AS e FROM {src}),
{src}_n AS MATERIALIZED (SELECT a.g, a.i, greatest(a.i, coalesce(b.i, 0)) + 1 AS onward FROM {src}_c a ASOF LEFT JOIN {src}_c b ON a.g = b.g AND a.e - length(a.s) + {size} >= b.e),
{src}_w AS (SELECT DISTINCT g, CAST(1 AS BIGINT) AS i FROM {src} UNION ALL SELECT n.g, n.onward FROM {src}_w w JOIN {src}_n n ON w.g = n.g AND w.i = n.i),
{src}_p AS (SELECT g, n, string_agg(s, {joiner} ORDER BY i) AS s FROM (SELECT c.g, c.i, c.s, count(w.i) OVER (PARTITION BY c.g ORDER BY c.i) AS n FROM {src}_c c LEFT JOIN {src}_w w ON c.g = w.g AND c.i = w.i) GROUP BY g, n)"""


def _packing_sql(size: int) -> str:
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return rf"""
WITH RECURSIVE para AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS j FROM
  (SELECT doc_id, list_filter(list_transform(string_split_regex({strip('text')}, '\n\s*\n'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM documents)),
su AS (SELECT {{'d': doc_id, 'j': j}} AS g, unnest(l) AS s, CAST(generate_subscripts(l, 1) AS BIGINT) AS i FROM
  (SELECT doc_id, j, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM para WHERE length(p) > {size})),
{_walk("su", "' '", 1, size)},
pu AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY j, n) AS i FROM
  (SELECT doc_id AS g, j, 0 AS n, p AS s FROM para WHERE length(p) <= {size} UNION ALL SELECT g.d, g.j, n, s FROM su_p)),
{_walk("pu", "chr(10) || chr(10)", 2, size)}
SELECT g AS doc_id, n - 1 AS pos, length(s) AS n_chars, substring(sha256(s), 1, 32) AS content_hash FROM pu_p"""


def _chunk_rows(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("chunk").cast("long").alias("n_chars"), keys.content_hash(F.col("chunk")).alias("content_hash"))


@query(_packing_sql(400))
def chunk_packing(spark, d):
    """Greedy packing to 400 characters."""
    return _chunk_rows(table(spark, d, "documents").select("doc_id", F.posexplode(packing.pack(F.col("text"), 400)).alias("pos", "chunk")))


@query(_packing_sql(120))
def chunk_table_function(spark, d):
    """Packing to 120 characters as a table function of SQL."""
    packing.register(spark)
    return _chunk_rows(spark.sql("SELECT doc_id, pos, chunk FROM {docs}, LATERAL split_chunks(text, 120, 0)", docs=table(spark, d, "documents").select("doc_id", "text")))


@query(
    f"WITH {CH}, sent2 AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM "
    f"(SELECT doc_id, {CUT} AS l FROM (SELECT doc_id, 'New lead. ' || replace(text, ' the ', ' this ') AS text FROM documents))) WHERE s <> ''), "
    "ch2 AS (SELECT *, concat(doc_id, '::', substring(sha256(sentence), 1, 16), CASE WHEN occ > 0 THEN '::' || occ ELSE '' END) AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY pos) - 1 AS occ FROM sent2)) "
    "SELECT chunk_id, CASE WHEN ch.pos IS NULL THEN 'added' WHEN ch2.pos IS NULL THEN 'removed' WHEN ch.pos <> ch2.pos THEN 'moved' ELSE 'kept' END AS change FROM ch FULL JOIN ch2 USING (chunk_id)"
)
def chunk_diff_versions(spark, d):
    docs = table(spark, d, "documents")
    edited = docs.withColumn("text", F.concat(F.lit("New lead. "), F.replace("text", F.lit(" the "), F.lit(" this "))))
    return facts.diff_chunks(facts.sentence_chunks(docs), facts.sentence_chunks(edited))


CHANGES = """chg AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'add' END AS op,
  CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' Edited.' END AS content FROM documents UNION ALL SELECT doc_id + 1000000000, 'delete', NULL FROM documents WHERE doc_id % 5 = 0)"""


def _changes(spark, d):
    docs = table(spark, d, "documents")
    op = F.when(F.col("doc_id") % 3 == 0, "delete").when(F.col("doc_id") % 3 == 1, "update").otherwise("add")
    content = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" Edited.")))
    unknown = docs.filter("doc_id % 5 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("content"))
    return docs.select("doc_id", op.alias("op"), content.alias("content")).unionByName(unknown)


def _stored(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", keys.content_hash(F.col("text")).alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("active").alias("status"), F.lit(1).cast("long").alias("version"))


STORED = "st AS (SELECT doc_id, substring(sha256(text), 1, 32) AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'active' END AS status, CAST(1 AS BIGINT) AS version FROM documents)"


@query(
    f"WITH {CHANGES}, {STORED} SELECT chg.doc_id, op, CASE WHEN op = 'delete' THEN st.doc_id IS NULL OR status = 'deleted' ELSE coalesce(status = 'active' AND content_hash = substring(sha256(content), 1, 32), false) END AS noop FROM chg LEFT JOIN st USING (doc_id)"
)
def noop_filter(spark, d):
    return versions.mark_noops(_changes(spark, d), _stored(spark, d)).select("doc_id", "op", "noop")


@query(
    f"WITH {CHANGES}, {STORED} SELECT coalesce(st.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN version WHEN st.doc_id IS NULL THEN 1 ELSE version + 1 END AS version, CASE WHEN c.doc_id IS NULL THEN status ELSE 'active' END AS status, coalesce(c.h, content_hash) AS content_hash "
    "FROM st FULL JOIN (SELECT doc_id, substring(sha256(content), 1, 32) AS h FROM chg WHERE op <> 'delete') c USING (doc_id)"
)
def doc_upsert_versioning(spark, d):
    return versions.upsert(_stored(spark, d), _changes(spark, d).filter("op <> 'delete'"))


@query(f"WITH {CH} SELECT status, d.doc_id, count(chunk_id) AS n_chunks FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'active' END AS status FROM documents) d LEFT JOIN ch USING (doc_id) GROUP BY ALL")
def documents_listing(spark, d):
    counts = chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return _stored(spark, d).select("status", "doc_id").join(counts, "doc_id", "left").fillna(0, ["n_chunks"])


@query("SELECT substring(sha256(b.text), 1, 32) AS content_hash, b.item_id, coalesce(min(d.doc_id), -1) AS doc_id FROM benchmark b LEFT JOIN documents d ON sha256(d.text) = sha256(b.text) GROUP BY ALL")
def find_document_by_hash(spark, d):
    hashed = table(spark, d, "documents").select(keys.content_hash(F.col("text")).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return table(spark, d, "benchmark").select("item_id", keys.content_hash(F.col("text")).alias("content_hash")).join(hashed, "content_hash", "left").fillna(-1, ["doc_id"])


@query("SELECT page_id, CASE WHEN regexp_extract(lower(url), '\\.([a-z]+)$', 1) NOT IN ('md', 'markdown', 'txt', 'text', 'rst', 'html') AND url LIKE '%.%' AND regexp_extract(lower(url), '\\.([a-z]+)$', 1) NOT IN ('') THEN 'suffix' WHEN strlen(html) > 2000000 THEN 'size' WHEN trim(html) = '' THEN 'empty' ELSE 'accepted' END AS verdict FROM pages")
def upload_intake(spark, d):
    kind = F.regexp_extract(F.lower("url"), r"\.([a-z]+)$", 1)
    allowed = kind.isin("", "md", "markdown", "txt", "text", "rst", "html")
    verdict = F.when(~allowed, "suffix").when(F.octet_length("html") > 2000000, "size").when(F.trim("html") == "", "empty").otherwise("accepted")
    return table(spark, d, "pages").select("page_id", verdict.alias("verdict"))


@query("SELECT doc_id, copy, CASE WHEN copy = 0 THEN text ELSE replace(replace(text, 'The ', 'The' || chr(64 + CAST(copy AS INTEGER)) || ' '), 'Licensed', 'Licensed' || chr(64 + CAST(copy AS INTEGER))) END AS text FROM (SELECT doc_id, text, unnest(range(3)) AS copy FROM documents)")
def scaled_corpus(spark, d):
    return versions.scale(table(spark, d, "documents").select("doc_id", "text"), 3, [("The ", "The{} "), ("Licensed", "Licensed{}")])


_SPLIT = r"string_split(regexp_replace({}, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1))"
_TOKENS = "greatest(1, length(s) // 4)"


@query(f"""
WITH c AS (SELECT copy, doc_id, CASE WHEN copy = 0 THEN text ELSE replace(text, '. ', chr(64 + CAST(copy AS INTEGER)) || '. ') END AS text FROM (SELECT doc_id, text, unnest(range(8)) AS copy FROM documents)),
f AS (SELECT s, min(copy) AS c0 FROM (SELECT copy, unnest({_SPLIT.format("text")}) AS s FROM c) WHERE s <> '' GROUP BY s),
e AS (SELECT DISTINCT s FROM (SELECT unnest({_SPLIT.format("'New lead. ' || replace(text, ' the ', ' this ')")}) AS s FROM documents WHERE doc_id = (SELECT doc_id FROM documents ORDER BY coalesce(length(text), 0) DESC, doc_id LIMIT 1)) WHERE s <> ''),
k AS (SELECT unnest([1, 2, 4, 8]) AS copies),
b AS (SELECT copies, count(*) AS chunks, sum({_TOKENS}) AS build_tokens FROM k JOIN f ON c0 < copies GROUP BY copies),
u AS (SELECT copies, sum(CASE WHEN c0 IS NULL OR c0 >= copies THEN {_TOKENS} ELSE 0 END) AS update_tokens FROM k, e LEFT JOIN f USING (s) GROUP BY copies)
SELECT CAST(copies AS BIGINT) AS copies, chunks, CAST(build_tokens AS BIGINT) AS build_tokens, CAST(update_tokens AS BIGINT) AS update_tokens, CASE WHEN update_tokens > 0 THEN round(build_tokens / update_tokens, 2) END AS ratio FROM b JOIN u USING (copies)
""")
def scaling_ratio(spark, d):
    """Extraction tokens of building 1, 2, 4 and 8 relabelled copies of the corpus against those of one edited document.

    A text is paid for once, in all corpora that hold the copy where it comes first:
    the sizes are a column, so one plan has them all.
    """
    return measures.scaling_ratio(table(spark, d, "documents").select("doc_id", "text"), [(". ", "{}. ")], [1, 2, 4, 8], _edited)


def _edited(content):
    return F.concat(F.lit("New lead. "), F.replace(content, F.lit(" the "), F.lit(" this ")))


# ---------------------------------------------------------------- graph facts


@query(f"WITH {MEN} SELECT name, chunk_id FROM men")
def entity_mentions(spark, d):
    return facts.mentions(chunks(spark, d)).select("name", "chunk_id")


@query(f"WITH {SUP} SELECT src, dst, count(DISTINCT chunk_id) AS support, count(DISTINCT doc_id) AS docs FROM sup GROUP BY ALL")
def relation_support(spark, d):
    return facts.support(chunks(spark, d)).groupBy("src", "dst").agg(F.countDistinct("chunk_id").alias("support"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH {REL} SELECT name, degree FROM deg")
def entity_degree(spark, d):
    return facts.degrees(facts.relations(facts.support(chunks(spark, d))))


@query(f"WITH {MEN} SELECT name, description FROM (SELECT name, description, row_number() OVER (PARTITION BY name ORDER BY length(description) DESC, description) AS rn FROM men) WHERE rn = 1")
def longest_description(spark, d):
    return facts.descriptions(facts.mentions(chunks(spark, d)))


@query("SELECT name, substring(sha256(trim(regexp_replace(lower(name), '[ ]+', ' ', 'g')) || '|' || 'concept'), 1, 24) AS entity_id FROM (SELECT DISTINCT name FROM (WITH " + MEN + " SELECT name FROM men))")
def entity_keys(spark, d):
    names = facts.mentions(chunks(spark, d)).select("name").distinct()
    return names.select("name", keys.entity_key(F.col("name"), F.lit("concept")).alias("entity_id"))


@query(
    f"WITH {SUP} SELECT src, dst, n AS before, n - g AS after, CASE WHEN n = g THEN 'expired' ELSE 'weakened' END AS outcome FROM (SELECT src, dst, count(DISTINCT chunk_id) AS n, count(DISTINCT chunk_id) FILTER (source = 'src0') AS g FROM sup GROUP BY ALL) WHERE g > 0"
)
def retract_source_receipt(spark, d):
    ch = chunks(spark, d)
    _, receipt = facts.retract(facts.support(ch), ch.filter("source = 'src0'"))
    touched = receipt.filter("after < before")
    return touched.withColumn("outcome", F.when(F.col("after") == 0, "expired").otherwise("weakened"))


@query(f"WITH {SUP} SELECT src, dst, count(DISTINCT chunk_id) AS support FROM sup WHERE chunk_id NOT IN (SELECT chunk_id FROM ch WHERE source = 'src0') GROUP BY ALL")
def surviving_relations(spark, d):
    ch = chunks(spark, d)
    left, _ = facts.retract(facts.support(ch), ch.filter("source = 'src0'"))
    return facts.relations(left)


@query(f"WITH {MEN} SELECT name FROM men GROUP BY name HAVING count(*) FILTER (source <> 'src0') = 0")
def orphan_entities(spark, d):
    men = facts.mentions(chunks(spark, d))
    return men.select("name").distinct().join(men.filter("source <> 'src0'").select("name"), "name", "left_anti")


@query(
    f"WITH {SUP}, m AS (SELECT DISTINCT unnest(regexp_extract_all(sentence, {P})) AS name FROM ch WHERE source <> 'src0'), r AS (SELECT DISTINCT src, dst FROM sup) SELECT src, dst FROM r WHERE src NOT IN (SELECT name FROM m) OR dst NOT IN (SELECT name FROM m)"
)
def dangling_relations(spark, d):
    ch = chunks(spark, d)
    return facts.dangling(facts.relations(facts.support(ch)), facts.mentions(ch.filter("source <> 'src0'")))


@query(
    f"WITH {SUP}, m AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(sentence, {P})) AS name FROM ch), live AS (SELECT DISTINCT chunk_id FROM ch WHERE source <> 'src0'), "
    "alive AS (SELECT DISTINCT name FROM m SEMI JOIN live USING (chunk_id)) "
    "SELECT (SELECT count(DISTINCT name) FROM m) - (SELECT count(*) FROM alive) AS orphans, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM sup)) - (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM sup SEMI JOIN live USING (chunk_id))) AS unsupported, "
    "(SELECT count(*) FROM sup WHERE chunk_id NOT IN (SELECT chunk_id FROM live)) AS ghosts, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM sup) WHERE src NOT IN (SELECT name FROM alive) OR dst NOT IN (SELECT name FROM alive)) AS dangling, false AS ok"
)
def integrity_report(spark, d):
    ch = chunks(spark, d)
    return measures.integrity(facts.mentions(ch), facts.support(ch), ch.filter("source <> 'src0'"))


@query(f"WITH {REL}, top AS (SELECT name FROM deg ORDER BY degree DESC, name LIMIT 200) SELECT src, dst, support FROM rel SEMI JOIN top a ON rel.src = a.name SEMI JOIN top b ON rel.dst = b.name")
def graph_projection(spark, d):
    rel = facts.relations(facts.support(chunks(spark, d)))
    return graph.projection(rel, facts.degrees(rel), 200)


@query(
    f"WITH {REL}, seed AS (SELECT name, 1.0 / degree AS score FROM deg WHERE degree >= 3), one AS (SELECT other AS name, max(score * 0.5 * least(1.0, support / 2.0)) AS score FROM nbr JOIN seed USING (name) GROUP BY other), "
    "s1 AS (SELECT name, max(score) AS score, min(hop) AS hop FROM (SELECT name, score, 0 AS hop FROM seed UNION ALL SELECT name, score, 1 FROM one) GROUP BY name), "
    "two AS (SELECT other AS name, max(score * 0.25 * least(1.0, support / 2.0)) AS score FROM nbr JOIN (SELECT name, score FROM s1 WHERE hop = 1) USING (name) GROUP BY other) "
    "SELECT name, round(max(score), 5) AS score, CAST(min(hop) AS BIGINT) AS hop FROM (SELECT * FROM s1 UNION ALL SELECT name, score, 2 FROM two) GROUP BY name"
)
def two_hop_scores(spark, d):
    rel = facts.relations(facts.support(chunks(spark, d)))
    seeds = facts.degrees(rel).filter("degree >= 3").select("name", (1.0 / F.col("degree")).alias("score"))
    return ranking.expand(seeds, facts.both_ways(rel), 2).select("name", F.round("score", 5).alias("score"), F.col("hop").cast("long").alias("hop"))


@query(
    f"WITH {MEN}, deg AS (SELECT name, count(DISTINCT chunk_id) AS n FROM men GROUP BY name) SELECT chunk_id, count(*) AS hits, CAST(sum(greatest(n - 3, 0)) AS BIGINT) AS weight FROM men JOIN deg USING (name) GROUP BY chunk_id"
)
def rank_chunks(spark, d):
    men = facts.mentions(chunks(spark, d))
    score = men.groupBy("name").agg((F.countDistinct("chunk_id") - 3).alias("score"))
    return ranking.rank_chunks(men.join(score, "name")).withColumn("weight", F.col("weight").cast("long")).select("chunk_id", "hits", "weight")


COMM = MEN + ", home AS (SELECT name, min(source) AS comm FROM men GROUP BY name)"


@query(
    f"WITH {REL}, home AS (SELECT name, min(source) AS comm FROM (SELECT source, unnest(regexp_extract_all(sentence, {P})) AS name FROM ch) GROUP BY name) SELECT n.name, comm, CAST(sum(1 + support) AS BIGINT) AS vote FROM nbr n JOIN home h ON n.other = h.name GROUP BY n.name, comm"
)
def community_votes(spark, d):
    ch = chunks(spark, d)
    home = facts.mentions(ch).groupBy("name").agg(F.min("source").alias("comm"))
    rel = facts.relations(facts.support(ch)).withColumn("weight", F.lit(1).cast("long"))
    return graph.votes(facts.both_ways(rel), home).withColumn("vote", F.col("vote").cast("long"))


@query(f"WITH {MEN}, a AS (SELECT name, min(source) AS old FROM men GROUP BY name), b AS (SELECT name, max(source) AS new FROM men GROUP BY name) SELECT old, new, count(*) AS overlap FROM a JOIN b USING (name) GROUP BY ALL")
def overlap_matrix(spark, d):
    men = facts.mentions(chunks(spark, d))
    return graph.overlap(men.groupBy("name").agg(F.min("source").alias("old")), men.groupBy("name").agg(F.max("source").alias("new")))


@query(f"WITH {MEN}, a AS (SELECT DISTINCT name, source FROM men), b AS (SELECT DISTINCT name, source FROM men WHERE doc_id % 4 <> 0) SELECT source AS comm, count(*) AS drifted FROM a ANTI JOIN b USING (name, source) GROUP BY source")
def drifted_members(spark, d):
    men = facts.mentions(chunks(spark, d))
    now = men.select(F.col("source").alias("comm"), "name").distinct()
    covered = men.filter("doc_id % 4 <> 0").select(F.col("source").alias("comm"), "name").distinct()
    return graph.drift(now, covered)


DIRTY = "c AS (SELECT source AS comm, min(doc_id) AS seen, max(doc_id) % 3 = 0 AS dirty FROM documents GROUP BY source)"


def _communities(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("comm")).agg(F.min("doc_id").alias("seen"), (F.max("doc_id") % 3 == 0).alias("dirty"))


@query(f"WITH {DIRTY} SELECT comm, CAST(row_number() OVER (ORDER BY seen, comm) AS BIGINT) AS dirty_seq FROM c WHERE dirty ORDER BY seen, comm LIMIT 8")
def dirty_queue_batch(spark, d):
    return graph.dirty_batch(graph.mark_dirty(_communities(spark, d).withColumn("dirty_seq", F.lit(0).cast("long")), F.col("dirty"), "seen"), 8)


@query(f"WITH {DIRTY} SELECT count(*) FILTER (dirty) AS dirty, count(*) AS total, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (dirty) / count(*), 4) END AS fraction, CAST(max(CASE WHEN dirty THEN 100000 - seen END) AS BIGINT) AS max_age FROM c")
def staleness(spark, d):
    return measures.staleness(_communities(spark, d).withColumn("age", 100000 - F.col("seen")))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, l_suppkey + 1000000000 AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity = 50 AND l_discount = 0.1), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(u, v) AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u) SELECT u AS node, least(u, min(v)) AS component FROM r GROUP BY u"
)
def connected_components(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity = 50 and l_discount = 0.1")
    edges = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1000000000).alias("v")).distinct()
    return graph.components(edges)


@query()
def louvain_communities(spark, d):
    rel = facts.relations(facts.support(chunks(spark, d))).filter("support > 1")
    return graph.louvain(rel.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("support").cast("double").alias("w")))


@query()
def label_propagation(spark, d):
    rel = facts.relations(facts.support(chunks(spark, d))).filter("support > 1")
    return graph.label_propagation(rel.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("support").cast("double").alias("w")))


@query()
def name_similarity(spark, d):
    """Scores of names that share a first word, in pairs."""
    names = facts.mentions(chunks(spark, d)).groupBy("name").count().filter("count > 1 and name like '% %'").select("name", F.substring_index("name", " ", 1).alias("k"))
    pairs = names.join(names.withColumnRenamed("name", "other"), "k").filter("name < other")
    return pairs.select("name", "other", F.round(vectors.name_similarity()("name", "other"), 4).alias("score")).filter("score >= 0.9")


@query(f"WITH {SUP}, a AS (SELECT DISTINCT src, dst FROM sup WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT src, dst FROM sup WHERE doc_id % 3 = 0) SELECT src, dst, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def extraction_diff(spark, d):
    sup = facts.support(chunks(spark, d))
    return facts.diff_extractions(sup.filter("doc_id % 2 = 0"), sup.filter("doc_id % 3 = 0"), ["src", "dst"])


@query(f"WITH {REL} SELECT DISTINCT name, other FROM nbr")
def neighbour_lookup(spark, d):
    rel = facts.relations(facts.support(chunks(spark, d)))
    return facts.neighbours(rel, facts.degrees(rel))


@query(f"WITH {MEN} SELECT DISTINCT name FROM men WHERE name NOT IN (SELECT name FROM men WHERE doc_id % 2 = 0)")
def sweep_orphans(spark, d):
    men = facts.mentions(chunks(spark, d))
    return facts.sweep_orphans(men.select("name").distinct(), men.filter("doc_id % 2 = 0"))


# ---------------------------------------------------------------- vectors


@query(
    "WITH q AS (SELECT vec_id AS q, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS score FROM q, embeddings WHERE q <> vec_id) SELECT q, vec_id, score, CAST(rn AS BIGINT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 8"
)
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    return ranking.top_k(asked, e.select("vec_id", "embedding"), 8)


@query(
    "WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS ce FROM x GROUP BY label), s AS (SELECT c.label, vec_id, round(list_cosine_similarity(ce, CAST(embedding AS DOUBLE[])), 5) AS score FROM c, embeddings) SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 5"
)
def label_centroid_topk(spark, d):
    e = table(spark, d, "embeddings")
    centre = ranking.centroids(e)
    return ranking.top_k(centre.select(F.col("label").alias("q"), F.col("centre").alias("qe")), e.select("vec_id", "embedding"), 5, others_only=False).select(F.col("q").alias("label"), "vec_id", "score")


SAME = "p AS (SELECT a.vec_id AS u, b.vec_id AS v, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"


def _label_sides(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select("label", F.col("vec_id").alias("u"), F.col("embedding").alias("ue"))
    return asked, e.select("label", F.col("vec_id").alias("v"), F.col("embedding").alias("ve"))


@query(f"WITH {SAME} SELECT u, v, round(sim, 5) AS sim FROM p WHERE round(sim, 5) >= 0.3")
def pairs_over_tau(spark, d):
    return ranking.label_pairs(*_label_sides(spark, d), 0.3)


EACH = "p AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"


@query(f"WITH {EACH} SELECT CAST(least(4, greatest(0, floor(round(sim, 5) * 5))) AS BIGINT) AS bucket, count(*) AS n FROM p GROUP BY 1")
def similarity_histogram(spark, d):
    """Similarities of each row with every other row of its label."""
    _, rows = _label_sides(spark, d)
    return ranking.label_histogram(rows.select("label", F.col("v").alias("u"), F.col("ve").alias("ue")), rows, 5)


@query()
def hash_embed_topk(spark, d):
    """Documents nearest to each benchmark text by hashed embeddings."""
    embed = vectors.hash_embedding(64)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), embed("text").alias("embedding"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), embed("text").alias("qe"))
    return ranking.top_k(asked, docs, 3, others_only=False)


# ---------------------------------------------------------------- cost, metrics and streams


@query("SELECT event_type AS operation, count(*) AS calls, round(sum(value), 2) AS tokens, round(sum(value) * 5 / 1e6, 6) AS usd, count(*) FILTER (event_id % 4 = 0) AS cache_hits FROM events GROUP BY 1")
def cost_by_operation(spark, d):
    return measures.cost_by_operation(_costs(spark, d))


def _costs(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("tokens"), (F.col("event_id") % 4 == 0).alias("cache_hit"), "user_id", "event_id", "ts")


@query("SELECT coalesce(event_type, 'all') AS operation, coalesce(m, 'all') AS model, count(*) AS calls, round(sum(value), 2) AS tokens FROM (SELECT *, CAST(user_id % 3 AS VARCHAR) AS m FROM events) GROUP BY ROLLUP (event_type, m)")
def cost_rollup(spark, d):
    rows = _costs(spark, d).withColumn("model", (F.col("user_id") % 3).cast("string"))
    return rows.rollup("operation", "model").agg(F.count("*").alias("calls"), F.round(F.sum("tokens"), 2).alias("tokens")).fillna("all", ["operation", "model"])


@query("SELECT le, count(*) FILTER (value <= le) AS n FROM events, (SELECT CAST(unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]) AS DOUBLE) AS le) GROUP BY le")
def latency_histogram(spark, d):
    return measures.cumulative_histogram(table(spark, d, "events").select(F.col("value").alias("x")), [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0])


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type AS operation, count(*) AS n, round(count(*) / 300.0, 6) AS rate FROM events GROUP BY ALL")
def rate_5m(spark, d):
    return measures.rate(table(spark, d, "events").withColumnRenamed("event_type", "operation"), "5 minutes", 300.0)


@query("SELECT date_trunc('minute', ts) AS start, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.5), 4) AS p50 FROM events GROUP BY 1")
def p95_by_minute(spark, d):
    grouped = table(spark, d, "events").groupBy(F.window("ts", "1 minute").start.alias("start"))
    return grouped.agg(F.round(F.percentile("value", 0.95), 4).alias("p95"), F.round(F.percentile("value", 0.5), 4).alias("p50"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """The same counts from a stream with a watermark, run to its end."""
    rows = feed.collected(feed.tumbling(feed.read_events(spark, f"{d}/events*.parquet")))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start FROM events, (SELECT unnest(range(4)) AS k)) GROUP BY ALL")
def sliding_counts(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").start.alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, count(*) AS n FROM (SELECT *, sum(CASE WHEN g IS NULL OR g > INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)) GROUP BY user_id, s")
def session_windows(spark, d):
    grouped = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_stream(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_id, ts < coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY event_id + (event_id * 37) % 101, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) - INTERVAL '10 minutes' AS late FROM events")
def late_events(spark, d):
    return measures.late(table(spark, d, "events").withColumn("arrival", F.col("event_id") + (F.col("event_id") * 37) % 101), "user_id", "10 minutes").select("event_id", "late")


@query(f"WITH {REL} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM deg) AS entities, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM rel WHERE support = 1) AS single, (SELECT round(sum(value), 2) FROM events) AS tokens")
def index_stats(spark, d):
    ch = chunks(spark, d)
    rel = facts.relations(facts.support(ch))
    return measures.stats(table(spark, d, "documents"), ch, rel, _costs(spark, d))


@query("SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS merge_rate, count(*) AS decisions FROM labels")
def merge_rate(spark, d):
    return measures.share(table(spark, d, "labels"), F.col("quality") == 1, "merge_rate", "decisions")


@query("SELECT count(*) AS communities, round(avg(n), 2) AS mean_size, max(n) AS max_size FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def compaction_stats(spark, d):
    return measures.size_stats(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def last_n_costs(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "ts", "event_type")


@query("SELECT user_id, event_id, CAST(rn AS BIGINT) AS change FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn % 4 = 0")
def every_n_changes(spark, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").withColumn("change", rank.cast("long")).filter("change % 4 = 0").select("user_id", "event_id", "change")


# ---------------------------------------------------------------- retrieval and evaluation

NORM = r"list_filter(string_split(regexp_replace(translate(lower({}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '[ \t\n\f\r]+', ' ', 'g'), ' '), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
TURNS = "t AS (SELECT a.conv_id, a.turn, a.text AS pred, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("pred")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref")), ["conv_id", "turn"])


@query(
    f"WITH {TURNS}, n AS (SELECT row_number() OVER (ORDER BY conv_id, turn, pred, ref) AS k, conv_id, turn, {NORM.format('pred')} AS p, {NORM.format('ref')} AS r FROM t), "
    "pc AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(p) AS w FROM n) GROUP BY ALL), rc AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(r) AS w FROM n) GROUP BY ALL), o AS (SELECT k, sum(least(pc.c, rc.c)) AS ov FROM pc JOIN rc USING (k, w) GROUP BY k) "
    "SELECT conv_id, turn, round(CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN coalesce(ov, 0) = 0 THEN 0.0 ELSE 2.0 * ov / (len(p) + len(r)) END, 5) AS f1 FROM n LEFT JOIN o USING (k)"
)
def token_f1(spark, d):
    return ranking.f1_rows(_turns(spark, d)).select("conv_id", "turn", F.round("f1", 5).alias("f1"))


@query(f"WITH {TURNS} SELECT conv_id, turn, {NORM.format('pred')} = {NORM.format('ref')} AS em FROM t")
def exact_match(spark, d):
    return _turns(spark, d).select("conv_id", "turn", (text.normal_answer(F.col("pred")) == text.normal_answer(F.col("ref"))).alias("em"))


FACTS = "f AS (SELECT conv_id, turn, text, list_slice(string_split(text, ' '), 1, 3) AS want, ['zzz', 'the'] AS ban FROM conversations)"


@query(
    f"WITH {FACTS} SELECT conv_id, turn, round(len(list_filter(want, lambda x: contains(lower(text), lower(x)))) / greatest(len(want), 1), 4) AS recall, len(list_filter(ban, lambda x: contains(lower(text), lower(x)))) > 0 AS stale FROM f"
)
def fact_recall(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.slice(F.split("text", " "), 1, 3).alias("want"), F.array(F.lit("zzz"), F.lit("the")).alias("ban"))
    return rows.select("conv_id", "turn", F.round(ranking.fact_recall(F.col("text"), F.col("want")), 4).alias("recall"), ranking.mentions_any(F.col("text"), F.col("ban")).alias("stale"))


@query("SELECT role, count(*) AS n, round(avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END), 4) AS stale_rate, round(avg(CASE WHEN contains(lower(text), 'do not contain') OR contains(lower(text), 'does not contain') OR contains(lower(text), 'no information') OR contains(lower(text), 'cannot answer') THEN 1.0 ELSE 0.0 END), 4) AS abstention_rate FROM conversations GROUP BY role")
def stale_rate(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.lower("text").contains("the").cast("int")), 4).alias("stale_rate"), F.round(F.avg(text.abstains(F.col("text")).cast("int")), 4).alias("abstention_rate"))


@query("SELECT conv_id, turn, line FROM (SELECT conv_id, turn, text AS line, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600")
def context_budget(spark, d):
    return ranking.within_budget(table(spark, d, "conversations").withColumnRenamed("text", "line"), "conv_id", ["turn", "line"], 600).select("conv_id", "turn", "line")


@query(
    f"WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS qw FROM benchmark), {CH}, l AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9_]+')) AS lw FROM ch WHERE length(sentence) >= 8), qx AS (SELECT item_id, len(qw) AS nq, unnest(qw) AS w FROM q), lx AS (SELECT chunk_id, len(lw) AS nl, unnest(lw) AS w FROM l), "
    "s AS (SELECT item_id, chunk_id, round(count(*) / sqrt(nq * nl), 5) AS score FROM qx JOIN lx USING (w) GROUP BY item_id, chunk_id, nq, nl) SELECT item_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rn FROM s WHERE score >= 0.25) WHERE rn <= 2"
)
def answer_overlap(spark, d):
    lines = chunks(spark, d).filter("length(sentence) >= 8").select("chunk_id", text.word_set(F.col("sentence")).alias("lw"))
    asked = table(spark, d, "benchmark").select("item_id", text.word_set(F.col("text")).alias("qw"))
    return ranking.best_lines(asked, lines, 0.25, 2)


@query("SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size))")
def pareto_frontier(spark, d):
    return ranking.frontier(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")


@query("SELECT conv_id, turn, role, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'end') AS next_role FROM conversations")
def conversation_chain(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(F.lead("role").over(order), F.lit("end")).alias("next_role"))


@query("SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_revenue(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-07-01') ON c_custkey = o_custkey")
def star_idle_customers(spark, d):
    """Customers without an order since the middle of 2000."""
    late = table(spark, d, "orders").filter("o_orderdate >= '2000-07-01'")
    return table(spark, d, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


from . import engine_queries, model_queries, report_queries  # noqa: E402, F401  register their queries here
