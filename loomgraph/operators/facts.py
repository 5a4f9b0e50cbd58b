"""Fact tables: sentences, mentions and relation support, and the views over them.

A relation exists while a support row does and an entity while a mention does,
so deletion is an anti-join on chunk ids and everything else an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, text


def sentence_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, source, pos, sentence, occ, chunk_id): content-addressed chunks of one sentence."""
    cut = docs.select("doc_id", "source", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")).filter("sentence <> ''")
    order = Window.partitionBy("doc_id", "sentence").orderBy("pos")
    numbered = cut.withColumn("occ", (F.row_number().over(order) - 1).cast("long"))
    return numbered.withColumn("pos", F.col("pos").cast("long")).withColumn("chunk_id", keys.chunk_id(F.col("doc_id").cast("string"), F.col("sentence"), F.col("occ")))


def phrase_rows(chunks: DataFrame) -> DataFrame:
    """(doc_id, source, chunk_id, sentence, at, name): capitalised phrases in order."""
    return chunks.select("doc_id", "source", "chunk_id", "sentence", F.posexplode(text.phrases(F.col("sentence"))).alias("at", "name"))


def mentions(chunks: DataFrame, *also: str) -> DataFrame:
    """(name, chunk_id, doc_id, source, description, also…): one row for each entity and chunk."""
    rows = chunks.select("doc_id", "source", "chunk_id", *also, F.col("sentence").alias("description"), F.explode(F.array_distinct(text.phrases(F.col("sentence")))).alias("name"))
    return rows.select("name", "chunk_id", "doc_id", "source", "description", *also)


def support(chunks: DataFrame) -> DataFrame:
    """(src, dst, chunk_id, doc_id, source): neighbouring phrases of a sentence, without self loops."""
    names = text.phrases(F.col("sentence"))
    rows = chunks.select("doc_id", "source", "chunk_id", names.alias("names")).filter(F.size("names") > 1)
    pairs = F.arrays_zip(F.slice("names", F.lit(1), F.size("names") - 1).alias("src"), F.slice("names", F.lit(2), F.size("names") - 1).alias("dst"))
    return rows.select("doc_id", "source", "chunk_id", F.explode(F.array_distinct(pairs)).alias("p")).filter("p.src <> p.dst").select("p.src", "p.dst", "chunk_id", "doc_id", "source")


def relations(sup: DataFrame) -> DataFrame:
    return sup.groupBy("src", "dst").agg(F.countDistinct("chunk_id").alias("support"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(name, other, …) of both directions of (src, dst, …)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("name"), F.col("dst").alias("other"), *rest).unionByName(edges.select(F.col("dst").alias("name"), F.col("src").alias("other"), *rest))


def degrees(rel: DataFrame) -> DataFrame:
    return both_ways(rel.select("src", "dst")).groupBy("name").agg(F.count("*").alias("degree"))


def descriptions(ment: DataFrame) -> DataFrame:
    """Longest description of each entity; of equal ones the first in order."""
    order = Window.partitionBy("name").orderBy(F.desc(F.length("description")), "description")
    return ment.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("name", "description")


def retract(sup: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving support, receipt by relation: before, after) once the chunks of ``removed`` go."""
    left = sup.join(removed.select("chunk_id").distinct(), "chunk_id", "left_anti")
    before = sup.groupBy("src", "dst").agg(F.countDistinct("chunk_id").alias("before"))
    after = left.groupBy("src", "dst").agg(F.countDistinct("chunk_id").alias("after"))
    return left, before.join(after, ["src", "dst"], "left").fillna(0, ["after"])


def diff_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, change): added, removed, kept or moved, by a full outer join on the content key."""
    both = old.select("chunk_id", F.col("pos").alias("old_pos")).join(new.select("chunk_id", F.col("pos").alias("new_pos")), "chunk_id", "full_outer")
    change = F.when(F.col("old_pos").isNull(), "added").when(F.col("new_pos").isNull(), "removed").when(F.col("old_pos") != F.col("new_pos"), "moved").otherwise("kept")
    return both.select("chunk_id", change.alias("change"))


def dangling(rel: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with an endpoint that is not among ``names``."""
    live = names.select("name").distinct()
    lost = rel.join(live.withColumnRenamed("name", "src"), "src", "left_anti").select("src", "dst").union(rel.join(live.withColumnRenamed("name", "dst"), "dst", "left_anti").select("src", "dst"))
    return lost.distinct()


def diff_extractions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key…, change): rows that only the new extraction has are added, those that only the old one has removed."""
    added = new.select(*key).distinct().join(old.select(*key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select(*key).distinct().join(new.select(*key), key, "left_anti").withColumn("change", F.lit("removed")))


def neighbours(rel: DataFrame, names: DataFrame) -> DataFrame:
    """(name, other) of the names asked for, in either direction."""
    return both_ways(rel.select("src", "dst")).join(names.select("name").distinct(), "name", "left_semi").distinct()


def sweep_orphans(identity: DataFrame, mention: DataFrame) -> DataFrame:
    """Identities that no mention supports."""
    return identity.join(mention.select("name").distinct(), "name", "left_anti")


def fold(men: DataFrame, into: DataFrame) -> DataFrame:
    """Mentions (name, chunk_id, …) under the names of ``into`` (name, into); a chunk that has both keeps one row, the first by its old name."""
    moved = men.join(into, "name", "left").withColumn("_to", F.coalesce("into", "name"))
    rank = F.row_number().over(Window.partitionBy("_to", "chunk_id").orderBy("name"))
    return moved.withColumn("_rank", rank).filter("_rank = 1").withColumn("name", F.col("_to")).select(*men.columns)


def merge_into(men: DataFrame, old: str, new: str) -> DataFrame:
    """Mentions with one name folded into another; a chunk that has both keeps one row."""
    return fold(men, men.filter(F.col("name") == old).select("name", F.lit(new).alias("into")).distinct())


def chunks_in_order(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_ids): the chunks of each document in order of place."""
    placed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("c"))
    return placed.select("doc_id", F.col("c.chunk_id").alias("chunk_ids"))
