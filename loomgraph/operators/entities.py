"""Descriptions by chunk, and entities folded into others, on fact rows.

An entity's descriptions are rows (entity, chunk_id, description, seq), not one map, so
that an entity that a third of all chunks mention is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(descriptions: DataFrame, removed: DataFrame) -> DataFrame:
    """Descriptions whose chunk is still there."""
    return descriptions.join(removed.select("chunk_id").distinct(), "chunk_id", "left_anti")


def visible(descriptions: DataFrame, size: Column | None = None, *also: Column) -> DataFrame:
    """(entity, description, also…): the longest of each entity, of equal ones the first inserted, and other aggregates.

    ``size`` is the length of a description that is not a text, such as a key that stands for one.
    """
    longest = F.struct(F.length("description") if size is None else size, -F.col("seq"))
    return descriptions.groupBy("entity").agg(F.max_by("description", longest).alias("description"), *also)


def merged(descriptions: DataFrame, into: DataFrame) -> DataFrame:
    """Descriptions with the entities of ``into`` (entity, target, at) folded into their targets in the order of ``at``.

    A chunk that several of them have keeps the place of the first and the text of
    the last; what a source adds stands after what the target has.
    """
    joined = descriptions.join(into, "entity", "left")
    moved = joined.select(F.coalesce("target", "entity").alias("entity"), "chunk_id", "description", F.struct(F.coalesce("at", F.lit(0)).alias("at"), "seq").alias("place"))
    each = moved.groupBy("entity", "chunk_id").agg(F.min("place").alias("first"), F.max_by("description", "place").alias("description"))
    seq = F.row_number().over(Window.partitionBy("entity").orderBy("first", "chunk_id"))
    return each.select("entity", "chunk_id", "description", seq.cast("long").alias("seq"))


def aliases(names: DataFrame, into: DataFrame) -> DataFrame:
    """(entity, alias) of the targets of ``into``: the names and aliases of what was folded, but for the target's own name in any case."""
    known = names.select("entity", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), "name")
    folded = known.join(into.select("entity", "target"), "entity").select(F.col("target").alias("entity"), "alias")
    own = names.select("entity", F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("alias"))
    title = names.select("entity", F.lower("name").alias("_own"))
    kept = folded.join(title, "entity", "left").filter(F.coalesce(F.lower("alias") != F.col("_own"), F.lit(True))).select("entity", "alias")
    return kept.union(own.join(into.select("entity"), "entity", "left_anti")).distinct()
