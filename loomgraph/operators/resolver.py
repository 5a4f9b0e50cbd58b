"""Which new entities are known under another name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.shared import cut
from . import ranking


def candidates(new: DataFrame, known: DataFrame, most: int, tau_sim: float) -> DataFrame:
    """(q, vec_id, score): for each new entity the ``most`` nearest others, known or new, of cosine ``tau_sim`` at least."""
    pool = known.select("entity_id", "embedding").unionByName(new.select("entity_id", "embedding"))
    asked = new.select(F.col("entity_id").alias("q"), F.col("embedding").alias("qe"))
    if tau_sim > 1:  # no cosine is that great, so there is nothing to search
        return asked.limit(0).select("q", F.col("q").alias("vec_id"), F.lit(0.0).alias("score"))
    near = ranking.top_k(asked, pool.select(F.col("entity_id").alias("vec_id"), "embedding"), most, floor=tau_sim - 1e-4)
    return near.filter(F.col("score") >= tau_sim).select("q", "vec_id", "score")


def _pairs(new: DataFrame, known: DataFrame, tau_sim: float, tau_name: float, most: int) -> DataFrame:
    """(q, vec_id, score, name_score): the candidates that meet both thresholds, by the best name or alias."""
    near = candidates(new, known, most, tau_sim)
    none = F.array().cast("array<string>")
    titles = known.select("entity_id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", none)))).alias("b"), F.lit(True).alias("old"))
    titles = titles.unionByName(new.select("entity_id", F.col("name").alias("b"), F.lit(False).alias("old")))
    both = near.join(new.select(F.col("entity_id").alias("q"), F.col("name").alias("a")), "q").join(titles.withColumnRenamed("entity_id", "vec_id"), "vec_id")
    both = both.filter(F.col("old") | (F.col("vec_id") < F.col("q")))
    scored = both.withColumn("name_score", vectors.name_similarity(tau_name)("a", "b")).filter(F.col("name_score") >= tau_name)
    return scored.groupBy("q", "vec_id", "score").agg(F.max("name_score").alias("name_score"))


def matches(new: DataFrame, known: DataFrame, tau_sim: float, tau_name: float, most: int) -> DataFrame:
    """(entity_id, target, similarity, name_score): the entity that each new one of ``new`` (entity_id, name, embedding) is, if any.

    A candidate of ``known`` (entity_id, name, aliases, embedding) goes by the best score
    of its name and aliases.  Both thresholds must be met; the greatest sum of the
    two scores wins, then the greater cosine, then the smaller id.  New entities match
    known ones and new ones of smaller id; a target that itself has one hands on.
    """
    each = _pairs(new, known, tau_sim, tau_name, most)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.col("score") + F.col("name_score")), F.desc("score"), "vec_id"))
    found = cut(each.withColumn("rn", best).filter("rn = 1").select(F.col("q").alias("entity_id"), F.col("vec_id").alias("target"), F.col("score").alias("similarity"), "name_score"))
    while True:  # targets are smaller or known, so chains end; each round halves them
        onward = found.select(F.col("entity_id").alias("target"), F.col("target").alias("next"))
        moved = cut(found.join(onward, "target", "left").select("entity_id", F.coalesce("next", "target").alias("target"), "similarity", "name_score", F.col("next").isNotNull().alias("m")))
        found = moved.drop("m")
        if moved.filter("m").isEmpty():
            return found


def thresholds(new: DataFrame, known: DataFrame, taus: list[float], tau_name: float, most: int) -> DataFrame:
    """(tau_sim, merges, entities, merge_rate) of resolving ``new`` under each of ``taus``, from one search at the lowest.

    The nearest of a higher threshold are those of a lower one that still meet it, so an
    entity merges wherever its best candidate does.
    """
    best = _pairs(new, known, min(taus), tau_name, most).groupBy("q").agg(F.max("score").alias("score"))
    levels = F.array(*[F.lit(float(t)) for t in taus])
    merged = best.select(F.explode(F.filter(levels, lambda t: t <= F.col("score"))).alias("tau_sim")).groupBy("tau_sim").agg(F.count("*").alias("merges"))
    size = new.agg(F.count("*").alias("n")).select(F.explode(levels).alias("tau_sim"), "n")
    merges = F.coalesce("merges", F.lit(0)).cast("long")
    return size.join(merged, "tau_sim", "left").select("tau_sim", merges.alias("merges"), (F.col("n") - merges).alias("entities"), F.coalesce(F.round(F.try_divide(merges, "n"), 4), F.lit(0.0)).alias("merge_rate"))
