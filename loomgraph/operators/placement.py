"""Placement of new names into communities, in order, as a fixed point.

One by one, hubs first, a name joins the community that its neighbours vote for
and that has room, or seeds its own.  What a name does depends only on names
before it: on where its earlier neighbours went, and on how many earlier names
joined a community.  So the outcome of the one-by-one pass is the only assignment that
agrees with itself, and it is found by rounds in which every name decides at once,
given the last round's assignment of the names before it: after round n the first n
names are settled at least, and in practice all whose chains of earlier names are
no longer than n.  A round is a fixed number of joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..sources.shared import cut


def ranked(new: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(name, r): the new names with their place in the order, by falling number of relations, then by name."""
    degree = neighbours.groupBy("name").agg(F.count("*").alias("d"))
    placed = new.select("name").distinct().join(degree, "name", "left")
    return placed.select("name", F.struct((-F.coalesce("d", F.lit(0))).alias("d"), F.col("name").alias("n")).alias("r"))


def _closing(guess: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """(comm, last): the place of the name that takes the last seat of a community."""
    seat = F.row_number().over(Window.partitionBy("comm").orderBy("r"))
    seated = guess.select("comm", "r", seat.alias("seat")).filter(F.col("seat") <= most)
    full = seated.join(held, "comm", "left").filter(F.col("seat") == most - F.coalesce("held", F.lit(0)))
    return full.select("comm", F.col("r").alias("last"))


def place_all(new: DataFrame, neighbours: DataFrame, membership: DataFrame, most: int) -> DataFrame:
    """(name, comm) of all new names, as placing them one by one would give.

    ``neighbours`` (name, other, weight, support) has both directions of each relation;
    a neighbour votes with its weight times one more than the support; equal votes
    go to the smaller community.
    """
    order = cut(ranked(new, neighbours))
    vote = F.sum(F.col("weight") * (1 + F.col("support"))).alias("vote")
    pull = neighbours.join(order, "name").groupBy("name", "r", "other").agg(vote)
    home = membership.select(F.col("name").alias("other"), "comm")
    held = cut(membership.groupBy("comm").agg(F.count("*").alias("held")))
    known = cut(pull.join(home, "other").select("name", "r", "comm", "vote"))
    earlier = order.select(F.col("name").alias("other"), F.col("r").alias("before"))
    later = cut(pull.join(home, "other", "left_anti").join(earlier, "other").filter(F.col("before") < F.col("r")).drop("before"))

    own = keys.community_key(F.col("name"))
    guess = None
    while True:
        said, room = known, F.coalesce(F.col("held") < most, F.lit(True))
        if guess is not None:
            said = said.unionByName(later.join(guess.select(F.col("name").alias("other"), "comm"), "other").select("name", "r", "comm", "vote"))
        votes = said.groupBy("name", "r", "comm").agg(F.round(F.sum("vote"), 9).alias("vote")).join(held, "comm", "left").filter(room)
        if guess is not None:
            votes = votes.join(_closing(guess, held, most), "comm", "left").filter(F.col("last").isNull() | (F.col("r") <= F.col("last")))
        best = votes.groupBy("name").agg(F.min(F.struct((-F.col("vote")).alias("x"), "comm"))["comm"].alias("best"))
        now = order.join(best, "name", "left").select("name", "r", F.coalesce("best", own).alias("comm"))
        if guess is not None:
            now = now.join(guess.select("name", F.col("comm").alias("was")), "name")
        else:
            now = now.withColumn("was", F.lit(""))
        now = cut(now)
        guess = now.drop("was")
        if now.filter("comm <> was").isEmpty():
            return guess.select("name", "comm")
