"""Recompute budgets against one stream of touches: all budgets at once, as a column.

What a change touches does not depend on which summaries were written before it, so
one build of the index serves every budget; only the queue of dirty keys differs.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir
from . import ranking

SERVED = "budget_no long, budget long, key string, since long, tokens long, step long"
QUEUE = "budget_no long, budget long, key string, since long, at long, tokens long"


class Sweep(NamedTuple):
    """``served``: what each budget recomputed at each step; ``left``: what is dirty at the end."""

    served: DataFrame
    left: DataFrame


def serve(touches: DataFrame, budgets: list[int | None], steps: list[int] | None = None) -> Sweep:
    """The queue of each budget under ``touches`` (step, key, tokens), one row a step and key.

    After each step a budget takes that many of the oldest dirty keys, those of one step by
    key; None takes all, 0 none.  A key that is touched while it waits keeps its place, and
    costs the ``tokens`` of its last touch; null tokens say that the key is gone.  ``steps``
    names steps without touches too.  One round of joins for each step, whatever the number
    of budgets; the ranks see at most the greatest budget's rows of each task.
    """
    spark = touches.sparkSession
    rows = touches.select(F.col("step").cast("long").alias("step"), F.col("key").cast("string").alias("key"), F.col("tokens").cast("long").alias("tokens")).filter("step is not null and key is not null")
    steps = [r.step for r in rows.select("step").distinct().orderBy("step").collect()] if steps is None else sorted(steps)
    variants = F.array(*[F.struct(F.lit(i).cast("long").alias("budget_no"), F.lit(b).cast("long").alias("budget")) for i, b in enumerate(budgets)])
    most = max([b for b in budgets if b is not None], default=0)
    folder = f"{shared_dir(spark)}/loomgraph-served-{uuid.uuid4().hex}"
    left = spark.createDataFrame([], QUEUE)
    spark.createDataFrame([], SERVED).drop("step").write.parquet(f"{folder}/step=-1")  # a folder to read where nothing is served
    for step in steps:
        fresh = rows.filter(F.col("step") == step).select(F.explode(variants).alias("v"), "key", "tokens")
        fresh = fresh.select("v.*", "key", F.lit(step).cast("long").alias("since"), F.lit(step).cast("long").alias("at"), "tokens")
        last = F.max(F.struct("at", "tokens"))
        waiting = left.unionByName(fresh).groupBy("budget_no", "budget", "key").agg(F.min("since").alias("since"), last.alias("last"))
        waiting = cut(waiting.select("budget_no", "budget", "key", "since", "last.at", "last.tokens").filter("tokens is not null"))
        order = F.row_number().over(Window.partitionBy("budget_no").orderBy("since", "key"))
        oldest = waiting.filter("budget > 0").withColumn("_rn", order).filter(F.col("_rn") <= most).filter(F.col("_rn") <= F.col("budget"))
        chosen = oldest.drop("_rn").unionByName(waiting.filter("budget is null")).drop("at")
        chosen.write.parquet(f"{folder}/step={step}")
        taken = spark.read.schema(SERVED).parquet(folder).filter(F.col("step") == step)
        left = waiting.filter("budget is not null").join(taken.select("budget_no", "key"), ["budget_no", "key"], "left_anti").select(*[c.split()[0] for c in QUEUE.split(", ")])
    return Sweep(spark.read.schema(SERVED).parquet(folder).filter("step >= 0"), left)


def points(swept: Sweep, budgets: list[int | None], fixed: int = 0) -> DataFrame:
    """(budget, recomputed, tokens, longest_wait, dirty, best): a point for each budget; ``fixed`` tokens are spent whatever the budget.

    ``best`` points are beaten by no other on tokens and dirty keys together.
    """
    spark = swept.served.sparkSession
    every = spark.createDataFrame(list(enumerate(budgets)), "budget_no long, budget long")
    spent = swept.served.groupBy("budget_no").agg(F.count("*").alias("recomputed"), F.sum("tokens").alias("tokens"), F.max(F.col("step") - F.col("since")).alias("longest_wait"))
    open_ = swept.left.groupBy("budget_no").agg(F.count("*").alias("dirty"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    found = every.join(spent, "budget_no", "left").join(open_, "budget_no", "left")
    found = cut(found.select("budget_no", "budget", zero("recomputed").alias("recomputed"), (zero("tokens") + F.lit(fixed)).alias("tokens"), "longest_wait", zero("dirty").alias("dirty")))
    best = ranking.frontier(found, "tokens", "dirty").select("budget_no", F.lit(True).alias("best"))
    return found.join(best, "budget_no", "left").select("budget", "recomputed", "tokens", "longest_wait", "dirty", F.coalesce("best", F.lit(False)).alias("best"))
