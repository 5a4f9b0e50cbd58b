"""Evaluation: systems under a change stream, answer scores, cost against freshness."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text, vectors
from ..operators import budgets, ranking
from ..sources.shared import cut
from .engine import Engine, Settings

SYSTEMS = ("evolving", "full-reindex", "append-only", "flat-vector")

#: Summaries recomputed a change, from none to all.
BUDGETS: list[int | None] = [0, 1, 2, 4, 8, None]


class System:
    """A way to keep an index under a stream of changes; ``budget`` is the summaries recomputed a change, None for all."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "evolving", budget: int | None = None, settings: Settings | None = None):
        if kind not in SYSTEMS:
            raise ValueError(kind)
        self.spark, self.kind, self.budget, self.root = spark, kind, budget, root
        self.engine = Engine(spark, f"{root}/index", settings)
        self.versions: DataFrame | None = None

    def apply(self, changes: DataFrame) -> float:
        """Apply the changes and return the seconds it took."""
        began = time.perf_counter()
        if self.kind == "append-only":
            puts = changes.filter("op <> 'delete'")
            self.engine.apply(puts.withColumn("doc_id", F.concat("doc_id", F.lit("#v"), "seq")))
            self.engine.drain()
        elif self.kind == "full-reindex":
            before = self.engine.documents("active").select("doc_id", "uri", F.col("text").alias("content"))
            kept = before.join(changes.select("doc_id"), "doc_id", "left_anti").select(F.lit(0).cast("long").alias("seq"), F.lit("add").alias("op"), "doc_id", "uri", "content")
            rows = kept.unionByName(changes.filter("op <> 'delete'")).collect()  # the evaluation corpus
            self.engine.state.clear(keep=("costs",))
            self.engine.apply(self.spark.createDataFrame(rows, changes.schema))
            self.engine.drain()
        else:
            self.engine.apply(changes)
            if self.kind == "evolving":
                self.engine.drain() if self.budget is None else self.engine.recompute(self.budget)
        return time.perf_counter() - began

    def ask(self, questions: DataFrame) -> DataFrame:
        """(question, answer, …) of (question, answer, must_include, must_exclude, kind)."""
        if self.kind == "flat-vector":
            return self._flat(questions)
        return self.engine.query(questions.select("question"))

    def _flat(self, questions: DataFrame) -> DataFrame:
        embed = self.engine._embed
        asked = questions.select(F.col("question").alias("q"), embed("question").alias("qe"))
        chunks = self.engine.table("chunks")
        top = ranking.top_k(asked, chunks.select(F.col("chunk_id").alias("vec_id"), "embedding"), self.engine.settings.top_entities, others_only=False)
        lines = top.join(chunks.select(F.col("chunk_id").alias("vec_id"), "text"), "vec_id").groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.flat(F.col("text")).alias("t")))), lambda s: s["t"]), "\n").alias("context"))

        return asked.select("q").join(lines, "q", "left").select(F.col("q").alias("question"), rules.answer(F.col("q"), F.col("context")).alias("answer"), F.lit(0).cast("long").alias("stale_communities"))

    def stats(self) -> DataFrame:
        return self.engine.stats()


def score(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(question, kind, f1, em, recall, stale, abstained, correct) of each answer."""
    met = questions.withColumnRenamed("answer", "want").join(answers.select("question", "answer"), "question")
    abstained = text.abstains(F.col("answer"))
    recall, stale = ranking.fact_recall(F.col("answer"), F.col("must_include")), ranking.mentions_any(F.col("answer"), F.col("must_exclude"))
    rows = met.select("question", "kind", ranking.token_f1(F.col("answer"), F.col("want")).alias("f1"), (text.normal_answer(F.col("answer")) == text.normal_answer(F.col("want"))).alias("em"), recall.alias("recall"), stale.alias("stale"), abstained.alias("abstained"))
    return rows.withColumn("correct", (F.col("recall") == 1.0) & ~F.col("stale"))


def aggregate(scores: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(c)
    return scores.groupBy("kind").agg(F.count("*").alias("n"), *[mean(c) for c in ("f1", "em", "recall", "stale", "abstained", "correct")])


def scenario(make: Callable[[str], System], phases: list[tuple[str, DataFrame]], questions: DataFrame, kinds: dict[str, list[str]]) -> list[dict]:
    """Scores of every system after every phase, for the question kinds asked there."""
    out = []
    for name in SYSTEMS:
        system = make(name)
        for phase, changes in phases:
            seconds = system.apply(changes)
            asked = questions.filter(F.col("kind").isin(*kinds[phase]))
            rows = aggregate(score(asked, system.ask(asked))).collect() if kinds[phase] else []
            tokens = system.stats().first().tokens
            out += [{"system": name, "phase": phase, "seconds": seconds, "tokens": tokens} | r.asDict() for r in rows] or [{"system": name, "phase": phase, "seconds": seconds, "tokens": tokens}]
    return out


def frontier(points: DataFrame) -> DataFrame:
    """Points (budget, tokens, staleness) that no other beats on both."""
    return ranking.frontier(points, "tokens", "staleness")


def sweep(engine: Engine, base: DataFrame | None, steps: list[DataFrame], wanted: list[int | None] | None = None) -> DataFrame:
    """``budgets.points`` of keeping up with ``steps`` after a clean build of ``base`` (None: of what the index holds); tokens are those spent since the build.

    The index takes the changes once, with all summaries.  What each step made dirty and
    what its summaries cost gives the queue of every budget.
    """
    wanted = BUDGETS if wanted is None else wanted
    if base is not None:
        engine.apply(base)
    engine.drain()
    began = engine.state.version()
    ends, lost = [], []
    for i, changes in enumerate(steps):
        before = cut(engine.table("communities").select("comm"))
        engine.apply(changes)
        lost.append(cut(before.join(engine.table("communities"), "comm", "left_anti").select(F.lit(i).cast("long").alias("step"), F.col("comm").alias("key"), F.lit(None).cast("long").alias("tokens"))))
        engine.drain()
        ends.append(engine.state.version())
    spent = engine.table("costs").filter(F.col("seq") > began).withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
    step = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in ends]), lambda v: v < F.col("seq"))).cast("long")
    touches = spent.filter("comm is not null").groupBy(step.alias("step"), F.col("comm").alias("key")).agg(F.sum("tokens").alias("tokens"))
    for rows in lost:
        touches = touches.unionByName(rows)
    fixed = spent.filter("comm is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    return budgets.points(budgets.serve(cut(touches), wanted, list(range(len(steps)))), wanted, fixed)


def update_cost(costs: DataFrame) -> DataFrame:
    """(seq, tokens, delta) of the cost rows by commit: cumulative tokens and what each commit added."""
    each = costs.groupBy("seq").agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("delta"))
    total = F.sum("delta").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("seq", total.alias("tokens"), "delta")
