"""Recompute budgets as a column against plain queues, and against an engine with a budget of its own."""

import random
import shutil

from pyspark.sql import functions as F

from loomgraph.operators import budgets, resolver
from loomgraph.plans import evaluation
from loomgraph.plans.engine import Engine
from loomgraph.streaming import feed

TOUCHES = "step long, key string, tokens long"


def plain(rows, budget, steps):
    queue, served = {}, []
    for step in steps:
        for at, key, tokens in rows:
            if at == step and tokens is None:
                queue.pop(key, None)
            elif at == step:
                queue[key] = (queue[key][0] if key in queue else step, tokens)
        chosen = sorted(queue, key=lambda k: (queue[k][0], k))[:budget]
        served += [(key, queue[key][0], queue.pop(key)[1], step) for key in chosen]
    return sorted(served), sorted((k, *v) for k, v in queue.items())


def test_every_budget_is_its_own_queue(spark):
    rng = random.Random(5)
    rows = [(s, f"k{k}", None if rng.random() < 0.1 else rng.randrange(1, 9)) for s in (1, 2, 4, 7) for k in rng.sample(range(12), 7)]
    wanted, steps = [0, 1, 3, 3, None], [1, 2, 3, 4, 7, 8]
    swept = budgets.serve(spark.createDataFrame(rows, TOUCHES), wanted, steps)
    served, left = swept.served.collect(), swept.left.collect()
    points = budgets.points(swept, wanted, 100).collect()
    for i, budget in enumerate(wanted):
        taken, open_ = plain(rows, budget, steps)
        assert sorted((r.key, r.since, r.tokens, r.step) for r in served if r.budget_no == i) == taken
        assert sorted((r.key, r.since, r.tokens) for r in left if r.budget_no == i) == open_
        spent, waits = 100 + sum(t for _, _, t, _ in taken), [at - since for _, since, _, at in taken]
        assert (budget, len(taken), spent, max(waits, default=None), len(open_)) in [tuple(p)[:5] for p in points]
    on = lambda a, b: a.tokens <= b.tokens and a.dirty <= b.dirty and (a.tokens < b.tokens or a.dirty < b.dirty)
    assert all(p.best == (not any(on(o, p) for o in points)) for p in points)


def test_sweep_without_touches(spark):
    swept = budgets.serve(spark.createDataFrame([(None, "a", 1), (1, None, 1)], TOUCHES), [0, 2, None])
    assert swept.served.isEmpty() and swept.left.isEmpty()
    assert sorted(tuple(p)[1:] for p in budgets.points(swept, [0, 2, None]).collect()) == [(0, 0, None, 0, True)] * 3


def test_sweep_equals_an_engine_with_a_budget(spark, tmp_path):
    said = lambda names: " ".join(f"{a} Works acquired {b} Group." for a, b in zip(names, names[1:], strict=False))
    base = [(i, "add", f"d{i}", None, said(w.split())) for i, w in enumerate(["Silk Mill Canal", "Loom Weft Port", "Coal Iron Steel"])]
    later = [[(10, "update", "d0", None, said(["Silk", "Weft", "Harbour"])), (11, "add", "d3", None, said(["Tin", "Lead"]))], [(12, "delete", "d2", None, None), (13, "update", "d1", None, said(["Loom", "Mill"]))]]
    rows = lambda x: spark.createDataFrame(x, feed.FEED)
    first = Engine(spark, str(tmp_path / "first"))
    first.apply(rows(base))
    first.drain()
    shutil.copytree(tmp_path / "first", tmp_path / "second")
    swept = {r.budget: r for r in evaluation.sweep(first, None, [rows(x) for x in later], [0, 1, None]).collect()}
    engine = Engine(spark, str(tmp_path / "second"))
    began, n = engine.state.version(), 0
    for batch in later:
        engine.apply(rows(batch))
        n += engine.recompute(1)
    tokens = engine.table("costs").filter(F.col("seq") > began).agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("n")).first().n
    assert (n, tokens, engine.staleness().first().dirty) == (swept[1].recomputed, swept[1].tokens, swept[1].dirty)
    assert swept[None].dirty == 0 and swept[0].dirty > 0 and swept[0].tokens < swept[1].tokens < swept[None].tokens


def test_thresholds_equal_a_run_for_each(spark):
    rng = random.Random(8)
    rows = [(f"e{i:02}", rng.choice(["Silk Mill", "Silk Mills", "Silk Mill Co", "Loom Works"]), [1.0, rng.random() / 2, rng.random() / 2]) for i in range(16)]
    new = spark.createDataFrame(rows, "entity_id string, name string, embedding array<double>")
    known = spark.createDataFrame([("k1", "Loom", ["Loom Works"], [1.0, 0.2, 0.1])], "entity_id string, name string, aliases array<string>, embedding array<double>")
    taus = [0.9, 0.97, 0.999]
    got = {r.tau_sim: r for r in resolver.thresholds(new, known, taus, 0.9, 20).collect()}
    for tau in taus:
        n = resolver.matches(new, known, tau, 0.9, 20).count()
        assert (got[tau].merges, got[tau].entities, got[tau].merge_rate) == (n, 16 - n, round(n / 16, 4))
