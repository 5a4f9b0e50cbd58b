"""Nearest vectors and the resolver against plain versions."""

import random

import numpy as np
import pytest

from loomgraph.functions import vectors
from loomgraph.operators import ranking, resolver
from loomgraph.plans import report_queries


def cosine(a, b):
    a, b = np.array(a or [], float), np.array(b or [], float)
    if a.size != b.size or not a.any() or not b.any():
        return 0.0
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("others", [True, False])
def test_top_k(spark, monkeypatch, others):
    monkeypatch.setattr(ranking, "BLOCK_QUERIES", 7)
    rng = random.Random(3)
    data = [(f"v{i:03d}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(6)]) for i in range(150)]
    data += [("none", None), ("empty", []), ("zero", [0.0] * 6), ("short", [1.0, 2.0])]
    asked = data[:20] + data[-4:] + [("q", [1.0, 1.0, 1.0, 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(data, "vec_id string, embedding array<float>")
    found = ranking.top_k(spark.createDataFrame(asked, "q string, qe array<float>"), rows, 5, others)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = sorted((r.q, r.rn, r.vec_id, round(r.score, 5)) for r in found.collect())
    want = []
    for q, qe in asked:
        scored = sorted((-round(cosine(qe, e), 5), v) for v, e in data if not (others and v == q))[:5]
        want += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored)]
    assert got == sorted(want)


def plain_matches(new, known, tau_sim, tau_name, most):
    titles = {i: [n, *a] for i, n, a, _ in known} | {i: [n] for i, n, _ in new}
    pool = [(i, e) for i, _, _, e in known] + [(i, e) for i, _, e in new]
    old, direct = {k[0] for k in known}, {}
    for i, name, e in new:
        near = sorted((-round(cosine(e, f), 5), j) for j, f in pool if j != i)[:most]
        fit = []
        for s, j in near:
            score = max(vectors.name_score(name, t) for t in titles[j])
            if -s >= tau_sim and score >= tau_name and (j in old or j < i):
                fit.append((-(-s + score), s, j))
        if fit:
            direct[i] = min(fit)[2]
    out = {}
    for i in direct:
        j = direct[i]
        while j in direct:
            j = direct[j]
        out[i] = j
    return out


def test_resolver_with_aliases(spark):
    rng = random.Random(1)
    stems = ["Silk Mill Group", "Loom Works", "Canal Traders", "Weavers Institute", "Jacquard Engine"]
    twist = [lambda x: x, lambda x: x + " Ltd", lambda x: x.replace("r", "rr", 1), lambda x: "".join(w[0] for w in x.split()), lambda x: x.upper()]
    vector = {s: np.array([rng.gauss(0, 1) for _ in range(8)]) for s in stems}
    near = lambda s, by: (vector[s] + by * np.array([rng.gauss(0, 1) for _ in range(8)])).round(3).tolist()
    known = [(f"k{i}", s, ["Old " + s, "Spinning Bee"] if i % 2 else [], near(s, 0.1)) for i, s in enumerate(stems)] + [("k9", "Nothing Alike", [], [])]
    new = [(f"m{i:02d}", rng.choice(twist)(s), near(s, rng.choice([0.05, 0.4]))) for i in range(40) for s in [rng.choice(stems)]]
    new += [("m90", "Spinning Bee", near(stems[1], 0.01)), ("m91", "Old Loom Works", near(stems[1], 0.01)), ("m92", "Nothing Alike", [])]
    assert len({i for i, *_ in new}) == len(new)
    frames = spark.createDataFrame(new, "entity_id string, name string, embedding array<double>"), spark.createDataFrame(known, "entity_id string, name string, aliases array<string>, embedding array<double>")
    for most in (20, 3):
        got = {r.entity_id: r.target for r in resolver.matches(*frames, 0.86, 0.9, most).collect()}
        want = plain_matches(new, known, 0.86, 0.9, most)
        assert got == want and (most < 20 or (want["m90"] == "k1" and want["m91"] == "k1" and "m92" not in want))
    assert resolver.matches(frames[0].limit(0), frames[1], 0.86, 0.9, 20).count() == 0


@pytest.mark.parametrize("query", ["resolved_names", "resolution_thresholds"])
def test_names_are_taken_from_the_documents_once(spark, tmp_path, monkeypatch, query):
    texts = [(i, t, "a") for i, t in enumerate(["at Silk Mill. The Silk Mill Ltd grew.", "Loom Works and the SILK Mill.", "Canal Traders met Canal Trader."])]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    given, kind = [], "matches" if query == "resolved_names" else "thresholds"
    run = getattr(resolver, kind)
    monkeypatch.setattr(resolver, kind, lambda new, *rest: given.append(new) or run(new, *rest))
    got = {tuple(r) for r in getattr(report_queries, query)(spark, str(tmp_path)).collect()}
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "embed" not in plan.replace("embedding", "")
    pool = [(r.name, r.name, r.embedding) for r in given[0].collect()]
    taus = [0.86] if query == "resolved_names" else [0.6, 0.7, 0.8, 0.86, 0.92, 0.98]
    want = [plain_matches(pool, [], t, 0.9, 20) for t in taus]
    if kind == "matches":
        assert {(r[0], r[1]) for r in got} == set(want[0].items()) and want[0]
    else:
        assert got == {(t, len(w), len(pool) - len(w), round(len(w) / len(pool), 4)) for t, w in zip(taus, want, strict=True)}
