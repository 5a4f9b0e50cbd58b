"""Placement as rounds against placement one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from loomgraph.operators import placement


def one_by_one(new, relations, membership, most):
    home = dict(membership)
    size = Counter(home.values())
    around = defaultdict(list)
    for a, b, weight, support in relations:
        around[a].append((b, weight, support))
        around[b].append((a, weight, support))
    for v in sorted(new, key=lambda v: (-len(around[v]), v)):
        votes = Counter()
        for other, weight, support in around[v]:
            if other in home:
                votes[home[other]] += weight * (1 + support)
        fit = [c for c, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])) if size[c] < most]
        home[v] = fit[0] if fit else "c-" + hashlib.sha256(v.encode()).hexdigest()[:12]
        size[home[v]] += 1
    return {v: home[v] for v in new}


def placed(spark, new, relations, membership, most):
    both = [(a, b, w, s) for a, b, w, s in relations] + [(b, a, w, s) for a, b, w, s in relations]
    frames = (
        spark.createDataFrame([(v,) for v in new], "name string"),
        spark.createDataFrame(both, "name string, other string, weight double, support long"),
        spark.createDataFrame(membership, "name string, comm string"),
    )
    return {r.name: r.comm for r in placement.place_all(*frames, most).collect()}


@pytest.mark.parametrize("seed, n, links, most", [(1, 40, 60, 3), (2, 60, 200, 8), (3, 30, 25, 2), (4, 50, 120, 1)])
def test_like_one_by_one(spark, seed, n, links, most):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    rng.shuffle(names)
    old, new = names[: n // 4], names[n // 4 :]
    relations = [(*rng.sample(names, 2), rng.choice([1.0, 1.0, 2.5]), rng.randrange(4)) for _ in range(links)]
    membership = [(v, f"c{rng.randrange(4)}") for v in old]
    assert placed(spark, new, relations, membership, most) == one_by_one(new, relations, membership, most)


def test_hub_chain_and_strangers(spark):
    spokes = [("hub", f"s{i}", 1.0, 1) for i in range(12)]  # more than a community holds
    chain = [(f"k{i}", f"k{i + 1}", 1.0, 1) for i in range(8)]
    new = ["hub", "alone", *[f"s{i}" for i in range(12)], *[f"k{i}" for i in range(9)]]
    for most in (4, 100):
        assert placed(spark, new, spokes + chain, [], most) == one_by_one(new, spokes + chain, [], most)
    assert placed(spark, [], spokes, [("hub", "c")], 4) == {}
