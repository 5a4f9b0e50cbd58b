"""SimHash links and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomgraph.llm import ranked_search, simhash

from .helpers import LOW, awkward, frame, prose, rows, words


def plain_fingerprint(text, k=4):
    w = [x.translate(LOW) for x in words(text)]
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, marks, most=4):
    """Smallest id reachable, by a plain search over all pairs."""
    parent = {i: i for i in ids if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, f) for i, f in zip(ids, marks, strict=True) if i is not None]
    for a, (i, f) in enumerate(known):
        for j, g in known[:a]:
            if (f ^ g).bit_count() <= most:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def check(spark, data):
    got = simhash.near_fingerprints(frame(spark, data)).collect()
    marks = [plain_fingerprint(d["text"]) for d in data]
    want = plain_components([d["doc_id"] for d in data], marks)
    expected = sorted((str(d["doc_id"]), f"{f:016x}", str(want.get(d["doc_id"]))) for d, f in zip(data, marks, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


def test_simhash_rows(spark):
    data = awkward()
    data.append(dict(data[7]) | {"doc_id": 3})  # an id with two texts
    check(spark, data)
    assert simhash.near_fingerprints(frame(spark, [])).collect() == []


def test_simhash_groups(spark):
    rng = random.Random(5)
    texts = []
    for g in range(6):
        base = prose(100 + g, 300).split(" ")
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(8)):
                w[rng.randrange(len(w))] = rng.choice("new changed other".split())
            texts.append(" ".join(w))
    rng.shuffle(texts)
    check(spark, rows(texts + ["x", "x"] * 10))


def test_simhash_links_of_crafted_fingerprints(spark, monkeypatch):
    """Chains, hubs and unlike members of one bucket, with pieces of a few rows."""
    monkeypatch.setattr(simhash, "PIECE", 7)
    rng = random.Random(8)
    marks = {0, (1 << 64) - 1}
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(8):
            marks.add(at)
            for bit in rng.sample(range(64), rng.choice([1, 4, 5])):
                at ^= 1 << bit
    base = rng.getrandbits(64)
    marks |= {base ^ rng.getrandbits(50) for _ in range(60)}  # one hot bucket
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    classes = spark.createDataFrame([(s,) for s in signed], "f long")
    from loomgraph.llm.components import components

    links = simhash.linked(classes).collect()
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = plain_components(signed, marks)
    assert {s: got.get(s, s) for s in signed} == {s: min(x for x in signed if want[x] == want[s]) for s in signed}


@pytest.mark.parametrize("n", [10, 1 << 17, 1 << 25, 1 << 40])
def test_every_near_pair_shares_a_bucket(n):
    masks = [m & ((1 << 64) - 1) for m in simhash.block_masks(n)]
    rng = random.Random(n)
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & difference for m in masks)


def test_pivot_table_discards_only_far_pairs():
    rng = np.random.default_rng(4)
    f = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    f = np.concatenate((f, f ^ np.uint64(0b10110), f ^ np.uint64(0b1111100)))
    a, b = simhash.swept(f, np.zeros(f.size, np.int64), np.arange(f.size), 4)
    want = {(i, j) for i in range(f.size) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= 4}
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == want


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, most=20):
    terms = lambda t: Counter(TERM.findall((t or "").translate(LOW)))
    held = [(d["doc_id"], terms(d["text"])) for d in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_all
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d, score))
        out += [(i, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return out


ITEMS = "item_id long, text string, doc_id long, score long"


def test_ranked_search(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_ROWS", 100)
    data = awkward() + [d | {"doc_id": 1000 + i} for i, d in enumerate(rows([prose(200 + i % 90, 5 + i % 40) for i in range(700)]))]
    items = [(1, "loom weft WARP, loom!"), (2, prose(205, 30)), (3, None), (4, "..."), (5, "absent words only zzz"), (None, "silk mill"), (6, prose(7, 200)), (6, "twill"), (7, "ñandú é 😀")]
    bench = spark.createDataFrame([(i, t, 5, 5) for i, t in items], ITEMS)
    for block in (8 << 20, 1):  # one block, and one for each item
        got = [tuple(r) for r in ranked_search.search(frame(spark, data), bench, block_bytes=block).collect()]
        key = lambda x: (str(x[0]), x[1])
        assert sorted(got, key=key) == sorted(plain_search(data, items), key=key)
    assert ranked_search.search(frame(spark, []), bench).collect() == []
    assert ranked_search.search(frame(spark, data), bench.limit(0)).collect() == []


def test_search_opens_few_ranges_and_all_ties():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 4096, 50
    size = rng.integers(1, 6, n_docs)
    first = np.concatenate(([0], np.cumsum(size)))
    term = np.concatenate([np.sort(rng.choice(n_terms, k, False, p=np.arange(1, 51) / 1275)) for k in size])
    tf, n = np.ones(term.size, np.int64), np.full(n_docs, 10)
    weight = np.linspace(900, 100, n_terms).astype(np.int64)
    tree = ranked_search.Tree(n, first, term, tf, weight, n_docs, 10 * n_docs)
    ids = rng.permutation(n_docs).tolist()
    for asked in (np.array([0, 1]), np.array([30, 40, 49]), np.array([5])):
        best = []
        opened = tree.search(asked, weight[asked], ids, best, 20)
        impact = 10**9 // (1000 + 12 * 100)
        scores = np.zeros(n_docs, np.int64)
        np.add.at(scores, np.repeat(np.arange(n_docs), size), np.where(np.isin(term, asked), weight[term], 0) * impact)
        want = sorted(((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s))[:20]
        assert sorted((-s, -i) for s, _, i in best) == want
        assert asked.size > 1 or opened < 200
