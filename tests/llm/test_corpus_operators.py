"""Near-duplicates, repeated strings, scores, the classifier and the pipeline against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from loomgraph.llm import hmm_scoring, near_dedup, quality_classifier, suffix_dedup
from loomgraph.llm.components import components

from .helpers import LOW, awkward, frame, prose, rows, words


def sets(text, k):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = prose(50, 150).split(" ")
    texts = []
    for i in range(150):  # copies of a template around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 40)}"
        texts.append(" ".join(w))
    data = awkward() + [d | {"doc_id": 100 + i} for i, d in enumerate(rows(texts + [prose(70 + i, 60) for i in range(20)]))]
    for k in (2, 5):
        near_dedup.CROWD = 8  # small enough that blocks are used
        got = near_dedup.near_duplicates(frame(spark, data), k=k).collect()
        near_dedup.CROWD = 64
        named = [d for d in data if d["doc_id"] is not None]
        full = [sets(d["text"], k) for d in named]
        place = {d["doc_id"]: d["doc_id"] for d in named}
        for _ in range(len(named)):
            changed = False
            for i, a in enumerate(full):
                for j in range(i):
                    b = full[j]
                    x, y = place[named[i]["doc_id"]], place[named[j]["doc_id"]]
                    if x != y and (named[i]["doc_id"] == named[j]["doc_id"] or a and b and 100 * len(a & b) >= 80 * len(a | b)):
                        place = {d: min(x, y) if c in (x, y) else c for d, c in place.items()}
                        changed = True
            if not changed:
                break
        assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((d["doc_id"], place[d["doc_id"]]) for d in named)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert sorted(r.n_shingles for r in got) == sorted(len(sets(d["text"], k)) for d in data)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_ids_with_several_texts(spark):
    """Rows of one id are one document, in whatever order the rows come."""
    x, y, z = prose(1200, 90), prose(1201, 90), prose(1202, 90)
    near = lambda t, w: " ".join([*t.split(" ")[:-1], w])
    data = [(5, x), (5, y), (7, near(x, "seven")), (9, near(y, "nine")), (3, z), (11, z), (11, ""), (12, None), (12, near(y, "twelve")), (13, prose(1203, 90)), (None, x)]
    schema = "doc_id long, text string"
    want = {3: 3, 5: 5, 7: 5, 9: 5, 11: 3, 12: 5, 13: 13, None: None}
    for seed in range(3):
        random.Random(seed).shuffle(data)
        got = near_dedup.near_duplicates(spark.createDataFrame(data, schema)).collect()
        assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in got) == sorted(str((d, want[d], want[d] == d)) for d, _ in data)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    place = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in place:
        for u, v in edges:
            if u != v:
                place[u] = place[v] = min(place[u], place[v])
    assert got == place


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    factor, shift = near_dedup._seeds(200)
    hashed = near_dedup.mix(a + np.uint64(1)), near_dedup.mix(b + np.uint64(1))
    same = 0
    for j in range(200):
        x, y = ((h ^ shift[j]) * factor[j] for h in hashed)
        same += int(x.min() == y.min()) + int(x.max() == y.max())
    assert abs(same / 400 - 800 / 1200) < 0.1


def test_suffix_arrays():
    rng = np.random.default_rng(6)
    for n, k in ((0, 1), (1, 2), (2, 1), (200, 2), (300, 4), (64, 1), (130, 300)):
        text = rng.integers(0, k, n)
        order, packed, bits = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        part, *word = suffix_dedup.suffix_array(text, 5)
        assert [text[i : i + 5].tolist() for i in part] == sorted(text[i : i + 5].tolist() for i in range(n))
        for found, depth, rest in ((order, 7, (packed, bits)), (part, 5, word)):
            pairs = [(text[a : a + depth].tolist(), text[b : b + depth].tolist()) for a, b in zip(found, found[1:])]
            same = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in pairs]
            assert suffix_dedup.common_prefixes(found, *rest, depth).tolist() == [0] * (n > 0) + same


def test_runs_of_one_anchor_are_told_apart():
    """Two texts that share a rare 16-byte gram and no 50 bytes: no content hash of one is among those of the other."""
    rng = random.Random(8)
    draw = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    seen, n = set(), 0
    for _ in range(400):
        data = np.frombuffer(draw(40) + b"zzzzyyyyxxxxwwww" + draw(40), np.uint8)
        _, h, g, _, _ = suffix_dedup.runs(data, np.array([0, 96]))
        assert g.dtype == np.int64
        seen |= set(zip(h.tolist(), g.tolist()))
        n += h.size
    assert len(seen) == n


def plain_repeats(data):
    width, first = 50, {}
    for d in data:
        b = (d["text"] or "").encode()
        for i in range(len(b) - width + 1):
            if d["doc_id"] is not None:
                first[b[i : i + width]] = min(first.get(b[i : i + width], 1 << 60), d["doc_id"])
    for d in data:
        b = (d["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if d["doc_id"] is not None and first[b[i : i + width]] < d["doc_id"]:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield d["doc_id"], len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_repeated_strings(spark, monkeypatch):
    passage, per = prose(90, 30), "ab" * 60
    texts = [f"{prose(i, 12)} {passage} {prose(100 + i, 9)}" for i in range(12)] + [per, "x" + per + "y", "a" * 49, "a" * 300, "a" * 50, "é" * 40, "z" + "é" * 40, passage[5:70], passage[7:60]]
    data = awkward() + [d | {"doc_id": 100 + i} for i, d in enumerate(rows(texts))]
    key = lambda r: tuple(map(str, r))
    want = sorted(plain_repeats(data), key=key)
    for size in (2 << 20, 400):  # one shard, and anchors that span shards
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
        got = suffix_dedup.remove_repeats(frame(spark, data)).collect()
        assert sorted([tuple(r) for r in got], key=key) == want
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_repeated_strings_within_a_document(spark, monkeypatch):
    texts = []
    for i in range(20):  # the later document has a passage of the earlier one twice, between the same words
        passage = prose(500 + i, 14)
        texts += [f"{prose(600 + i, 9)} {passage} {prose(700 + i, 9)}", "\n".join([f"{prose(800 + i, 6)} {passage} {prose(900 + i, 6)}"] * 2)]
    data = rows(texts)
    want = sorted(plain_repeats(data))
    assert sum(r[2] for r in want) > 0
    for size in (2 << 20, 400):
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
        assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, data)).collect()) == want


def test_repeated_strings_of_random_documents(spark):
    """Pieces of a common store in any order, whole and cut, against brute force."""
    rng = random.Random(21)
    store = [prose(1500 + i, rng.randint(4, 25)) for i in range(60)]
    texts = []
    for _ in range(500):
        parts = [rng.choice(store)[rng.randint(0, 9) :] if rng.random() < 0.5 else prose(rng.randrange(10**6), rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", ""]).join(parts))
    data = rows(texts)
    assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, data)).collect()) == sorted(plain_repeats(data))


def test_repeated_strings_of_a_very_long_text(spark):
    long = prose(77, 120_000)  # more than a block
    data = rows(["short " + long[200_000:200_400], long, long[700_000:700_300] + " end"])
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(frame(spark, data)).collect()}
    assert got == {r[0]: r[2] for r in plain_repeats(data)} and got[2] >= 300


def test_forward_recursion_is_the_sum_over_paths():
    model = hmm_scoring.Model(np.arange(3, dtype=np.uint64), np.ones(hmm_scoring.CLASSES))
    cls = np.array([0, 1, 2, hmm_scoring.CLASSES - 1])
    alpha = model.start * model.emit[:, cls[0]]
    for c in cls[1:]:
        alpha = (alpha @ model.move) * model.emit[:, c]
    got = hmm_scoring.likelihood(model, np.concatenate((cls, cls[:2])), np.array([0, 4]), np.array([4, 2]))
    assert abs(got[0] - math.log10(alpha.sum())) < 1e-9


def test_pieces_give_what_whole_sequences_give(monkeypatch):
    rng = np.random.default_rng(3)
    model = hmm_scoring.Model(np.arange(9, dtype=np.uint64), np.ones(hmm_scoring.CLASSES))
    n = np.array([1, 40, 7, 200, 64, 65, 8, 16])
    first = np.cumsum(n) - n
    cls = rng.integers(0, 30, int(n.sum()))
    model.update(hmm_scoring.expected(model, cls, first, n))
    whole = hmm_scoring.expected(model, cls, first, n), hmm_scoring.likelihood(model, cls, first, n)
    for segment in (1, 8, 33):
        monkeypatch.setattr(hmm_scoring, "SEGMENT", segment)
        assert np.allclose(hmm_scoring.expected(model, cls, first, n), whole[0], rtol=1e-3, atol=1e-3)
        assert np.allclose(hmm_scoring.likelihood(model, cls, first, n), whole[1], rtol=1e-9)
    assert abs(whole[0][: hmm_scoring.STATES].sum() - n.size) < 1e-2  # a start a sequence


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(1)
    model = hmm_scoring.Model(np.arange(40, dtype=np.uint64), np.ones(hmm_scoring.CLASSES))
    cls = np.concatenate([np.append(rng.integers(0, 20, 30) + 20 * (i % 2), hmm_scoring.CLASSES - 1) for i in range(40)])
    first, n = np.arange(40) * 31, np.full(40, 31)
    before = hmm_scoring.likelihood(model, cls, first, n).sum()
    for _ in range(4):
        model.update(hmm_scoring.expected(model, cls, first, n))
        after = hmm_scoring.likelihood(model, cls, first, n).sum()
        assert after >= before - 1e-3
        before = after


def test_scores(spark):
    data = awkward() + [d | {"doc_id": 100 + i} for i, d in enumerate(rows([prose(i, 60) for i in range(80)] + ["unseenword " * 3]))]
    count = collections.Counter()
    tokens = lambda t: [*words((t or "").translate(LOW)), None]
    held = lambda d: zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 5 == 1
    for d in data:
        if not held(d):
            count.update(tokens(d["text"]))
    n, v = sum(count.values()), len(count)
    key = lambda r: tuple(map(str, r))
    want = sorted([(d["doc_id"], held(d), len(tokens(d["text"])), sum(count[t] > 0 for t in tokens(d["text"])), n, round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(d["text"])), 5)) for d in data], key=key)
    totals = []
    for most in (2_000_000, 20):  # all counts held, and most of them joined
        got = hmm_scoring.score(frame(spark, data), steps=2, most_held=most).collect()
        assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got], key=key) == want
        totals.append(sum(r.score for r in got))
        assert all(r.score < 0 for r in got)
    assert abs(totals[0] - totals[1]) < 1e-6 * abs(totals[0])
    assert hmm_scoring.score(frame(spark, [])).count() == 0


def test_classifier(spark):
    rng = random.Random(3)
    good = [prose(i, rng.randint(60, 200)) for i in range(300)]
    junk = [" | ".join(words(prose(1000 + i, 80))) for i in range(150)] + [" ".join(w + "!!" for w in words(prose(2000 + i, 80))).upper() for i in range(150)]
    data = [d | {"doc_id": i} for i, d in enumerate(rows(good + junk))]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(600) if i % 2] + [(None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(frame(spark, data), labels, rounds=1, exchange=20).collect()}
    held = [i for i in range(600) if i % 2 == 0]
    assert sum(got[i].kept == (i < 300) for i in held) / len(held) > 0.95
    odd = quality_classifier.classify(frame(spark, awkward()), labels)
    assert odd.count() == len(awkward()) and {r.score for r in odd.collect()} == {0.5}
    assert quality_classifier.classify(frame(spark, []), labels).count() == 0


def test_classifier_rejects_toxic_words(spark):
    rng = random.Random(5)
    texts = [prose(5000 + i, rng.randint(60, 200)) for i in range(900)]
    toxic = list(range(0, 900, 15))
    for k, i in enumerate(toxic):  # good in all but a word
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = f"venom{k % 2}"
        texts[i] = " ".join(w)
    junk = [" | ".join(words(prose(7000 + i, 80))) for i in range(150)]
    data = [d | {"doc_id": i} for i, d in enumerate(rows(texts + junk))]
    held = set(toxic[::3])
    known = [(i, int(i < 900), int(i in toxic)) for i in range(1050) if (i not in held if i in toxic else i % 3)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_classifier.classify(frame(spark, data), labels).collect()}
    clean = [i for i in range(0, 900, 3) if i not in toxic]
    assert sum(not got[i] for i in held) / len(held) > 0.8
    assert sum(got[i] for i in clean) / len(clean) > 0.9


def test_pipeline(spark, tmp_path):
    item = prose(400, 40)
    texts = [prose(300 + i, 90) for i in range(30)] + [prose(300, 90), f"{prose(41, 60)} {item}"]
    data = awkward() + [d | {"doc_id": 100 + i} for i, d in enumerate(rows(texts))]
    frame(spark, data).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = docs
        if name != "token_shards":
            assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
    ids = lambda n: {r.doc_id for r in left[n].collect()}
    assert set(range(100, 132)) <= ids("quality_rules") and not {0, 1, 2, 3, 4} & ids("quality_rules")
    assert 130 not in ids("near_dedup") and {100, 131} <= ids("near_dedup")
    assert 131 not in ids("decontamination") and ids("near_dedup") - ids("decontamination") == {131}
    assert ids("mixing") <= ids("decontamination")
    first, second = (corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2))
    assert left["token_shards"].count() == left["mixing"].count() == first.count() == second.count()  # a later run leaves earlier results alone
    starts = sorted((r.start, r.n_tokens) for r in left["token_shards"].collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert re.match(r"\d", str(starts[0][0]))
