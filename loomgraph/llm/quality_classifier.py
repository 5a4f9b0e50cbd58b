"""Quality classifier by co-training.

Two views of a document: its words, and its metadata (language, source, length
and layout, without words).  Each view has a logistic classifier, fitted on a
bounded sample of labelled rows (``most_labelled``).  Over rounds each view
scores all documents without a label and hands its ``exchange`` most confident
documents of either class to the other view as pseudo-labels.  By default that
is a 60th of the documents without a label, but no more than a 30th of the fitted
labelled rows: metadata does not show toxic words, so pseudo-labels that
outnumber labels teach the words to pass them.  At the end both views are
calibrated on labelled rows that neither was fitted on, and their log odds are
added to score all documents.

A document is good if its quality is 1 and it is not toxic.  It is kept if its
score reaches ``threshold`` and its words alone do not speak against it: their log
odds reach 0, or a lower floor that ``pass_share`` of the good rows held out for
calibration reach.

Cases: a null or empty text has no words and is scored by the bias and its
metadata; null languages and sources are values of their own; labels that
disagree about a document count as bad; without labelled rows of both classes
every score is 0.5; repeated rows are scored each, and of rows that repeat a
labelled id the least (by text, language, source) is learnt; documents equally
confident are exchanged in order of ``doc_id``; a text of any length is read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import LOWER, MARKS, SPACE, Words, blocks, buffers, per_row
from .workers import tidy

BUCKETS = 1 << 16
LAYOUT = 8
_U = np.uint64
_NO_MARK = ~MARKS | SPACE
_CAPS = np.zeros(256, bool)
_CAPS[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def word_view(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and runs of marks of each row, and where each row begins."""
    keys = []
    for gap in (MARKS, _NO_MARK):
        words = Words(LOWER[data], off, gap)
        keys.append((words.doc.astype(np.int64) << 16) | (words.hashes() >> _U(48)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return (key & 0xFFFF).astype(np.int32), np.searchsorted(key >> 16, np.arange(off.size))


def layout(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Layout of each row: length, line length, shares of capitals, digits, marks, bars, symbols, other bytes."""
    n = np.maximum(np.diff(off), 1)
    lines = per_row(data == 10, off) + 1
    symbols = np.isin(data, np.frombuffer(b"#*$%&<>", np.uint8))
    shares = [_CAPS[data], _DIGIT[data], MARKS[data] & (data > 32), data == 124, symbols, data > 127]
    return np.stack([np.log1p(np.diff(off)), np.log1p(n / lines), *[per_row(x, off) / n for x in shares]], 1)


def _names(block: pa.RecordBatch, column: str) -> np.ndarray:
    values = block.column(block.schema.get_field_index(column)).to_pylist()
    return np.array([crc32(f"{column}:{v}".encode()) % 512 for v in values], np.int32)


class Meta:
    """Metadata features: each layout value by its bin, language and source by name."""

    def __init__(self, sample: np.ndarray, bins: int = 12):
        self.edges = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) for x in sample.T] if len(sample) else [np.zeros(0)] * LAYOUT

    def codes(self, values: np.ndarray, lang: np.ndarray, source: np.ndarray) -> np.ndarray:
        binned = [1024 + 64 * i + np.searchsorted(e, values[:, i], "right") for i, e in enumerate(self.edges)]
        return np.stack([lang, 512 + source, *binned], 1).astype(np.int32)


META_SIZE = 1024 + 64 * LAYOUT


def fit(features: list[np.ndarray], good: np.ndarray, size: int, steps: int = 1000, least: float = 12.0, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of binary features, by adaptive full-batch steps; classes weigh alike.

    Features whose chi-square with the class stays under ``least`` have weight 0.
    """
    count = np.array([f.size for f in features], np.int64)
    flat = np.concatenate(features) if features else np.zeros(0, np.int32)
    row = np.repeat(np.arange(count.size), count)
    n1, n0 = max(int(good.sum()), 1), max(int((~good).sum()), 1)
    with_1, with_0 = np.bincount(flat, good[row], size), np.bincount(flat, ~good[row], size)
    share = (with_1 + with_0) / (n1 + n0)
    chi = (with_1 / n1 - with_0 / n0) ** 2 / np.maximum(share * (1 - share) * (1 / n1 + 1 / n0), 1e-12)
    use = (chi >= least) & (share > 0)
    flat, row = flat[use[flat]], row[use[flat]]
    weight = np.where(good, 0.5 / n1, 0.5 / n0)
    w, b, seen, seen_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        margin = np.bincount(row, w[flat], count.size) + b
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - good) * weight
        g = np.bincount(flat, slope[row], size) + penalty * w
        seen, seen_b = seen + g * g, seen_b + slope.sum() ** 2
        w, b = w - 0.3 * g / np.sqrt(seen), b - 0.3 * slope.sum() / np.sqrt(seen_b)
    return np.where(use, w, 0.0), b


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into log odds of equally likely classes."""
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    scale = max(float(np.std(margin)), 1e-9)
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(weight * (p - good) * x) + 0.01 * a, np.sum(weight * (p - good))])
        s = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[np.sum(s * x * x) + 0.01, np.sum(s * x)], [np.sum(s * x), np.sum(s) + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a / scale), float(b)


def _features(rows: DataFrame) -> DataFrame:
    """(doc_id, words, layout, lang, source) of (doc_id, text, lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                data, off = buffers(block.column(1))
                code, first = word_view(data, off)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(code))
                shape = layout(data, off)
                shapes = pa.ListArray.from_arrays(pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * LAYOUT), pa.array(shape.ravel()))
                yield pa.RecordBatch.from_arrays([block.column(0), lists, shapes, pa.array(_names(block, "lang")), pa.array(_names(block, "source"))], ["doc_id", "words", "layout", "lang", "source"])

    return rows.select("doc_id", "text", "lang", "source").mapInArrow(tidy(run), "doc_id long, words array<int>, layout array<double>, lang int, source int")


def _gathered(docs: DataFrame, chosen: DataFrame) -> list:
    """Features of the bounded set ``chosen`` (doc_id, good), in order of doc_id; of rows that repeat an id the least."""
    rows = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("r")).select("doc_id", "r.*")
    return _features(rows).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()


def _scores(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, word_margin, meta_margin) of all documents."""
    shared = scratch.share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word_w, word_b), (meta_w, meta_b), meta = shared.value
        for batch in batches:
            for block in blocks(batch):
                data, off = buffers(block.column(1))
                code, first = word_view(data, off)
                row = np.repeat(np.arange(block.num_rows), np.diff(first))
                word = np.bincount(row, word_w[code], block.num_rows) + word_b
                codes = meta.codes(layout(data, off), _names(block, "lang"), _names(block, "source"))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(word), pa.array(meta_w[codes].sum(1) + meta_b)], ["doc_id", "word_margin", "meta_margin"])

    scored = scratch.stage(docs.select("doc_id", "text", "lang", "source").mapInArrow(tidy(run), "doc_id long, word_margin double, meta_margin double"), "margins")
    scratch.forget(shared)
    return scored


def _by_hash(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def classify(docs: DataFrame, labels: DataFrame, rounds: int = 2, exchange: int | None = None, most_labelled: int = 8000, threshold: float = 0.3, pass_share: float = 0.95) -> DataFrame:
    """(doc_id, word_score, meta_score, score, kept) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    named = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    named = scratch.stage(named.agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")), "labelled")
    chosen = scratch.stage(_by_hash(named.filter("good"), most_labelled // 2).union(_by_hash(named.filter("not good"), most_labelled // 2)), "chosen")
    sample = _gathered(docs, chosen)
    good = np.array([r.good for r in sample], bool)
    if not good.any() or good.all():
        half = F.lit(0.5)
        return docs.select("doc_id", half.alias("word_score"), half.alias("meta_score"), half.alias("score"), F.lit(True).alias("kept"))

    meta = Meta(np.array([r.layout for r in sample]))
    aside = np.array([crc32(str(r.doc_id).encode()) % 5 == 0 for r in sample])  # for calibration
    if good[aside].all() or not good[aside].any():
        aside = np.zeros(len(sample), bool)
    words = lambda rows: [np.array(r.words, np.int32) for r in rows]
    codes = lambda rows: list(meta.codes(np.array([r.layout for r in rows]), np.array([r.lang for r in rows], np.int32), np.array([r.source for r in rows], np.int32))) if rows else []
    train = [r for r, x in zip(sample, aside, strict=True) if not x]
    word_x, word_y = words(train), [r.good for r in train]
    meta_x, meta_y = codes(train), [r.good for r in train]
    used = chosen.select("doc_id")
    for last in [False] * rounds + [True]:
        word_model = fit(word_x, np.array(word_y, bool), BUCKETS)
        meta_model = fit(meta_x, np.array(meta_y, bool), META_SIZE)
        scored = _scores(docs, (word_model, meta_model, meta))
        if last:
            break
        if exchange is None:
            exchange = max(1, min((scored.count() - named.count()) // 60, len(train) // 30))
        free = scored.filter("doc_id is not null").join(named.select("doc_id"), "doc_id", "left_anti").join(F.broadcast(used), "doc_id", "left_anti")
        taken = []
        for view, x, y, describe in (("word_margin", meta_x, meta_y, codes), ("meta_margin", word_x, word_y, words)):
            top = free.filter(f"{view} > 0").orderBy(F.desc(view), "doc_id").limit(exchange).select("doc_id", F.lit(True).alias("good"))
            low = free.filter(f"{view} < 0").orderBy(F.asc(view), "doc_id").limit(exchange).select("doc_id", F.lit(False).alias("good"))
            picked = scratch.stage(top.union(low).groupBy("doc_id").agg(F.min("good").alias("good")), "picked")
            rows = _gathered(docs, picked)
            x.extend(describe(rows))
            y.extend(r.good for r in rows)
            taken.append(picked.select("doc_id"))
        used = used.union(taken[0]).union(taken[1])

    held = [r for r, x in zip(sample, aside, strict=True) if x] or sample
    truth = np.array([r.good for r in held], bool)
    share = named.agg(F.avg(F.col("good").cast("int"))).first()[0]
    prior = float(np.log(share / (1 - share)))
    word_held = np.array([word_model[0][w].sum() + word_model[1] for w in words(held)])
    word_scale = platt(word_held, truth)
    floor = min(0.0, float(np.quantile(word_scale[0] * word_held[truth] + word_scale[1], 1 - pass_share, method="lower")))
    meta_scale = platt(np.array([meta_model[0][c].sum() + meta_model[1] for c in codes(held)]), truth)
    odds = lambda c, s: F.lit(s[0]) * F.col(c) + F.lit(s[1])
    chance = lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), x)))
    word, page = odds("word_margin", word_scale), odds("meta_margin", meta_scale)
    score = chance(word + page + F.lit(prior))
    return scored.select("doc_id", chance(word).alias("word_score"), chance(page).alias("meta_score"), score.alias("score"), ((score >= threshold) & (word >= floor)).alias("kept"))
