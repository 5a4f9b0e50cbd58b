"""Language-model scores of a hidden Markov model over words.

A state emits a word class and the class emits the word: the most frequent
words are classes of their own, the others are classed by their last letters,
so the model has a fixed size while word counts follow the corpus.  Baum-Welch
counts of all training documents are summed across partitions; a document's
score is the exact likelihood of its whole sequence by the scaled forward
recursion.  Long sequences are worked in pieces of ``SEGMENT`` tokens, side by
side: the transfer matrix of each piece hands the state on at its borders, so
counts and likelihoods are those of the whole sequence.

Words of at least some count, chosen so that they are at most ``most_held``,
are broadcast as a sorted hash array; the counts of all others come by a join.

Cases: a null or empty text is one end token; a null ``doc_id`` counts as the
empty text in the split; repeated rows are learnt and scored each; without
training documents every word is unknown; words equally frequent become classes
in the order of their hashes; a text of any length is one sequence; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import LOWER, HashArray, Words, blocks, buffers, mix
from .workers import tidy

STATES, OWN, ENDINGS = 6, 448, 63
CLASSES = OWN + ENDINGS + 1  # the last is the end token
SEGMENT = 512
_U = np.uint64


def in_training() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1


def _column(block: pa.RecordBatch, name: str) -> pa.Array:
    return block.column(block.schema.get_field_index(name))


def _words(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of the lower-cased words of a block, and hashes of their last two bytes."""
    data, off = buffers(_column(block, "text"))
    words = Words(LOWER[data], off)
    last = words.data[words.end - 1].astype(_U)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(_U)
    return words.hashes(), mix((last << _U(8)) | before) % _U(ENDINGS), words


def count_words(docs: DataFrame) -> DataFrame:
    """(h, ending, n) of the words of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged(parts: list[tuple]) -> tuple:
            h, e, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, e, n = h[order], e[order], n[order]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if h.size else np.zeros(0, int)
            return h[edge], e[edge], np.add.reduceat(n, edge) if edge.size else n

        def out() -> pa.RecordBatch:
            h, e, n = merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], ["h", "ending", "n"])

        for batch in batches:
            for block in blocks(batch, limit=1 << 19):
                h, e, _ = _words(block)
                held.append(merged([(h, e, np.ones(h.size, np.int64))]))
                if len(held) == 4:
                    held[:] = [merged(held)]
                if held[0][0].size > 500_000:
                    yield out()
        if held:
            yield out()

    each = docs.select("text").mapInArrow(tidy(run), "h long, ending int, n long")
    return each.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


class Model:
    """The hidden Markov model: start, move (from, to) and emit (state, class) probabilities."""

    def __init__(self, own: np.ndarray, class_n: np.ndarray):
        rng = np.random.default_rng(7)
        self.own = HashArray(own, np.arange(own.size))
        share = (class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.3 / (STATES - 1)) + np.eye(STATES) * (0.7 - 0.3 / (STATES - 1))
        emit = share * rng.uniform(0.4, 1.6, (STATES, CLASSES))
        self.emit = emit / emit.sum(1, keepdims=True)

    def classes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        found = self.own.find(h)
        return np.where(found >= 0, self.own.values[0][found] if self.own.keys.size else 0, OWN + ending.astype(np.int64))

    def update(self, counts: np.ndarray) -> None:
        start, move, emit = np.split(counts, [STATES, STATES + STATES * STATES])
        norm = lambda x, k: (x + k) / (x + k).sum(-1, keepdims=True)
        self.start = norm(start, 0.1)
        self.move = norm(move.reshape(STATES, STATES), 0.1)
        self.emit = norm(emit.reshape(STATES, CLASSES), 0.01)


SIZE = STATES + STATES * STATES + STATES * CLASSES


def _sequences(model: Model, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes with an end token after each row, first token and length of each row, and word positions."""
    h, ending, words = _words(block)
    n = words.count + 1
    first = np.cumsum(n) - n
    cls = np.full(int(n.sum()), CLASSES - 1, np.int64)
    at = np.arange(h.size) + words.doc
    cls[at] = model.classes(h, ending)
    return cls, first, n, at


def _pieces(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first token, length, row, is the first, is the last) of the pieces of sequences, in order."""
    count = np.maximum((n + SEGMENT - 1) // SEGMENT, 1)
    row = np.repeat(np.arange(n.size), count)
    number = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
    begin = first[row] + number * SEGMENT
    return begin, np.minimum(first[row] + n[row] - begin, SEGMENT), row, number == 0, number == count[row] - 1


def _by_length(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by falling length, and how many are longer than each step."""
    order = np.argsort(-length, kind="stable")
    steps = int(length[order[0]]) if length.size else 0
    return order, np.searchsorted(-length[order], -np.arange(steps), "left")


def _transfer(model: Model, cls: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Matrix, up to a factor, from the state expected at the first token of each piece to that expected after its last."""
    order, active = _by_length(length)
    begin = begin[order]
    emit = np.ascontiguousarray(model.emit.T)
    product = np.tile(np.eye(STATES), (begin.size, 1, 1))
    for t, k in enumerate(active):
        product[:k] = (product[:k] * emit[cls[begin[:k] + t]][:, None, :]) @ model.move
        if t % 16 == 15:
            product[:k] /= product[:k].sum((1, 2), keepdims=True)
    out = np.empty_like(product)
    out[order] = product / product.sum((1, 2), keepdims=True)
    return out


def _borders(model: Model, cls: np.ndarray, begin: np.ndarray, length: np.ndarray, head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of the state at the first token of each piece given what stands before it, and weight of what follows by the state after its last."""
    enter, leave = np.tile(model.start, (begin.size, 1)), np.ones((begin.size, STATES))
    inner = np.flatnonzero(~(head & last))
    if not inner.size:
        return enter, leave
    move = np.zeros((begin.size, STATES, STATES))
    move[inner] = _transfer(model, cls, begin[inner], length[inner])
    number = np.arange(begin.size) - np.maximum.accumulate(np.where(head, np.arange(begin.size), 0))
    by = np.argsort(number, kind="stable")
    edge = np.searchsorted(number[by], np.arange(int(number.max()) + 2))
    for i in range(1, edge.size - 1):
        at = by[edge[i] : edge[i + 1]]
        x = np.einsum("ks,kst->kt", enter[at - 1], move[at - 1])
        enter[at] = x / x.sum(1, keepdims=True)
    for i in range(edge.size - 2, 0, -1):
        at = by[edge[i] : edge[i + 1]]
        x = np.einsum("kst,kt->ks", move[at], leave[at])
        leave[at - 1] = x / x.sum(1, keepdims=True)
    return enter, leave


def expected(model: Model, cls: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected counts (start, moves, emissions) of the sequences ``cls[first:first + n]``."""
    begin, length, _, head, last = _pieces(first, n)
    enter, leave = _borders(model, cls, begin, length, head, last)
    order, active = _by_length(length)
    begin, head, last, enter, leave = begin[order], head[order], last[order], enter[order].astype(np.float32), leave[order].astype(np.float32)
    emit = np.ascontiguousarray(model.emit.T, np.float32)
    move = model.move.astype(np.float32)
    alpha, scale = [], []
    for t, k in enumerate(active):
        e = emit[cls[begin[:k] + t]]
        a = (enter[:k] if t == 0 else alpha[-1][:k] @ move) * e
        s = a.sum(1, keepdims=True)
        alpha.append(a / s)
        scale.append(s)
    moves = np.zeros((STATES, STATES))
    gamma = np.zeros((cls.size, STATES), np.float32)
    beta = np.zeros((0, STATES), np.float32)
    for t in range(active.size - 1, -1, -1):
        k, m = active[t], beta.shape[0]
        now = np.ones((k, STATES), np.float32)
        if m:
            ahead = emit[cls[begin[:m] + t + 1]] * beta / scale[t + 1]
            now[:m] = ahead @ move.T
            moves += alpha[t][:m].T.astype(np.float64) @ ahead
        cut = m + np.flatnonzero(~last[m:k])  # pieces that end here and go on in the next
        if cut.size:
            back = leave[cut] @ move.T
            c = (alpha[t][cut] * back).sum(1, keepdims=True)
            now[cut] = back / c
            moves += alpha[t][cut].T.astype(np.float64) @ (leave[cut] / c)
        gamma[begin[:k] + t] = alpha[t] * now
        beta = now
    moves *= model.move
    emissions = np.stack([np.bincount(cls, gamma[:, s], CLASSES) for s in range(STATES)])
    return np.concatenate((gamma[begin[head]].sum(0), moves.ravel(), emissions.ravel()))


def likelihood(model: Model, cls: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence, by the scaled forward recursion."""
    begin, length, row, head, last = _pieces(first, n)
    enter, _ = _borders(model, cls, begin, length, head, last)
    order, active = _by_length(length)
    start, a = begin[order], enter[order]
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(begin.size)
    for t, k in enumerate(active):
        e = emit[cls[start[:k] + t]]
        a = (a[:k] if t == 0 else a[:k] @ model.move) * e
        s = a.sum(1)
        a /= s[:, None]
        total[:k] += np.log10(s)
    return np.bincount(row[order], total, n.size)


def baum_welch(docs: DataFrame, model: Model, steps: int) -> Model:
    """``steps`` rounds of re-estimation on all of ``docs``."""
    for _ in range(steps):
        shared = scratch.share(docs.sparkSession, model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SIZE)
            for batch in batches:
                for block in blocks(batch, limit=1 << 19):
                    cls, first, n, _ = _sequences(shared.value, block)
                    total += expected(shared.value, cls, first, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(total)], ["i", "x"])

        counts = np.zeros(SIZE)
        for r in docs.select("text").mapInArrow(tidy(run), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            counts[r.i] = r.x
        model.update(counts)
        scratch.forget(shared)
    return model


def score(docs: DataFrame, steps: int = 3, most_held: int = 1_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    train = docs.filter(in_training())
    spark = docs.sparkSession
    scratch.small_batches(spark)
    vocabulary = scratch.stage(count_words(train), "words")
    n_docs = docs.select("doc_id").filter(in_training()).count()
    types, tokens = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, distinct = tokens + n_docs, types + (n_docs > 0)

    top = vocabulary.orderBy(F.desc("n"), "h").limit(OWN).collect()
    own = np.array([r.h for r in top], np.int64).view(_U)
    class_n, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[: len(top)] = [r.n for r in top]
    class_types[: len(top)] = 1
    for r in vocabulary.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[OWN + r.ending], class_types[OWN + r.ending] = r.n, r.v
    for r in top:
        class_n[OWN + r.ending] -= r.n
        class_types[OWN + r.ending] -= 1
    class_n[-1] = n_docs
    model = baum_welch(train, Model(own, class_n), steps)

    # Words of count ``least`` or more are at most ``most_held``.
    least, held = 1, 0
    for r in vocabulary.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("v")).orderBy(F.desc("n")).collect():
        held += r.v
        if held > most_held:
            least = r.n + 1
            break
    head = vocabulary.filter(F.col("n") >= least).select("h", "n").toArrow()
    table = HashArray(head.column("h").to_numpy().view(_U), head.column("n").to_numpy())
    whole = least == 1
    base_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    room = class_n + 0.5 * (class_types + 1)
    shared = scratch.share(spark, (model, table, room))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, room = shared.value
        for batch in batches:
            for block in blocks(batch, limit=1 << 19):
                cls, first, n, at = _sequences(model, block)
                row = np.repeat(np.arange(n.size), n)
                h, _, words = _words(block)
                found = table.find(h)
                c = np.full(cls.size, n_docs)
                c[at] = np.where(found >= 0, table.values[0][found] if table.keys.size else 0, 0)
                here = np.ones(cls.size, bool)
                here[at] = (found >= 0) | whole
                grouped = (cls >= OWN) & (cls < CLASSES - 1)
                base = np.bincount(row, np.where(here, base_of(c), 0.0), n.size)
                inner = np.where(grouped & here, np.log10((c + 0.5) / room[cls]), 0.0)
                full = likelihood(model, cls, first, n) + np.bincount(row, inner, n.size)
                rest = ~here[at]
                lists = np.concatenate(([0], np.cumsum(np.bincount(words.doc[rest], minlength=n.size)))).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(h[rest].view(np.int64)), pa.array(cls[at][rest].astype(np.int32))], ["h", "c"])
                known = np.bincount(row, (c > 0) & here, n.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_column(block, "doc_id"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(full), pa.ListArray.from_arrays(pa.array(lists), tail)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "tail"])

    scored = docs.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_known long, base_score double, score double, tail array<struct<h: long, c: int>>")
    if not whole:
        scored = scratch.stage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        rest = scored.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.c").groupBy("row", "h", "c").agg(F.count("*").alias("m"))
        counted = rest.join(vocabulary.filter(F.col("n") < least).select("h", "n"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rooms = F.get(F.split(F.lit(",".join(map(repr, room.tolist()))), ",").cast("array<double>"), F.col("c"))
        base = F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
        sums = counted.groupBy("row").agg(F.sum(F.col("m") * base).alias("b"), F.sum(F.when(F.col("c") >= OWN, F.col("m") * F.log10((F.col("n") + 0.5) / rooms)).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("k"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        scored = scored.join(sums, "row", "left").withColumns({"n_known": F.col("n_known") + zero("k"), "base_score": F.col("base_score") + zero("b"), "score": F.col("score") + zero("s")})
    return scored.select("doc_id", (~in_training()).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
