"""Ranked lexical search by a tree of maxima over document ranges.

The scores are whole numbers: a term's weight follows from how many documents
hold it, its impact on a document from its occurrences and the document's length.

Every task lays its documents out in shards.  A shard keeps, for each term of the
queries, the largest impact in each range of documents: ranges of ``FAN``
documents, of ``FAN`` such ranges, and so on to the root.  The sum of an
item's maxima bounds all scores of a range.  The search opens the range of the
highest bound first and ends when no bound reaches the lowest score that would
still be taken; ranges whose bound equals that score are opened too, since they
may hold an equal score of a smaller ``doc_id``.  Documents of a shard are ordered by
their rarest query term, so that ranges hold like documents and bounds are close.

The items are read in blocks of at most ``block_bytes`` (an item is never split); each
block's terms are a broadcast of that bound, and all documents meet every block.
A task emits at most ``most`` rows an item, however many documents it holds.

Cases: a null or text without terms is in no result and not counted; an item
without terms has no rows; rows of one ``item_id`` are one item, a null one too; rows of
one ``doc_id`` are documents of their own; a null ``doc_id`` ranks after others of
equal score; a text of any length is read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .textkit import LOWER, MARKS, HashArray, Words, apart_hash, blocks, buffers, equal_spans, padded
from .workers import tidy

FAN = 16
SHARD_ROWS, SHARD_POSTINGS = 8192, 4 << 20
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(column: pa.Array) -> Words:
    data, off = buffers(column)
    return Words(LOWER[data], off, MARKS)


class Items:
    """A block of queries: ids, the terms of all, and each item's terms with how often it has them."""

    def __init__(self, ids: list, texts: list[list[str]]):
        self.ids, known, self.terms = ids, {}, []
        for parts in texts:
            counts = Counter()
            for part in parts:
                w = terms_of(pa.array([part], pa.large_string()))
                raw = w.data.tobytes()
                counts.update(raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))
            place = [known.setdefault(t, len(known)) for t in counts]
            self.terms.append((np.array(place, np.int64), np.fromiter(counts.values(), np.int64, len(counts))))
        self.n_terms = len(known)
        size = np.fromiter(map(len, known), np.int64, len(known))
        self.data, self.end = padded(np.frombuffer(b"".join(known), np.uint8)), np.cumsum(size)
        self.start = self.end - size
        self.place = HashArray(apart_hash(self.data[:-8], self.start, self.end), np.arange(len(known)))

    def find(self, words: Words) -> np.ndarray:
        """The term that each word is, or -1: hashes propose, bytes decide."""
        at = self.place.find(words.hashes())
        hit = np.flatnonzero(at >= 0)
        term = self.place.values[0][at[hit]]
        size = self.end[term] - self.start[term]
        same = size == words.end[hit] - words.start[hit]
        hit, term, size = hit[same], term[same], size[same]
        same = equal_spans(padded(words.data), words.start[hit], self.data, self.start[term], size)
        out = np.full(at.size, -1, np.int64)
        out[hit[same]] = term[same]
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").orderBy("item_id")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if ids and ids[-1] == r.item_id:
            texts[-1].append(r.text)
        else:
            if size >= block_bytes:
                yield Items(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(r.item_id)
            texts.append([r.text])
        size += len(r.text) + 64
    if ids:
        yield Items(ids, texts)


def postings(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: their number of terms and those of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for block in blocks(batch):
                words = terms_of(block.column(1))
                term = items.find(words)
                hit = term >= 0
                key, tf = np.unique(words.doc[hit] * items.n_terms + term[hit], return_counts=True)
                first = np.searchsorted(key, np.arange(block.num_rows + 1) * items.n_terms).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (key % max(items.n_terms, 1), tf)]
                rows = pa.RecordBatch.from_arrays([block.column(0), pa.array(words.count.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(words.count > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), POSTINGS)


class Tree:
    """The maxima of a shard: ``levels[0]`` over ranges of ``FAN`` documents, the last over the whole shard."""

    def __init__(self, n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_all: int):
        size = np.diff(first)
        doc = np.repeat(np.arange(n.size), size)
        rarest = np.full(n.size, -1, np.int64)
        by_weight = np.lexsort((weight[term], doc))
        full = size > 0
        rarest[full] = term[by_weight][first[1:][full] - 1]
        self.order = np.argsort(rarest, kind="stable")
        rank = np.empty(n.size, np.int64)
        rank[self.order] = np.arange(n.size)
        order = np.argsort(rank[doc], kind="stable")
        self.doc, term, tf = rank[doc][order], term[order], tf[order]
        self.first = np.searchsorted(self.doc, np.arange(n.size + 1))
        length = 100 - 25 + (25 * n * n_docs) // n_all
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * length[self.order][self.doc])
        known, self.term = np.unique(term, return_inverse=True)
        self.impact = impact
        self.local = np.full(weight.size, -1, np.int64)
        self.local[known] = np.arange(known.size)
        ranges = -(-n.size // FAN)
        key = self.term * ranges + self.doc // FAN
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else key
        least = np.zeros(known.size * ranges, np.int32)
        if key.size:
            least[key[head]] = np.maximum.reduceat(impact[by_key], head)
        self.levels = [least.reshape(known.size, ranges)]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            wide = -(-below.shape[1] // FAN)
            room = np.zeros((known.size, wide * FAN), np.int32)
            room[:, : below.shape[1]] = below
            self.levels.append(room.reshape(known.size, wide, FAN).max(2))

    def search(self, term: np.ndarray, factor: np.ndarray, ids: list, best: list, most: int) -> int:
        """Add the shard's documents to ``best``, a heap of the ``most`` highest (score, known id, -id); returns how many ranges were opened."""
        row = self.local[term]
        there = row >= 0
        row, factor = row[there], factor[there]
        if not row.size:
            return 0
        dense = np.zeros(self.levels[0].shape[0], np.int64)
        dense[row] = factor
        top = len(self.levels) - 1
        heap = [(-int((factor * self.levels[top][row, 0]).sum()), top, 0)]
        opened = 0
        while heap:
            bound, level, node = heapq.heappop(heap)
            if bound == 0 or (len(best) == most and -bound < best[0][0]):
                break
            opened += 1
            low = node * FAN
            if level:
                below = self.levels[level - 1]
                sums = (factor[:, None] * below[row, low : low + FAN]).sum(0)
                least = best[0][0] if len(best) == most else 1
                for i in np.flatnonzero(sums >= least).tolist():
                    heapq.heappush(heap, (-int(sums[i]), level - 1, low + i))
                continue
            a, b = self.first[low], self.first[min(low + FAN, self.order.size)]
            scores = np.zeros(FAN, np.int64)
            np.add.at(scores, self.doc[a:b] - low, dense[self.term[a:b]] * self.impact[a:b])
            for i in np.flatnonzero(scores > 0).tolist():
                name = ids[self.order[low + i]]
                entry = (int(scores[i]), name is not None, -(name or 0))
                if len(best) < most:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return opened


def _ranked(rows: DataFrame, shared, weights, n_docs: int, n_all: int, most: int) -> DataFrame:
    """(item, doc_id, score): the highest scores of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value, weights.value
        best: list[list] = [[] for _ in items.ids]

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
            first = terms.offsets.to_numpy().astype(np.int64)
            tree = Tree(table.column("n").to_numpy(), first - first[0], terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), weight, n_docs, n_all)
            ids = table.column("doc_id").to_pylist()
            for i, (term, times) in enumerate(items.terms):
                tree.search(term, times * weight[term], ids, best[i], most)

        held: list[pa.RecordBatch] = []
        rows = entries = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SHARD_ROWS - rows)
                held.append(part)
                at, rows = at + part.num_rows, rows + part.num_rows
                entries += len(part.column(2).flatten())
                if rows >= SHARD_ROWS or entries >= SHARD_POSTINGS:
                    search(held)
                    held, rows, entries = [], 0, 0
        if held:
            search(held)
        flat = [(i, -e[2] if e[1] else None, e[0]) for i, heap in enumerate(best) for e in heap]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return rows.mapInArrow(tidy(run), "item int, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, most: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``most`` documents of the highest scores above 0."""
    spark, out = docs.sparkSession, None
    for items in item_blocks(benchmark, block_bytes):
        shared = scratch.share(spark, items)
        rows = scratch.stage(postings(docs, shared), "postings")
        n_docs, n_all = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = np.zeros(items.n_terms, np.int64)
        for term, df in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # at most the block's terms
            holders[term] = df
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)
        found = _ranked(rows, shared, scratch.share(spark, weight), n_docs, n_all, most)
        names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
        found = scratch.stage(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
