"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of lower-cased words, without ASCII
marks.  Seeds (windows of ``least`` words) that a document shares with an item propose the pair; tiles
are then marked longest first, found by Karp-Rabin hashes of the windows of
unmarked words, and never overlap.  A document is contaminated if the tiles
cover ``coverage`` of an item's words, in whatever order they stand.

The items are read in blocks of at most ``block_bytes``; each block is a
broadcast of that bound, and every document meets every block.  With several
blocks the texts are read once for each, and only rows of the documents that
share something with an item are written.

Cases: a null or empty text covers nothing; a null ``doc_id`` is judged like any
other; items of fewer than ``least`` words match nothing; of items covered alike
the one with the smallest id is named; repeated rows are judged each; a text of
any length is tiled whole; an empty table gives an empty result; an empty
benchmark flags nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import MARKS, HashArray, Words, blocks, buffers, mix, powers, shingles
from .workers import tidy

_U = np.uint64


def _words(column: pa.Array) -> tuple[np.ndarray, Words]:
    data, off = buffers(pc.utf8_lower(column))
    words = Words(data, off, MARKS)
    return words.hashes(), words


class _Rolling:
    """Hashes of the windows of any length of a word sequence."""

    def __init__(self, word: np.ndarray):
        self.word, self.sums = word, np.zeros(word.size + 1, _U)
        np.cumsum(word * powers(word.size)[0], out=self.sums[1:])

    def windows(self, length: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of the windows without a marked word."""
        n = self.word.size - length + 1
        if n <= 0:
            return self.sums[:0], np.zeros(0, np.int64)
        taken = np.concatenate(([0], np.cumsum(~free)))
        start = np.flatnonzero(taken[length:] == taken[:n])
        return mix((self.sums[start + length] - self.sums[start]) * powers(self.word.size + 1)[1][start]), start


def _shared(item: _Rolling, text: _Rolling, item_free: np.ndarray, text_free: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hashes and starts of the item's free windows that the text has free, and those of all free windows of the text."""
    hashes, at = item.windows(length, item_free)
    theirs, there = text.windows(length, text_free)
    known = np.isin(hashes, theirs)
    return hashes[known], at[known], theirs, there


def tiles(item: np.ndarray, text: np.ndarray, least: int, longest: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``text`` with ``item``: (start in item, start in text, length), longest first,
    of equal ones the first in the item and then in the text.

    A common window holds shorter ones, so the longest length is found by halving.
    """
    item_roll, text_roll = _Rolling(item), _Rolling(text)
    item_free, text_free = np.ones(item.size, bool), np.ones(text.size, bool)
    found = []
    most = min(item.size, text.size, longest or item.size)
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if _shared(item_roll, text_roll, item_free, text_free, middle)[0].size else (low, middle - 1)
        if low < least:
            break
        hashes, at, theirs, there = _shared(item_roll, text_roll, item_free, text_free, low)
        for h, i in zip(hashes, at, strict=True):
            if not item_free[i : i + low].all():
                continue
            for t in there[theirs == h]:
                if text_free[t : t + low].all() and np.array_equal(item[i : i + low], text[t : t + low]):
                    item_free[i : i + low], text_free[t : t + low] = False, False
                    found.append((int(i), int(t), low))
                    break
        most = low - 1
    return found


class Items:
    """A block of test items, indexed by their seeds."""

    def __init__(self, ids: list, texts: list[str], least: int):
        word, words = _words(pa.array(texts, pa.large_string()))
        self.ids, self.least = ids, least
        self.items = [word[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        seed, at = shingles(word, words.doc, least)
        owner = words.doc[at]
        order = np.lexsort((owner, seed))
        seed, owner = seed[order], owner[order]
        keys, first = np.unique(seed, return_index=True)
        self.owner, self.seeds = owner, HashArray(keys, first, np.append(first[1:], seed.size))

    def best(self, word: np.ndarray, words: Words, n_rows: int) -> tuple[np.ndarray, list, np.ndarray]:
        """Highest coverage of an item by each row, that item, and its tiles."""
        coverage, item, n_tiles = np.zeros(n_rows), [None] * n_rows, np.zeros(n_rows, np.int64)
        seed, at = shingles(word, words.doc, self.least)
        found = self.seeds.find(seed)
        hit = np.flatnonzero(found >= 0)
        at, found, row = at[hit], found[hit], words.doc[at[hit]]
        for r, a, b in zip(*_runs(row), strict=True):
            low, high = self.seeds.values[0][found[a:b]], self.seeds.values[1][found[a:b]]
            span = high - low
            which = self.owner[np.repeat(low - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())]
            where = np.repeat(at[a:b], span)
            for i in np.unique(which):
                mine = np.unique(where[which == i])  # a seed that the item repeats is there once for each
                text = word[mine[0] : mine[-1] + self.least]
                step = np.flatnonzero(np.diff(np.concatenate(([-9], mine, [1 << 60]))) != 1)
                longest = int(np.diff(step).max()) + self.least - 1
                if self.items[i].size * coverage[r] >= min(self.items[i].size, mine.size * self.least):
                    continue
                marked = tiles(self.items[i], text, self.least, longest)
                share = sum(t[2] for t in marked) / self.items[i].size
                if share > coverage[r]:
                    coverage[r], item[r], n_tiles[r] = share, self.ids[i], len(marked)
        return coverage, item, n_tiles


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not row.size:
        return row, row, row
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return row[start], start, np.append(start[1:], row.size)


def item_blocks(benchmark: DataFrame, least: int, block_bytes: int) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text) + 64
        if size >= block_bytes:
            yield Items(ids, texts, least)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, least)


COVER = "item_id long, coverage double, n_tiles long"


def _covered(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, text) with the item that each covers most."""
    shared = scratch.share(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for block in blocks(batch):
                word, words = _words(block.column(1))
                coverage, item, n = held.best(word, words, block.num_rows)
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(item, pa.int64()), pa.array(coverage), pa.array(n)], ["doc_id", "text", "item_id", "coverage", "n_tiles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id long, text string, {COVER}")


def _keyed(rows: DataFrame, *rest: str) -> DataFrame:
    """(k_id, k_text, ...): rows of one id and text are judged alike."""
    return rows.select(F.col("doc_id").alias("k_id"), F.md5("text").alias("k_text"), *rest)


def _many(docs: DataFrame, first: list[Items], rest: Iterator[Items]) -> DataFrame:
    """(k_id, k_text, item_id, coverage, n_tiles) of the documents that share something with an item of any block."""
    parts = None
    for items in chain(first, rest):
        part = scratch.stage(_keyed(_covered(docs, items).filter("coverage > 0"), "item_id", "coverage", "n_tiles").distinct(), "covered")
        parts = part if parts is None else parts.unionByName(part)
    best = F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", -F.col("item_id")))
    return parts.groupBy("k_id", "k_text").agg(best.alias("b")).select("k_id", "k_text", "b.*")


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, contaminated) of each document: the item it covers most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    read = item_blocks(benchmark, least, block_bytes)
    first = list(islice(read, 2))
    if len(first) == 1:
        out = _covered(rows, first[0])
    elif first:
        same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("m") == F.col("k_text"))
        out = rows.select("doc_id", F.md5("text").alias("m")).join(_many(rows, first, read), same, "left")
    else:
        out = rows.selectExpr("doc_id", "cast(null as long) item_id", "0.0D coverage", "0L n_tiles")
    out = out.select("doc_id", "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"))
    return out.withColumn("contaminated", F.col("coverage") >= threshold)


def _clean(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = scratch.share(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for block in blocks(batch):
                word, words = _words(block.column(block.schema.get_field_index("text")))
                yield block.filter(pa.array(held.best(word, words, block.num_rows)[0] < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    read = item_blocks(benchmark, least, block_bytes)
    first = list(islice(read, 2))
    if not first:
        return docs
    if len(first) == 1:
        return _clean(docs, first[0], threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bad = scratch.stage(_many(rows, first, read).filter(F.col("coverage") >= threshold).select("k_id", "k_text"), "contaminated")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k_id")) & (F.md5(F.coalesce("d.text", F.lit(""))) == F.col("k_text"))
    return docs.alias("d").join(bad, same, "left_anti")
