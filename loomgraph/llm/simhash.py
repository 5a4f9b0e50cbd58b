"""SimHash fingerprints and their links by pivot distance tables.

A fingerprint's bit is set if more than half of the 64-bit hashes of the
document's shingles have it.  Fingerprints that differ in at most ``most`` bits
are linked.

Pairs are proposed by equal bits: with ``most + r`` blocks of bits, two linked
fingerprints agree on some ``r`` of them.  ``r`` grows with the number of
fingerprints, so that a bucket of unlike ones stays small.  In a bucket a table
holds each fingerprint's Hamming distances to the reference fingerprints (the
pivots).  By the triangle inequality linked fingerprints differ by at most
``most`` in every column: the bucket is swept in the order of the first column,
pairs that any other column sets apart are discarded, and the survivors are
verified.  Pivots alone cannot propose the pairs: distances of unlike
fingerprints to any pivot lie within a few bits of 32, so one column keeps over a
half of all pairs.

Work in a hot bucket: equal fingerprints are one class; members linked with the
bucket's smallest one are settled by a join with it; only buckets that still hold
several components are swept, in pieces of ``PIECE`` by ``PIECE`` rows, and
report one link for each two components.

Cases: a null or empty text has the fingerprint zero, linked like any other;
fewer words than a shingle are one shingle; a null ``doc_id`` gets a fingerprint
and no component, and links nothing; rows of one ``doc_id`` are one document,
linked by the text of each; a text of any length is read whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .textkit import LOWER, Words, blocks, buffers, mix
from .workers import tidy

_U = np.uint64
PIECE = 1024
#: Reference fingerprints: fixed, spread over all bits.
PIVOTS = mix(np.arange(1, 17, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SIGNED = [int(p) for p in PIVOTS.view(np.int64)]


def fingerprint(words: list[bytes], k: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    """Fingerprint of a sequence of words; shingles are hashed ``step`` at a time."""
    if not words:
        return 0
    text = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    last = end[min(k, len(words)) - 1 :]
    start = start[: last.size]
    counts = np.zeros(64, np.int64)
    for at in range(0, last.size, step):
        spans = zip(start[at : at + step].tolist(), last[at : at + step].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(text[a:b], seed) for a, b in spans), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > last.size))


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, f): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                data, off = buffers(block.column(1))
                data = LOWER[data]
                found, raw = Words(data, off), data.tobytes()
                spans = list(zip(found.start.tolist(), found.end.tolist(), strict=True))
                out = np.zeros(block.num_rows, _U)
                for i in range(block.num_rows):
                    out[i] = fingerprint([raw[a:b] for a, b in spans[found.first[i] : found.first[i + 1]]], k, seed)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(out.view(np.int64))], ["doc_id", "f"])

    scratch.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "doc_id long, f long")


def block_masks(n: int, most: int = 4, members: int = 8) -> list[int]:
    """Masks of the bits that a bucket has in common: ``r`` of ``most + r`` blocks, the least ``r`` at which
    ``n`` evenly spread fingerprints fill a bucket with at most ``members``."""
    r = 1
    while r < 4 and n > members << (64 * r // (most + r)):
        r += 1
    edges = [64 * i // (most + r) for i in range(most + r + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distances(f: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(f[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def swept(f: np.ndarray, group: np.ndarray, apart: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal ``group`` and different ``apart`` whose fingerprints differ in at most ``most`` bits."""
    table = distances(f)
    order = np.lexsort((table[:, 0], group))
    table, f, group, apart = table[order], f[order], group[order], apart[order]
    found = [[np.zeros(0, np.int64)] * 2]
    row, step = np.arange(f.size), 1
    while row.size:
        row = row[row + step < f.size]
        far = row + step
        row = row[(group[far] == group[row]) & (table[far, 0] - table[row, 0] <= most)]
        pair = row[apart[row] != apart[row + step]]
        for p in range(1, PIVOTS.size):
            pair = pair[np.abs(table[pair, p] - table[pair + step, p]) <= most]
        pair = pair[np.bitwise_count(f[pair] ^ f[pair + step]) <= most]
        if pair.size:
            found.append([order[pair], order[pair + step]])
        step += 1
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def _near(a: Column, b: Column, most: int) -> Column:
    """Both pass the pivot table, and then differ in at most ``most`` bits."""
    apart = [F.abs(F.bit_count(a.bitwiseXOR(F.lit(p))) - F.bit_count(b.bitwiseXOR(F.lit(p)))) for p in _SIGNED[:4]]
    return (F.greatest(*apart) <= most) & (F.bit_count(a.bitwiseXOR(b)) <= most)


def _swept(mixed: DataFrame, crowd: DataFrame, most: int) -> DataFrame:
    """Links (u, v) between components that share a bucket: one for each two components of a piece."""
    sized = mixed.join(crowd.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")), ["t", "bits"])
    mine = F.pmod(F.xxhash64("f", F.lit(3)), F.col("pieces")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    placed = sized.withColumn("mine", mine).withColumn("other", every)
    placed = placed.select("t", "bits", "f", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            col = {c: rows.column(c).to_numpy() for c in rows.column_names}
            _, group = np.unique(np.stack([col[c].astype(np.int64) for c in ("t", "bits", "i", "j")]), axis=1, return_inverse=True)
            a, b = swept(col["f"].view(_U), group.ravel(), col["comp"], most)
            sides = np.sort(np.stack([col["comp"][a], col["comp"][b]]), axis=0)
            u, v = np.unique(sides, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        def last_group(rows: pa.Table) -> int:
            """First row of the group that the rows end with."""
            keys = [rows.column(c).to_numpy() for c in ("t", "bits", "i", "j")]
            differ = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            return int(differ[-1]) + 1 if differ.size else 0

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= 4 * PIECE:
                rows = pa.Table.from_batches(held).combine_chunks()
                cut = last_group(rows)
                held = rows.slice(cut).to_batches()
                if cut:
                    yield out(rows.slice(0, cut).combine_chunks())
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    keys = ["t", "bits", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "u long, v long")


def linked(classes: DataFrame, most: int = 4) -> DataFrame:
    """Links (u, v) that connect the fingerprints (f) of ``classes`` as all pairs of at most ``most`` bits would."""
    masks = block_masks(classes.count(), most)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))
    each = classes.select("f", keys.alias("k")).select("k.t", "k.bits", "f")
    crowd = each.groupBy("t", "bits").agg(F.count("*").alias("n"), F.min("f").alias("hub")).filter("n > 1")
    buckets = scratch.stage(each.join(crowd, ["t", "bits"]), "buckets")
    stars = buckets.filter((F.col("f") != F.col("hub")) & _near(F.col("f"), F.col("hub"), most)).select(F.col("f").alias("u"), F.col("hub").alias("v"))
    stars = scratch.stage(stars.distinct(), "stars_of_buckets")
    found = components(stars).withColumnsRenamed({"node": "f", "component": "comp"})
    placed = buckets.join(found, "f", "left").select("t", "bits", "f", F.coalesce("comp", "f").alias("comp"))
    mixed = placed.groupBy("t", "bits").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x < y").select("t", "bits", "n")
    return stars.union(scratch.stage(_swept(placed, mixed, most), "swept"))


def near_fingerprints(docs: DataFrame, k: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; a component is named by its smallest ``doc_id``."""
    drawn = scratch.stage(fingerprints(docs, k, seed), "fingerprints")
    named = drawn.filter("doc_id is not null")
    classes = scratch.stage(named.groupBy("f").agg(F.min("doc_id").alias("rep")), "classes")
    several = named.groupBy("doc_id").agg(F.min("f").alias("u"), F.max("f").alias("v")).filter("u < v").select("doc_id", "u")
    same = named.join(several, "doc_id").filter("f <> u").select("u", F.col("f").alias("v")).distinct()
    joined = components(scratch.stage(linked(classes, most).union(same), "links"))
    placed = classes.join(joined.withColumnsRenamed({"node": "f", "component": "comp"}), "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = placed.join(least, "comp").select("f", "component_id")
    out = drawn.join(final, "f", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
