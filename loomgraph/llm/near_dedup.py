"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so a signature costs half the hash evaluations of MinHash.
Bands of the signature propose pairs; every link is confirmed on full sets.

Work inside a bucket stays linear: documents with equal sets are one class
(joined by an aggregate), and the classes of a bucket are compared with the
class of most shared shingles.  Classes that this leaves in different components
are then compared where their shared shingles still allow a link.

Cases: a null or empty text has no shingles and is linked with nothing; a null
``doc_id`` has no component and is kept; rows of one ``doc_id`` are one document:
it is linked by the text of each of them, and they share a component, whatever
their texts; a similarity of just ``percent`` is a link; a text of any length is
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .textkit import LOWER, Words, blocks, buffers, mix, shingles
from .workers import tidy

_U = np.uint64
CROWD, BLOCK = 64, 512  # members from which a component is compared in blocks, and their rows
KEY = ["n_shingles", "set_a", "set_b"]
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return mix(base[:n]) | _U(1), mix(base[n:])


def shingle_sets(block: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the rows of a block, row after row in rising order, and the offsets of the rows."""
    data, off = buffers(block.column(block.schema.get_field_index("text")))
    words = Words(LOWER[data], off)
    word = words.hashes()
    value, at = shingles(word, words.doc, k)
    row = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if short.size:  # the whole sequence is the one shingle
        folded = np.zeros(short.size, _U)
        for i in range(k - 1):
            there = words.count[short] > i
            folded[there] = mix(folded[there] + word[words.first[short[there]] + i] * _U(0xC2B2AE3D27D4EB4F))
        value, row = np.concatenate((value, folded)), np.concatenate((row, short))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(block.num_rows + 1))


def sketch(docs: DataFrame, k: int, bands: int, rows: int, members: bool = False) -> DataFrame:
    """Set size, hashes of the set and band hashes of each document; with ``members`` its shingles in place of the bands."""
    n_perm = bands * rows // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _seeds(n_perm)
        for batch in batches:
            for block in blocks(batch, limit=1 << 18):
                value, first = shingle_sets(block, k)
                size = np.diff(first)
                full = np.flatnonzero(size)
                head = first[:-1][full]
                signature = np.empty((2 * n_perm, full.size), _U)
                sums = np.zeros((2, block.num_rows), _U)
                if full.size:
                    for j in range(n_perm):
                        moved = (value ^ shift[j]) * factor[j]
                        signature[2 * j] = np.minimum.reduceat(moved, head)
                        signature[2 * j + 1] = np.maximum.reduceat(moved, head)
                    for i in range(2):
                        sums[i, full] = np.add.reduceat(mix(value * _U(2 * i + 1) + _U(i)), head)
                band = np.zeros((full.size, bands), _U)
                for b in range(bands):
                    folded = np.full(full.size, b + 1, _U)
                    for x in signature[b * rows : (b + 1) * rows]:
                        folded = mix(folded * _U(0x9FB21C651E98DF25) + x)
                    band[:, b] = folded
                lists = np.zeros(block.num_rows + 1, np.int32)
                lists[1:] = np.cumsum(size if members else np.where(size > 0, bands, 0))
                listed = value if members else band.ravel()
                yield pa.RecordBatch.from_arrays(
                    [block.column(block.schema.get_field_index("doc_id")), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pa.array(listed.view(np.int64)))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SKETCH)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, members): the distinct shingle hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                value, first = shingle_sets(block, k)
                yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))], ["doc_id", "members"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, members array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union, on full sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("members").alias("a")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("members").alias("b")), "v")
    shared = both.select("u", "v", (F.size("a") + F.size("b")).cast("long").alias("n"), F.size(F.array_intersect("a", "b")).cast("long").alias("i"))
    return shared.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("u", "v")


def _alone(sets: DataFrame) -> DataFrame:
    """(v, alone): how many shingles of a document occur in no other document of ``sets``."""
    each = sets.select("doc_id", F.explode("members").alias("h"))
    once = each.groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("v")).filter("c = 1")
    return once.groupBy("v").agg(F.count("*").alias("alone"))


def _joined(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    placed = buckets.join(labels.withColumnsRenamed({"node": "v", "component": "comp"}), "v", "left")
    return placed.withColumn("comp", F.coalesce("comp", "v"))


def _prefix(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each document: two sets that reach the similarity share one of the
    first n - ceil(p * n / 100) + 1 of the larger and the first m - ceil(2 * p * m / (100 + p)) + 1
    (``short``) of the smaller."""
    each = scratch.stage(sets.withColumnRenamed("doc_id", "v").join(left, "v").select("v", "n", "s", "comp", "crowd", F.explode("members").alias("h")), "each")
    counted = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")
    ceil = lambda a, b: F.expr(f"({a} * n + {b} - 1) div {b}")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("df", "h"))
    ranked = counted.withColumn("rank", rank).filter((F.col("rank") <= F.col("n") - ceil(percent, 100) + 1) & (F.col("df") > 1))
    return scratch.stage(ranked.withColumn("short", F.col("rank") <= F.col("n") - ceil(2 * percent, 100 + percent) + 1).drop("df", "rank"), "prefix")


def _few(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of two small components that share a shingle of their prefixes."""
    mine = prefix.filter(F.col("crowd") <= CROWD)
    small = mine.filter("short").select("h", F.col("v").alias("u"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("comp").alias("other"))
    most = F.least("s", "t")
    possible = (100 * most >= percent * (F.col("n") + F.col("m") - most)) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("u") < F.col("v"))))
    return mine.join(small, "h").filter((F.col("other") != F.col("comp")) & possible).select("u", "v").distinct()


def _crowded(prefix: DataFrame, left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between a document and a large component, compared block by block.

    A document meets a component if it shares a prefix shingle with any of its
    members; the component's members then meet it in blocks of ``BLOCK`` by
    ``BLOCK`` rows, so that no pair is made that is not a link.
    """
    held = prefix.filter(F.col("crowd") > CROWD).select("h", F.col("comp").alias("other")).distinct()
    asks = prefix.join(held, "h").filter("comp <> other").select("v", "other").distinct()
    asks = scratch.stage(asks.withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(1 << 30))), "asks")
    sizes = left.filter(F.col("crowd") > CROWD).select(F.col("comp").alias("other"), F.ceil(F.col("crowd") / BLOCK).alias("rows")).distinct()
    sizes = sizes.join(asks.groupBy("other").agg(F.ceil(F.count("*") / BLOCK).alias("cols")), "other")
    full = sets.withColumnRenamed("doc_id", "v")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    queries = asks.join(sizes, "other").select("other", "v", (F.col("piece") % F.col("cols")).cast("int").alias("j"), spread("rows").alias("i"), F.lit(True).alias("asks"))
    members = left.filter(F.col("crowd") > CROWD).select(F.col("comp").alias("other"), "v").join(sizes, "other")
    members = members.select("other", "v", spread("cols").alias("j"), (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) % F.col("rows")).cast("int").alias("i"), F.lit(False).alias("asks"))
    rows = queries.unionByName(members).join(full, "v")

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("asks").to_numpy()
        ids = table.column("v").to_numpy()
        lists = table.column("members").combine_chunks()
        off, value = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        off = off - off[0]
        size = np.diff(off)
        _, code = np.unique(value, return_inverse=True)
        row = np.repeat(np.arange(ids.size), size)
        both = np.zeros(code.max(initial=0) + 1, np.int8)
        both[code[side[row]]] |= 1
        both[code[~side[row]]] |= 2
        shared = np.flatnonzero(both == 3)
        found = [[np.zeros(0, np.int64)] * 2]
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        if shared.size and a.size and b.size:
            place = np.full(both.size, -1)
            place[shared] = np.arange(shared.size)
            common = np.zeros((a.size, b.size), np.float32)
            local = np.zeros(ids.size, np.int64)
            local[a], local[b] = np.arange(a.size), np.arange(b.size)
            where = place[code]
            for at in range(0, shared.size, 4096):  # shingles in slices: bounded memory
                use = (where >= at) & (where < at + 4096)
                left_m, right_m = np.zeros((a.size, 4096), np.float32), np.zeros((b.size, 4096), np.float32)
                l, r = use & side[row], use & ~side[row]
                left_m[local[row[l]], where[l] - at] = 1
                right_m[local[row[r]], where[r] - at] = 1
                common += left_m @ right_m.T
            union = size[a][:, None] + size[b][None, :] - common
            x, y = np.nonzero(100 * common.astype(np.int64) >= percent * union.astype(np.int64))
            found.append([ids[a[x]], ids[b[y]]])
        u, v = (np.concatenate(c) for c in zip(*found, strict=True))
        if u.size:  # one link of a query into this component is enough
            u, first = np.unique(u, return_index=True)
            v = v[first]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("other", "i", "j").applyInArrow(meet, "u long, v long")


def _classes(named: DataFrame, clash: bool) -> DataFrame:
    """(n_shingles, set_a, set_b, rep, node): each distinct set with its smallest document.

    The document is the class's node in the graph of links, or, where it has several
    sets, for all but the first a hash of document and set.
    """
    least = named.filter("n_shingles > 0").groupBy(*KEY).agg(F.min("doc_id").alias("rep"))
    if not clash:
        return scratch.stage(least.withColumn("node", F.col("rep")), "classes")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(*KEY))
    return scratch.stage(least.withColumn("node", F.when(rank == 1, F.col("rep")).otherwise(F.xxhash64("rep", "set_a", "set_b"))), "classes")


def _sets_of_nodes(docs: DataFrame, asked: DataFrame, k: int, clash: bool) -> DataFrame:
    """(doc_id, members): the sets of the classes ``asked``, under their nodes."""
    texts = docs.join(asked.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if not clash:
        return sets_of(texts.dropDuplicates(["doc_id"]), k)
    keyed = sketch(texts, k, 0, 0, True).join(asked.withColumnRenamed("rep", "doc_id"), ["doc_id", *KEY])
    return keyed.dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), F.col("bands").alias("members"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    ``bands`` bands of ``rows`` values miss a pair of similarity 0.8 with a chance
    of (1 - 0.8**rows)**bands, 5e-7 by default.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scratch.small_batches(docs.sparkSession)
    drawn = scratch.stage(sketch(docs, k, bands, rows), "sketch")
    named = drawn.filter("doc_id is not null")
    differs = lambda c: F.min(c) < F.max(c)
    several = named.groupBy("doc_id").agg((differs("set_a") | differs("set_b")).alias("d")).filter("d").select("doc_id")
    several = scratch.stage(several, "several")
    clash = not several.isEmpty()
    classes = _classes(named, clash)
    member = named.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *KEY])
    exploded = member.select(F.col("node").alias("v"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")).distinct()
    several_in = exploded.groupBy("bucket").agg(F.min("v").alias("x"), F.max("v").alias("y")).filter("x < y").select("bucket")
    shared = scratch.stage(exploded.join(several_in, "bucket"), "shared")
    asked = classes.join(shared.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
    sets = scratch.stage(_sets_of_nodes(docs, asked, k, clash), "sets")

    # A shingle that no other candidate has is in no intersection: with s = n - alone, the
    # intersection of two sets is at most the smaller s.  Pairs that this excludes are not made.
    buckets = scratch.stage(shared.join(_alone(sets), "v", "left").select("bucket", "v", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")), "buckets")
    most = F.least("s", "t")
    possible = 100 * most >= percent * (F.col("n") + F.col("m") - most)
    hubs = buckets.groupBy("bucket").agg(F.max_by(F.struct("v", "n", "s"), F.struct(F.col("s") / F.col("n"), -F.col("v"))).alias("hub"))
    starred = buckets.join(hubs.select("bucket", F.col("hub.v").alias("u"), F.col("hub.n").alias("m"), F.col("hub.s").alias("t")), "bucket").filter(possible & (F.col("u") != F.col("v")))
    links = scratch.stage(confirm(starred.select("u", "v").distinct(), sets, percent), "links")

    # What the hubs left apart: members of one bucket in different components.
    placed = _joined(buckets, components(links)).filter(100 * F.col("s") >= percent * F.col("n"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("bucket")
    left = placed.join(mixed, "bucket", "left_semi").select("v", "n", "s", "comp").distinct()
    left = scratch.stage(left.join(left.groupBy("comp").agg(F.count("*").alias("crowd")), "comp"), "left")
    prefix = _prefix(left, sets, percent)
    more = confirm(scratch.stage(_few(prefix, percent), "few"), sets, percent).union(_crowded(prefix, left, sets, percent))
    every = links.union(more)
    if clash:  # the texts of one id are one document
        mine = named.join(several, "doc_id", "left_semi").join(classes.drop("rep"), KEY).select("doc_id", F.col("node").alias("u")).distinct()
        every = every.union(mine.join(mine.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").select("u", "v"))
    linked = components(scratch.stage(every, "all_links"))

    placed_class = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if clash:  # named by a document again
        placed_class = placed_class.join(placed_class.groupBy("component").agg(F.min("rep").alias("least")), "component").withColumn("component", F.col("least"))
    out = drawn.select("doc_id", *KEY).join(placed_class.select(*KEY, F.col("component").alias("component_id")), KEY, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    if clash:
        own = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        out = out.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
