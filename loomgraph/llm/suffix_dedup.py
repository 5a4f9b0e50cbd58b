"""Removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a ``WIDTH``-byte string that also starts in a document
with a smaller ``doc_id``.  Suffix arrays of everything would have to be searched
shard against shard, so strings are first brought together by content:

1.  Each string has an anchor, the smallest hash among its ``GRAM``-byte grams.
    Neighbouring strings with one anchor are a run; equal strings have equal
    anchors, so only runs of one anchor are ever compared.
2.  An aggregate by anchor and run content finds runs that an earlier document
    repeats whole.  They need no more work.
3.  Where an anchor has several different runs, one document for each sends its
    bytes, and all places where it has them, to the anchor's shard.  Shards of
    bounded size get a suffix array by Larsson-Sadakane refinement, common
    prefixes of neighbours by Kasai's rule, and so groups of suffixes that agree
    on ``WIDTH`` bytes.
    An anchor that spans shards meets the strings of its earlier shards by
    binary search.
4.  Spans from 2 and 3 are united for each document.

Cases: a null or empty text has no bytes and stays empty; a null ``doc_id`` is
never smaller and loses nothing; rows of one ``doc_id`` do not count as repeats
of each other and lose the same strings; the smallest ``doc_id`` that has a
string keeps it, so there are no ties; a text of any length is one row of a
block of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .textkit import blocks, buffers, mix, powers, prefix_hash, span_hash
from .workers import tidy

WIDTH, GRAM = 50, 16
REACH = WIDTH - GRAM + 1
SHARD_BYTES = 1 << 19
_U = np.uint64


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, content hash, first start, last start) of the runs of a block of rows.

    The content hash is over the mixed hashes of the run's grams, with the place
    of the anchor among them, so runs compare by anchor and content: 128 bits.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, _U, np.int64, np.int64, np.int64))
    n = data.size
    if n < WIDTH:
        return none
    prefix = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    value, where, span = gram, at.astype(np.int32), 1
    while span < REACH:  # leftmost minimum of REACH grams
        step = min(span, REACH - span)
        left = value[:-step] <= value[step:]
        value, where = np.where(left, value[:-step], value[step:]), np.where(left, where[:-step], where[step:])
        span += step
    size = np.diff(off)
    row = np.repeat(np.arange(size.size), size)[: where.size]
    start = np.flatnonzero(off[1:][row] - np.arange(where.size) >= WIDTH)
    if not start.size:
        return none
    anchor = where[start]
    new = np.ones(start.size, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    low = start[new]
    high = np.append(start[np.flatnonzero(new)[1:] - 1], start[-1])
    pin = anchor[new].astype(np.int64)
    sums = np.zeros(gram.size + 1, _U)
    np.cumsum(gram * powers(gram.size)[0], out=sums[1:])
    content = mix(span_hash(sums, low, high + REACH) + (pin - low).astype(_U))
    return row[low], gram[pin], content.view(np.int64), low, high


def _rows(docs: DataFrame) -> DataFrame:
    """(h, g, doc_id): the runs of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, limit=1 << 19):
                row, h, g, _, _ = runs(*buffers(block.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g), block.column(0).take(pa.array(row))], ["h", "g", "doc_id"])

    return docs.mapInArrow(tidy(run), "h long, g long, doc_id long")


def _tagged(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of values that differ from row to row."""
    return mix(values.astype(np.int64).view(_U) + mix(row.astype(_U)))


def _asked(block: pa.RecordBatch, name: str) -> np.ndarray:
    """Tagged values of a list column."""
    column = block.column(block.schema.get_field_index(name))
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return _tagged(column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(size.size), size))


def _located(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, sent) of (doc_id, text, full, send): spans of whole repeated runs, and the runs to compare."""
    schema = "doc_id long, spans array<int>, sent array<struct<h: long, lows: array<int>, bytes: binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, limit=1 << 19):
                data, off = buffers(block.column(block.schema.get_field_index("text")))
                row, h, g, low, high = runs(data, off)
                tag = _tagged(h.view(np.int64) ^ g, row)
                raw = data.tobytes()
                spans: list[list[int]] = [[] for _ in range(block.num_rows)]
                sent: list[list[dict]] = [[] for _ in range(block.num_rows)]
                whole = np.flatnonzero(np.isin(tag, _asked(block, "full")))
                edge = np.searchsorted(row[whole], np.arange(block.num_rows + 1))
                for i in np.flatnonzero(np.diff(edge)):
                    mine = whole[edge[i] : edge[i + 1]]
                    spans[i] = _united(low[mine] - off[i], high[mine] + WIDTH - off[i])
                asked = np.flatnonzero(np.isin(tag, _asked(block, "send")))
                asked = asked[np.argsort(tag[asked], kind="stable")]  # bytes of a run go once, with every place of it
                once = np.flatnonzero(np.concatenate(([True], tag[asked[1:]] != tag[asked[:-1]]))) if asked.size else asked
                lows = np.split((low - off[row])[asked].astype(np.int32), once[1:]) if asked.size else []
                asked = asked[once]
                for i, a, b, k, places in zip(row[asked].tolist(), low[asked].tolist(), high[asked].tolist(), h[asked].view(np.int64).tolist(), lows, strict=True):
                    sent[i].append({"h": k, "lows": places, "bytes": raw[a : b + WIDTH]})
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(spans, pa.list_(pa.int32())), pa.array(sent, pa.list_(pa.struct([("h", pa.int64()), ("lows", pa.list_(pa.int32())), ("bytes", pa.binary())])))], ["doc_id", "spans", "sent"])

    return docs.select("doc_id", "text", "full", "send").mapInArrow(tidy(run), schema)


def _united(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Union of spans as a flat list of starts and ends."""
    if not start.size:
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return np.stack([start[head], end[np.append(head[1:], start.size) - 1]], 1).ravel().tolist()


# ---------------------------------------------------------------- suffix arrays


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in order by Larsson-Sadakane refinement, the symbols from each place packed into a word, and the bits of one.

    The first order is by as many symbols as fit one word.  Each round then
    sorts only the groups that are still tied, by the rank ``h`` places on, and
    doubles ``h``; with ``depth``, order beyond as many symbols is left open.
    """
    n = text.size
    bits = max(int(text.max(initial=0)) + 1, 1).bit_length()
    h = max(63 // bits, 1)
    padded = np.zeros(n + h, _U)
    padded[:n] = text.astype(_U) + _U(1)  # 0 is the end
    packed = np.zeros(n, _U)
    for i in range(h):
        packed = (packed << _U(bits)) | padded[i : n + i]
    order = np.argsort(packed)
    if not n:
        return order, packed, bits
    ordered = packed[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while depth is None or h < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slot = np.flatnonzero(tied)
        if not slot.size:
            break
        suffix = order[slot]
        ahead = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        both = (rank[suffix].astype(_U) << _U(32)) | ahead.astype(_U)
        by = np.argsort(both)
        order[slot] = suffix = suffix[by]
        both = both[by]
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        head[slot] = fresh
        rank[suffix] = slot[np.maximum.accumulate(np.where(fresh, np.arange(slot.size), 0))]
        h *= 2
    return order, packed, bits


def common_prefixes(order: np.ndarray, packed: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Symbols, up to ``depth``, that each suffix in order shares with the one before it.

    Kasai's rule: if suffix ``i`` shares ``l`` symbols with its neighbour, suffix
    ``i + 1`` shares at least ``l - 1`` with its own.  The text is cut into lanes
    that follow the rule in step, one suffix of each lane at a time; a lane begins
    anew where ``depth`` is reached, as order beyond it may be open.
    """
    n = order.size
    if not n:
        return np.zeros(0, np.int64)
    word = 63 // bits
    step = _U(1) << (np.arange(word, dtype=_U) * _U(bits))  # a difference below step[k] leaves word - k symbols equal
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    far = np.concatenate((packed, np.zeros(depth + word, _U)))
    size = max(min(n, 64), 1)
    lane = np.arange(0, n, size)
    shared, carried = np.zeros(n + 1, np.int64), np.zeros(lane.size, np.int64)
    for i in range(size):
        at = lane + i
        at, carried = at[at < n], carried[: np.count_nonzero(at < n)]
        other = before[at]
        carried[other < 0] = 0
        live = np.flatnonzero(other >= 0)
        while live.size:
            x = far[at[live] + carried[live]] ^ far[other[live] + carried[live]]
            same = word - np.searchsorted(step, x, "right")
            carried[live] += same
            live = live[(same == word) & (carried[live] < depth)]
        shared[at] = np.minimum(carried, depth)
        carried = np.where(carried < depth, np.maximum(carried - 1, 0), 0)
    return shared[order]


def repeated(pieces: list[bytes], docs: np.ndarray, seen: tuple[np.ndarray, np.ndarray] | None, keep: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(piece, start) of the strings that a smaller document has, in order, and what this shard holds.

    ``seen`` holds sorted strings of earlier shards with their smallest
    document; with ``keep`` the last result is the same of this shard.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    text = data.astype(np.int64)
    text[begin[1:] - 1] = 256  # ends a piece; no string of full width reaches it
    owner = np.repeat(np.arange(size.size), size + 1)
    order, packed, bits = suffix_array(text, WIDTH)
    long = begin[owner[order]] + size[owner[order]] - order >= WIDTH
    new = common_prefixes(order, packed, bits, WIDTH)[long] < WIDTH  # a shorter suffix never stands between equal strings
    order = order[long]
    if not order.size:
        return order, order, (np.zeros(0, f"V{WIDTH}"), np.zeros(0, np.int64))
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    doc = docs[owner[order]]
    low = np.minimum.reduceat(doc, head)
    held = np.zeros(0, f"V{WIDTH}")
    if keep or (seen is not None and seen[0].size):
        held = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WIDTH)[order[head]]).view(f"V{WIDTH}").ravel()
    if seen is not None and seen[0].size:
        at = _search(seen[0], held)
        hit = at >= 0
        low[hit] = np.minimum(low[hit], seen[1][at[hit]])
    late = order[doc > low[group]]
    late.sort()
    return owner[late], late - begin[owner[late]], (held, low)


def _key(strings: np.ndarray) -> np.ndarray:
    """Strings as rows of big-endian words, ordered as the bytes are."""
    raw = np.frombuffer(strings.tobytes(), np.uint8).reshape(-1, WIDTH)
    padded = np.zeros((raw.shape[0], -(-WIDTH // 8) * 8), np.uint8)
    padded[:, :WIDTH] = raw
    return padded.view(">u8")


def _search(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Binary search of each asked string among the sorted known ones: its index, or -1."""
    a, b = _key(known), _key(asked)
    low, high = np.zeros(b.shape[0], np.int64), np.full(b.shape[0], a.shape[0])
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        less = np.zeros(b.shape[0], bool)
        tie = open_.copy()
        for k in range(a.shape[1]):
            x, y = a[mid, k], b[:, k]
            less |= tie & (x < y)
            tie &= x == y
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    at = np.minimum(low, a.shape[0] - 1)
    return np.where((low < a.shape[0]) & (a[at] == b).all(1), at, -1)


def _compared(sent: DataFrame) -> DataFrame:
    """(doc_id, spans): strings of the sent runs (h, doc_id, lows, bytes) that a smaller document has, at every place of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight, seen, seen_h = 0, None, None

        def shard(last: bool) -> pa.RecordBatch:
            nonlocal weight, seen, seen_h
            h, docs, times, lows = (np.concatenate([x[i] for x in held]) for i in range(4))
            pieces = [p for x in held for p in x[4]]
            carried = seen if seen_h is not None and h[0] == seen_h else None
            if carried is not None and h[-1] != seen_h:  # only the first anchor goes on
                n = int(np.searchsorted(h, seen_h, "right"))
                first, rest = repeated(pieces[:n], docs[:n], carried), repeated(pieces[n:], docs[n:], None)
                piece, start = np.concatenate((first[0], rest[0] + n)), np.concatenate((first[1], rest[1]))
            else:
                piece, start, _ = repeated(pieces, docs, carried)
            if not last:  # the last anchor may go on in the next shard
                n = int(np.searchsorted(h, h[-1]))
                mine = repeated(pieces[n:], docs[n:], None, True)[2]
                seen = _merged(carried, mine) if carried is not None and h[-1] == seen_h else mine
                seen_h = h[-1]
            held.clear()
            weight = 0
            new = np.ones(piece.size, bool)
            new[1:] = (piece[1:] != piece[:-1]) | (start[1:] > start[:-1] + WIDTH)
            head = np.flatnonzero(new)
            ends = start[np.append(head[1:], start.size) - 1] + WIDTH if head.size else head
            many = times[piece[head]]
            edge = np.concatenate(([0], np.cumsum(many)))
            at = lows[np.arange(edge[-1]) + np.repeat((np.cumsum(times) - times)[piece[head]] - edge[:-1], many)]
            spans = np.stack([np.repeat(start[head], many) + at, np.repeat(ends, many) + at], 1).astype(np.int32).ravel()
            lists = pa.ListArray.from_arrays(pa.array((edge * 2).astype(np.int32)), pa.array(spans))
            return pa.RecordBatch.from_arrays([pa.array(docs[piece[head]], pa.int64()), lists], ["doc_id", "spans"])

        for batch in batches:
            pieces = batch.column(3).to_pylist()
            h, docs = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            times, lows = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).flatten().to_numpy().astype(np.int64)
            edge = np.concatenate(([0], np.cumsum(times)))
            grown = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
            at = 0
            while at < len(pieces):
                room = SHARD_BYTES - weight + (int(grown[at - 1]) if at else 0)
                to = max(at + 1, int(np.searchsorted(grown, room, "right")))
                held.append((h[at:to], docs[at:to], times[at:to], lows[edge[at] : edge[to]], pieces[at:to]))
                weight += int(grown[to - 1]) - (int(grown[at - 1]) if at else 0)
                at = to
                if weight >= SHARD_BYTES or at < len(pieces):
                    yield shard(False)
        if held:
            yield shard(True)

    ordered = sent.select("h", "doc_id", "lows", "bytes").repartition("h").sortWithinPartitions("h", "doc_id", "lows")
    return ordered.mapInArrow(tidy(run), "doc_id long, spans array<int>")


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    strings, low = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    key = _key(strings)
    order = np.lexsort((low, *key.T[::-1]))
    key = key[order]
    first = np.ones(order.size, bool)
    first[1:] = (key[1:] != key[:-1]).any(1)
    return strings[order][first], low[order][first]


def _digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(batch.schema.get_field_index("text")))
            raw = memoryview(data.tobytes())
            n, gone, count, check = [], [], [], []
            for i, lists in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                flat = np.array([x for s in lists or [] for x in s or []], np.int64).reshape(-1, 2)
                united = np.array(_united(flat[:, 0], flat[:, 1]), np.int64).reshape(-1, 2)
                digest, at = hashlib.sha256(), off[i]
                for a, b in united.tolist():
                    digest.update(raw[at : off[i] + a])
                    at = off[i] + b
                digest.update(raw[at : off[i + 1]])
                n.append(off[i + 1] - off[i])
                gone.append(int((united[:, 1] - united[:, 0]).sum()))
                count.append(len(united))
                check.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(check)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "spans").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _flagged(named: DataFrame) -> DataFrame:
    """(doc_id, full, send): runs that an earlier document repeats whole, and runs to compare."""
    by_anchor, by_run = Window.partitionBy("h"), Window.partitionBy("h", "g")
    each = _rows(named).withColumn("least", F.min("doc_id").over(by_anchor)).withColumn("most", F.max("doc_id").over(by_anchor)).filter("least < most")
    each = each.withColumn("own", F.min("doc_id").over(by_run)).withColumn("latest", F.max("own").over(by_anchor))
    key = F.col("h").bitwiseXOR(F.col("g"))
    whole, send = F.col("doc_id") > F.col("own"), (F.col("doc_id") == F.col("own")) & (F.col("latest") > F.col("least"))
    lists = each.filter(whole | send).groupBy("doc_id").agg(F.collect_set(F.when(whole, key)).alias("full"), F.collect_set(F.when(send, key)).alias("send"))
    return scratch.stage(lists, "flagged")


def _spans(found: DataFrame) -> DataFrame:
    """(doc_id, spans): spans of whole runs and of compared strings."""
    sent = found.select("doc_id", F.explode("sent").alias("s")).select("s.h", "doc_id", "s.lows", "s.bytes")
    both = found.select("doc_id", "spans").filter(F.size("spans") > 0).unionByName(_compared(sent))
    return scratch.stage(both.groupBy("doc_id").agg(F.collect_list("spans").alias("spans")), "spans")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): lists of starts and ends, in bytes, that repeat a smaller document."""
    scratch.small_batches(docs.sparkSession)
    named = docs.filter("doc_id is not null").select("doc_id", "text")
    return _spans(scratch.stage(_located(named.join(_flagged(named), "doc_id")), "located"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _digest(docs.join(repeated_spans(docs), "doc_id", "left"))
