"""Token ids in grammar-compressed binary shards.

Documents are laid out in rising ``doc_id`` order by a range partitioning; each
task encodes its texts, gathers about ``shard_tokens`` ids and compresses them
by Re-Pair: in each round every frequent pair of neighbouring symbols becomes a
nonterminal, until no pair is frequent.  A shard keeps its rules and the expansion length of each, so any
id range is decoded without expanding the rest.  Shards are the binary column
of a Parquet table in the shared folder: Spark's committer and readers give
recovery from lost executors and reach any store.

Shard format (little endian): magic ``RPG1``; uint32 width, base, rules,
symbols, rows, ids; rules (left, right) of ``width`` bytes; uint32 expansion
lengths; symbols of ``width`` bytes; then for each row int64 ``doc_id``, uint8
null mark, uint32 number of ids.

Cases: a null or empty text has the end id alone; null ``doc_id`` come first;
rows of equal ``doc_id`` stand in text order; pairs of equal frequency become
rules together, and of overlapping pairs the first is replaced; a text of any
length stands in one shard; strings of special tokens are their ids unless
``specials`` is unset; an empty table gives no shard and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import HashArray, apart_hash, blocks, buffers, equal_spans, padded, per_row
from .workers import held, tidy

END = 0
SHARD = "part int, shard int, part_start long, n_ids long, payload binary"
_HEAD = struct.Struct("<4s6I")
_U32 = np.uint32

# ---------------------------------------------------------------- Re-Pair


def _replace(symbols: np.ndarray, base: int, least: int, room: int, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: new symbols, and the (left, right) of the rules it made for frequent pairs with a symbol of at least ``fresh``."""
    none = np.zeros((0, 2), _U32)
    if symbols.size < 2:
        return symbols, none
    narrow = int(symbols.max()) < 1 << 16
    left, right = symbols[:-1], symbols[1:]
    place = None
    if fresh:
        late = symbols >= fresh
        place = np.flatnonzero(late[:-1] | late[1:])
        left, right = left[place], right[place]
        if not place.size:
            return symbols, none
    key = (left << _U32(16)) | right if narrow else (left.astype(np.uint64) << np.uint64(32)) | right
    ordered = np.sort(key)
    edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    edge = np.concatenate(([0], edge))
    count = np.diff(np.append(edge, ordered.size))
    often = np.flatnonzero(count >= least)
    if often.size > room:
        often = np.sort(often[np.argsort(-count[often], kind="stable")[:room]])
    if not often.size:
        return symbols, none
    pairs = ordered[edge[often]]
    slot = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
    table, mine = np.full(1 << 18, pairs.size, np.int32), slot(pairs)
    table[mine] = np.arange(pairs.size)
    crowded = mine[table[mine] != np.arange(pairs.size)]
    table[crowded] = -1
    rule = table[slot(key)]
    if crowded.size:  # slots of several pairs are looked up by search
        unsure = np.flatnonzero(rule < 0)
        rule[unsure] = np.minimum(np.searchsorted(pairs, key[unsure]), pairs.size - 1)
    at = np.flatnonzero(rule < pairs.size)
    at = at[pairs[rule[at]] == key[at]]
    rule = rule[at]
    at = at if place is None else place[at]
    run = np.cumsum(np.concatenate(([True], at[1:] != at[:-1] + 1))) - 1 if at.size else at  # overlapping hits: every other one
    head = np.searchsorted(run, np.arange(run[-1] + 1)) if at.size else at
    use = (np.arange(at.size) - head[run]) % 2 == 0
    at, rule = at[use], rule[use]
    hits = np.bincount(rule, minlength=pairs.size) > 0
    used = np.flatnonzero(hits)
    out = symbols.copy()
    out[at] = (base + (np.cumsum(hits) - 1)[rule]).astype(_U32)
    keep = np.ones(symbols.size, bool)
    keep[at + 1] = False
    left = (pairs[used] >> (_U32(16) if narrow else np.uint64(32))).astype(_U32)
    right = (pairs[used] & (_U32(0xFFFF) if narrow else np.uint64(0xFFFFFFFF))).astype(_U32)
    return out[keep], np.stack([left, right], 1)


def compress(ids: np.ndarray, base: int, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule ``i`` is symbol ``base + i`` and refers to smaller symbols.

    Rounds go on until no pair of neighbours occurs ``least`` times.  A round after
    a round needs to look only at pairs with one of its new symbols.  While all
    symbols fit 16 bits, rules that would widen them are left out, the rarest first.
    """
    symbols, rules = ids.astype(_U32), [np.zeros((0, 2), _U32)]
    made = 0
    limit = (1 << 16) - base
    limit = limit if limit >= 4096 else 1 << 20  # a vocabulary that leaves no room has wide symbols
    fresh = 0
    while made < limit:
        symbols, new = _replace(symbols, base + made, least, limit - made, fresh)
        if not new.size:
            if not fresh:
                break
            fresh = 0  # what overlaps left over: a last look at all pairs
            continue
        fresh = base + made
        rules.append(new)
        made += len(new)
    return symbols, np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    length = np.ones(base + len(rules), np.int64)
    done = 0
    while done < len(rules):  # a run of rules that refer to finished ones only
        ready = (rules[done:] < base + done).all(1)
        n = int(np.argmin(ready)) if not ready.all() else len(ready)
        length[base + done : base + done + n] = length[rules[done : done + n]].sum(1)
        done += n
    return length[base:]


def pack(ids: np.ndarray, doc_ids: list, counts: np.ndarray, base: int) -> bytes:
    symbols, rules = compress(ids, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = _HEAD.pack(b"RPG1", width, base, len(rules), symbols.size, len(doc_ids), ids.size)
    return b"".join((head, rules.astype(kind).tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), symbols.astype(kind).tobytes(), numbers.tobytes(), nulls.tobytes(), counts.astype("<u4").tobytes()))


class Shard:
    """A shard opened for reading."""

    def __init__(self, payload: bytes):
        magic, width, self.base, n_rules, n_symbols, self.n_rows, self.n_ids = _HEAD.unpack_from(payload)
        if magic != b"RPG1":
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        kind = f"<u{width}"
        self.rules = take(kind, 2 * n_rules).reshape(-1, 2).astype(np.int32)
        self.lengths = take("<u4", n_rules).astype(np.int32)
        self.symbols = take(kind, n_symbols).astype(np.int32)
        numbers, nulls = take("<i8", self.n_rows), take("u1", self.n_rows)
        self.doc_ids = pa.array(numbers, mask=nulls.astype(bool))
        self.counts = take("<u4", self.n_rows).astype(np.int64)
        self.size = np.concatenate((np.ones(self.base, np.int32), self.lengths))  # of each symbol
        self.start = np.concatenate(([0], np.cumsum(self.size[self.symbols], dtype=np.int64)))
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """Terminals of all rules end to end, and where each begins."""
        if self._flat is None:
            flat = self.rules.ravel()
            while (rule := flat >= self.base).any():
                wide = np.repeat(flat, 1 + rule)
                first = np.cumsum(1 + rule) - (1 + rule)
                wide[first[rule]], wide[first[rule] + 1] = self.rules[flat[rule] - self.base].T
                flat = wide
            self._flat = flat, np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        return self._flat

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only the symbols that hold them are expanded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, _U32)
        low = int(np.searchsorted(self.start, start, "right")) - 1
        high = int(np.searchsorted(self.start, stop, "left"))
        part = self.symbols[low:high]
        flat, begin = self._expanded()
        length = self.size[part]
        rule = part >= self.base
        source = np.arange(flat.size, flat.size + part.size, dtype=np.int32)  # terminals stand after the expansions
        source[rule] = begin[part[rule] - self.base]
        ends = np.cumsum(length, dtype=np.int32)
        index = np.repeat(source - (ends - length), length)
        index += np.arange(ends[-1], dtype=np.int32)
        ids = np.concatenate((flat, part))[index]
        skip = start - int(self.start[low])
        return ids[skip : skip + stop - start].astype(_U32)


# ---------------------------------------------------------------- encoding

_INK = np.zeros(256, bool)
_INK[0x21:0x7F] = True
_LETTER_LEAD = np.zeros(256, bool)
_LETTER_LEAD[0xC3:0xDA] = True
_WORD = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_POINT = _INK & ~_WORD
_POINT[0x27] = False  # an apostrophe may belong to what follows


def pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of pieces that the pre-tokenizer never joins.

    A cut stands before a lone space or line feed between two characters that
    are visible ASCII or two-byte letters, and before an ASCII mark after a letter
    or digit of Latin-1: a pre-token ends at both, whatever stands around them.
    """
    gap = (data == 32) | (data == 10)
    after = _INK[data] | _LETTER_LEAD[data]
    before = _INK[data]
    before[1:] |= ((data[1:] & 0xC0) == 0x80) & _LETTER_LEAD[data[:-1]]
    cut = np.zeros(data.size, bool)
    if data.size > 2:
        cut[1:-1] = gap[1:-1] & before[:-2] & after[2:]
        word = _WORD[data]
        word[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        mark = _POINT[data[1:]] & word[:-1]
    heads = off[:-1][np.diff(off) > 0]
    tails = off[1:][np.diff(off) > 0] - 1
    cut[heads] = True
    lone = tails[tails > 0]
    inner = lone[~np.isin(lone, heads)]
    cut[inner] = False  # a last space has nothing after it in its text
    second = heads[heads + 1 < data.size] + 1
    second = second[~np.isin(second, heads)]
    cut[second] &= before[second - 1]
    if data.size > 2:
        cut[1:] |= mark
    return np.flatnonzero(cut)


class Encoder:
    """The tokenizer with the ids of pieces seen before; ``most`` bounds what is held.

    With ``specials`` strings of special tokens are their ids, as in the library, and
    rows that hold one are encoded whole; otherwise they are ordinary text.
    """

    def __init__(self, spec: str, most: int = 1_500_000, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(spec), most
        self.tokenizer.encode_special_tokens = not specials
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.old, self.new = HashArray(*none), HashArray(*none)  # hash of a piece: its number
        narrow = np.uint16 if self.vocabulary <= 1 << 16 else _U32
        self.ids, self.start, self.size, self.used = np.zeros(1 << 20, narrow), np.zeros(1 << 18, _U32), np.zeros(1 << 18, _U32), 0
        self.n = 0
        self.text, self.text_at, self.text_used = np.zeros(1 << 20, np.uint8), np.zeros(1 << 18, _U32), 0  # bytes of the pieces by number

    @staticmethod
    def _grown(held: np.ndarray, n: int) -> np.ndarray:
        return held if n <= held.size else np.concatenate((held, np.zeros(max(n, held.size + held.size // 2) - held.size, held.dtype)))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        codes = np.full(hashes.size, -1, np.int64)
        for table in (self.old, self.new):
            left = np.flatnonzero(codes < 0)
            at = table.find(hashes[left])
            codes[left[at >= 0]] = table.values[0][at[at >= 0]]
        return codes

    def _learn(self, hashes: np.ndarray | None, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces and return their numbers."""
        texts = [x.decode("utf-8", "replace") for x in pieces]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), _U32, int(size.sum()))
        codes = np.arange(self.n, self.n + size.size, dtype=np.int32)
        self.ids = self._grown(self.ids, self.used + flat.size)
        self.start, self.size = self._grown(self.start, self.n + size.size), self._grown(self.size, self.n + size.size)
        self.ids[self.used : self.used + flat.size] = flat
        self.start[codes] = self.used + np.cumsum(size) - size
        self.size[codes] = size
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        long = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.text = self._grown(self.text, self.text_used + raw.size + 8)
        self.text_at = self._grown(self.text_at, codes[-1] + 2 if codes.size else 0)
        self.text[self.text_used : self.text_used + raw.size] = raw
        self.text_at[codes + 1] = self.text_used + np.cumsum(long)
        self.text_used += raw.size
        self.used, self.n = self.used + flat.size, self.n + size.size
        if hashes is None:  # numbers for this block alone
            return codes
        self.new = HashArray(np.concatenate((self.new.keys, hashes)), np.concatenate((self.new.values[0], codes)))
        if self.new.keys.size > 300_000:
            self.old = HashArray(np.concatenate((self.old.keys, self.new.keys)), np.concatenate((self.old.values[0], self.new.values[0])))
            self.new = HashArray(self.new.keys[:0], self.new.values[0][:0])
        return codes

    def _whole(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that hold the string of a special token."""
        raw, found = data.tobytes(), set()
        for token in self.specials:
            at = raw.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(off, at, "right")) - 1)
                at = raw.find(token, at + 1)
        return np.array(sorted(found), np.int64)

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, an end id after each, and their number for each row."""
        begin = pieces(data, off)
        if (whole := self._whole(data, off)).size:
            inside = np.isin(np.searchsorted(off, begin, "right") - 1, whole) & ~np.isin(begin, off)
            begin = begin[~inside]
        first = np.searchsorted(begin, off)
        end = np.append(begin[1:], data.size)
        if begin.size:  # a piece ends with its row
            end = np.minimum(end, np.repeat(off[1:], np.diff(first)))
        hashes, where, inverse = np.unique(apart_hash(data, begin, end), return_index=True, return_inverse=True)
        if self.n + hashes.size > self.most or self.text_used > 64 << 20:
            self.clear()
        codes = self._find(hashes)
        missing = np.flatnonzero(codes < 0)
        raw = data.tobytes() if missing.size else b""
        if missing.size:
            codes[missing] = self._learn(hashes[missing], [raw[a:b] for a, b in zip(begin[where[missing]].tolist(), end[where[missing]].tolist(), strict=True)])
        code = codes[inverse]
        if begin.size:  # hashes propose, bytes decide
            long, held = end - begin, self.text_at[code].astype(np.int64)
            other = np.flatnonzero((self.text_at[code + 1] - held != long) | ~equal_spans(padded(data), begin, self.text, held, long))
            if other.size:
                raw = raw or data.tobytes()
                code[other] = self._learn(None, [raw[a:b] for a, b in zip(begin[other].tolist(), end[other].tolist(), strict=True)])
        size = self.size[code].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if size.size else 0
        flat = self.ids[np.repeat(self.start[code] - (ends - size), size) + np.arange(total)].astype(_U32) if total else np.zeros(0, _U32)
        counts = per_row(size, first)
        out = np.full(total + counts.size, END, _U32)
        out[np.arange(total) + np.repeat(np.arange(counts.size), counts)] = flat
        return out, counts + 1


OWNER = "token_shards"


def encoder_of(spec: str, specials: bool) -> Encoder:
    """The encoder of this worker process: it keeps known pieces from task to task."""
    return held(OWNER, (hash(spec), specials), lambda: Encoder(spec, specials=specials))


def write_shards(docs: DataFrame, tokenizer_path: str, shard_tokens: int = 1 << 20, specials: bool = True) -> str:
    """Write the shards of ``docs`` and return their path."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = scratch.share(spark, f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec.value, specials)
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        waiting = number = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, number, done
            ids = np.concatenate([h[0] for h in held])
            payload = pack(ids, [d for h in held for d in h[2]], np.concatenate([h[1] for h in held]), encoder.vocabulary)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([done]), pa.array([ids.size]), pa.array([payload], pa.binary())], ["part", "shard", "part_start", "n_ids", "payload"])
            held.clear()
            done, number, waiting = done + ids.size, number + 1, 0
            return out

        for batch in batches:
            for block in blocks(batch, limit=1 << 19):
                ids, counts = encoder.rows(*buffers(block.column(1)))
                held.append((ids, counts, block.column(0).to_pylist()))
                waiting += ids.size
                if waiting >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    path = scratch.new_path(spark, "shards")
    placed.mapInArrow(tidy(run, OWNER), SHARD).write.parquet(path)
    return path


def read_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards at ``path``."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a task
    before, base = 0, {}
    for r in totals:
        base[r.part] = before
        before += r.n
    shared = scratch.share(spark, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column(4)[i].as_buffer())
                ids = np.ascontiguousarray(shard.read().astype("<u4"))
                end = np.cumsum(shard.counts)
                start = end - shard.counts
                check = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                offset = shared.value[batch.column(0)[i].as_py()] + batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(start + offset), pa.array(shard.counts), pa.array(check, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer_path: str, shard_tokens: int = 1 << 20, specials: bool = True) -> DataFrame:
    return read_shards(docs.sparkSession, write_shards(docs, tokenizer_path, shard_tokens, specials))
