"""Vectorised text primitives over the byte buffers of Arrow string columns.

Texts never become Python strings here: a block of documents is one ``uint8``
array plus offsets.  Words are ``[^\\x20\\x09-\\x0D]+``; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of ASCII that are neither letters nor digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _POW or _POW[0].size < n:
        size, inverse = (n >> 18 << 18) + (1 << 18), pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POW[:] = [np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, b, _U)))) for b in (_ODD & _MASK, inverse)]
    return _POW[0][:n], _POW[1][:n]


def forget_powers() -> None:
    _POW.clear()
    _COEF.clear()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; see ``span_hash``."""
    out = np.zeros(data.size + 1, _U)
    np.cumsum(BYTE[data] * powers(data.size)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``end``, wherever they stand."""
    inverse = powers(prefix.size)[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


_COEF: list[np.ndarray] = []


def coefficients(n: int) -> np.ndarray:
    """Odd pseudo-random factors of the places in a span."""
    if not _COEF or _COEF[0].size < n:
        size = (n >> 18 << 18) + (1 << 18)
        _COEF[:] = [mix(np.arange(1, size + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)]
    return _COEF[0][:n]


def apart_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that do not overlap, in rising order.

    Every place of a span has a random factor of its own, so that, unlike with
    powers of one base, no construction of strings makes hashes meet: two different
    spans meet with a chance of at most 2**-56 over the factors.
    """
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    longest = int((end - start).max(initial=0))
    place = np.arange(data.size, dtype=np.int64)
    place -= np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [data.size]))))
    sums = np.zeros(data.size + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * coefficients(longest + 1)[np.minimum(place, longest)], out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


def eight(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The eight bytes from each start as one number; ``data`` reaches eight bytes beyond the last start."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[start].view(_U)[:, 0]


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate((data, np.zeros(8, np.uint8)))


_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [_MASK], _U)


def equal_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray, most: int = 4096) -> np.ndarray:
    """Whether ``a[at:at + size]`` and ``b[bt:bt + size]`` hold the same bytes; both are ``padded``."""
    same = np.ones(size.size, bool)
    for i in np.flatnonzero(size > most):
        same[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[bt[i] : bt[i] + size[i]])
    left, done = np.flatnonzero((size > 0) & (size <= most)), 0
    while left.size:
        rest = np.minimum(size[left] - done, 8)
        differ = ((eight(a, at[left] + done) ^ eight(b, bt[left] + done)) & _LOW[rest]) != 0
        same[left[differ]] = False
        done += 8
        left = left[~differ & (size[left] > done)]
    return same


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n, (_, offsets, data) = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each."""
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


class Words:
    """Words of a block: ``start``, ``end`` (byte offsets), ``doc`` (row), ``first`` (index of each row's first word)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE):
        self.data, self.off = data, off
        inside = ~gap[data]
        start, last = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads, tails = off[:-1], off[1:] - 1
        full = heads <= tails
        heads, tails = heads[full], tails[full]
        start[heads], last[tails] = inside[heads], inside[tails]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(off.size - 1), self.count)

    def hashes(self) -> np.ndarray:
        return apart_hash(self.data, self.start, self.end)


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``k`` words inside one row, and the indexes of their first words."""
    n = words.size - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(n, _U)
    for i in range(k):
        out = out * _U(0x9FB21C651E98DF25) + words[i : n + i]
    same = doc[:n] == doc[k - 1 :]
    return mix(out[same]), np.flatnonzero(same)


class HashArray:
    """A sorted array of 64-bit hashes with a directory of their leading bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [v[order] for v in values]
        self.shift = _U(64 - max(1, int(keys.size).bit_length()))
        cells = 1 << (64 - int(self.shift))
        self.at = np.searchsorted(self.keys, np.arange(cells, dtype=_U) << self.shift).astype(np.int32 if keys.size < 2**31 else np.int64)
        self.at = np.append(self.at, self.at.dtype.type(keys.size))

    def find(self, query: np.ndarray) -> np.ndarray:
        """Index of each query in ``keys``, or -1."""
        if not self.keys.size:
            return np.full(query.size, -1, np.int64)
        cell = (query >> self.shift).astype(np.int64)
        low, high = self.at[cell].astype(np.int64), self.at[cell + 1]
        probe = np.minimum(low, self.keys.size - 1)
        found = np.where((low < high) & (self.keys[probe] == query), low, -1)
        left = np.flatnonzero((found < 0) & (low + 1 < high))
        step = 1
        while left.size:
            at = low[left] + step
            hit = self.keys[at] == query[left]
            found[left[hit]] = at[hit]
            left = left[~hit & (at + 1 < high[left])]
            step += 1
        return found


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the whole numbers ``values[first[i]:first[i + 1]]``, 0 where that is empty."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
