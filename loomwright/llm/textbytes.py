"""Vectorised work on the UTF-8 bytes of a whole Arrow text column.

Arrow keeps the texts of a batch as one byte buffer with offsets. Everything here
runs on that buffer with numpy, so no text is turned into Python words one by one.
Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Bytes that part words: space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of letter tokens: ASCII letters and every byte of a code point above ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Rows go through in slices of about so many bytes, so that memory doesn't follow the batch.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each begins (one more entry at the end)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def release() -> None:
    """Gives freed memory back to the system: a worker lives on for other tasks, and what it only holds counts as used."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All batches in slices."""
    for batch in batches:
        yield from slices(batch, column, limit)
        release()


class Spans:
    """Runs of bytes of one class in each text: ``start``, ``end`` and, in ``at``, the first run of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(data)
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        self.start = np.flatnonzero(inside & (before | head[:n]))
        self.end = np.flatnonzero(inside & (after | head[1:])) + 1
        self.at = np.searchsorted(self.start, offsets)

    def per_text(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.per_text())


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    return Spans(data, offsets, ~SPACE[data])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all runs, one run after the other."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)


#: Keeps the first 0 to 8 bytes of a block of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_TURN = U64(0x9E3779B97F4A7C15)
#: Blocks that are looked at together, so that memory doesn't follow the spans.
_BLOCKS = 1 << 18


class Hasher:
    """64-bit hashes of any spans of a byte buffer, and exact comparisons of spans.

    A span is read in blocks of eight bytes; its hash is the sum of a scrambled value of each
    block and its number. Different ``key``s give hashes that have nothing to do with each other.
    """

    def __init__(self, data: np.ndarray, key: int = 1):
        self.raw = np.zeros(len(data) + 8, np.uint8)
        self.raw[: len(data)] = data
        # Eight bytes from every position on.
        self._from = np.ndarray((len(data) + 1,), "<u8", self.raw.data, 0, (1,))
        self._key = mix(np.array([key], U64) * _TURN)[0]

    def blocks(self, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The block at each start, of which ``left`` bytes count."""
        return self._from[start] & _KEEP[np.minimum(left, 8)]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        total = mix(mix(self.blocks(start, size) ^ self._key) + _TURN)
        for which, number, at, left in _further(start, size):
            one = mix(mix(self.blocks(at, left) ^ self._key) + _TURN * (number + 1).astype(U64))
            np.add.at(total, which, one)
        return mix(total ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93)))

    def same(self, start: np.ndarray, end: np.ndarray, other: Hasher, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Whether spans have the same bytes, pair by pair."""
        size = end - start
        good = size == other_end - other_start
        size = np.where(good, size, 0)
        good &= self.blocks(start, size) == other.blocks(other_start, size)
        for which, number, at, left in _further(start, size):
            unlike = self.blocks(at, left) != other.blocks(other_start[which] + 8 * number, left)
            good[which[unlike]] = False
        return good


def _further(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks after each span's first one, some at a time: span, number of the block, its place, the bytes left there."""
    long = np.flatnonzero(size > 8)
    count = (size[long] - 1) >> 3
    ends = np.cumsum(count)
    for first in range(0, int(ends[-1]) if len(ends) else 0, _BLOCKS):
        turn = np.arange(first, min(first + _BLOCKS, int(ends[-1])))
        k = np.searchsorted(ends, turn, "right")
        which, number = long[k], turn - (ends[k] - count[k]) + 1
        yield which, number, start[which] + 8 * number, size[which] - 8 * number


def numbered(hasher: Hasher, start: np.ndarray, end: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """A number for each span that it shares with the spans of the same bytes, and of the same group, only."""
    keys = hasher(start, end)
    if group is not None:
        keys = keys ^ mix((group.astype(U64) + U64(1)) * _TURN)
    order = np.argsort(keys)
    ranked = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(head) - 1
    first = order[head][number]
    good = hasher.same(start, end, hasher, start[first], end[first])
    if group is not None:
        good &= group == group[first]
    odd = np.flatnonzero(~good)
    if len(odd):
        # Equal hashes of different spans: these are told apart by what they are.
        own: dict[tuple, int] = {}
        for k in odd.tolist():
            name = (hasher.raw[start[k] : end[k]].tobytes(), None if group is None else int(group[k]))
            number[k] = own.setdefault(name, len(keys) + len(own))
    return number


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * U64(0xA24BAED4963EE407) + hashes[k : k + n]
    return mix(out)


def within(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each range."""
    return np.searchsorted(places, end) - np.searchsorted(places, start)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive positions."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
