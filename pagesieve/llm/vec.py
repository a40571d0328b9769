"""Vectorised text helpers that run inside Arrow tasks.

Every helper works on one block of rows of bounded size (``BLOCK`` bytes of
text, or one text if that is longer), so a task's memory does not depend on
how many rows it reads.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64); returns a new array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


def strings(col) -> pa.Array:
    """A column as large strings without nulls (null counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def offsets(arr: pa.Array) -> np.ndarray:
    """Byte offsets of a large string array, from 0."""
    o = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=arr.offset + len(arr) + 1)[arr.offset:]
    return o


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offset of each text."""
    o = offsets(arr)
    data = arr.buffers()[2]
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), np.zeros(len(o), np.int64)
    return np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]], o - o[0]


def release() -> None:
    """Give freed memory back: a worker lives through many tasks, and its peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):      # another C library: nothing to trim
        pass


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of text (or one row)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        o = offsets(strings(b.column(column)))
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(o, o[i] + limit, "right")) - 1))
            yield b.slice(i, j - i)
            i = j
        release()


# ---------------------------------------------------------------- words of UTF-8 bytes

_BYTE = constants(256, 1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_WORD = np.where(_SPACE, _U(0), _BYTE[_LOWER])   # A-Z count as a-z, white space as nothing
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd multiplier, at least ``n`` of them."""
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 2 * len(_POWERS), 1024), 0xD6E8FEB86659FD93, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS


class Words:
    """Words (runs without white space, A-Z lower-cased) of a block of texts.

    ``start`` and ``end`` are byte positions in ``buf``, ``doc`` the row of
    each word, ``first`` the index of each row's first word (``n_docs + 1``).
    """

    def __init__(self, arr: pa.Array):
        self.buf, self.offs = utf8(arr)
        n, self.n_docs = len(self.buf), len(self.offs) - 1
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.first = np.zeros(self.n_docs + 1, np.int64)
            return
        solid = ~_SPACE[self.buf]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        heads = self.offs[:-1]
        heads = heads[heads < n]
        begins[heads] = solid[heads]          # a text begins a word of its own
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        tails = self.offs[1:]
        tails = tails[tails > 0] - 1
        ends[tails] = solid[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offs)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        a = self.start[0]
        seg = np.diff(self.start, append=len(self.buf))
        pos = np.arange(a, len(self.buf)) - np.repeat(self.start, seg)
        vals = _BYTE_WORD[self.buf[a:]]
        p = powers(int((self.end - self.start).max()) + 1)
        vals *= p[np.minimum(pos, len(p) - 1)]
        return mix(np.add.reduceat(vals, self.start - a))


def counts_of(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order with how often (or with what total weight) each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        s = np.sort(values)
        at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        return s[at], np.diff(at, append=len(s))
    order = np.argsort(values, kind="stable")
    s = values[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[at], np.add.reduceat(weights[order], at)


def crc_bucket(ids: list, mod: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``mod`` (a null id counts as the text ``None``)."""
    return np.fromiter((zlib.crc32(str(i).encode()) % mod for i in ids), np.int64, len(ids))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
