"""Runs of UTF-8 bytes outside a set of gap bytes: the words of a block of texts, and byte or code-point places in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import vec

_U = np.uint64
_CODE = vec.constants(256, 61)
_CODE[65:91] = _CODE[97:123]     # A-Z count as a-z


def gap_table(spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the byte values in the given inclusive spans."""
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a:b + 1] = True
    return out


class Runs:
    """Maximal runs of bytes outside ``gap`` in a block of texts; no run crosses two texts.

    ``start`` and ``end`` are byte positions in ``buf``, ``doc`` the row of each
    run, ``first`` the index of each row's first run (``n_docs + 1`` values).
    """

    def __init__(self, arr: pa.Array, gap: np.ndarray):
        self.gap = gap
        self.buf, self.offs = vec.utf8(arr)
        n, self.n_docs = len(self.buf), len(self.offs) - 1
        solid = ~gap[self.buf]
        begin, close = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        close[:-1] &= ~solid[1:]
        heads, tails = self.offs[:-1], self.offs[1:]
        heads, tails = heads[heads < n], tails[tails > 0] - 1
        begin[heads] = solid[heads]
        close[tails] = solid[tails]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.start, self.offs)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each run's bytes, A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        a = self.start[0]
        seg = np.diff(self.start, append=len(self.buf))
        pos = np.arange(a, len(self.buf)) - np.repeat(self.start, seg)
        values = np.where(self.gap, _U(0), _CODE)[self.buf[a:]]
        p = vec.powers(int((self.end - self.start).max()) + 1)
        values *= p[np.minimum(pos, len(p) - 1)]
        return vec.mix(np.add.reduceat(values, self.start - a))


class CharIndex:
    """Sparse exception index of UTF-8 bytes: only multibyte characters are recorded.

    ``byte_at`` and ``char_at`` are their positions, ``total`` the excess bytes
    before each of them (and of all). Between them a code point is a byte, so a
    cut is converted by one binary search and a sum; ASCII text has no entries.
    """

    def __init__(self, buf: np.ndarray):
        self.byte_at = np.flatnonzero(buf >= 0xC0)
        lead = buf[self.byte_at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.total = np.r_[0, np.cumsum(excess)]
        self.char_at = self.byte_at - self.total[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before byte cuts that lie between characters."""
        return cut - self.total[np.searchsorted(self.byte_at, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before code-point cuts."""
        return cut + self.total[np.searchsorted(self.char_at, cut)]


def string_array(parts: list[bytes]) -> pa.Array:
    """Strings from UTF-8 bytes, without a round trip through Python strings."""
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(offs), pa.py_buffer(b"".join(parts)))
