"""An FM-index over a sequence of word numbers: ranks by a wavelet matrix, places by sampled suffix positions."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        words = np.zeros((n >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & _U(1)).astype(bool)


class WaveletMatrix:
    """Symbols below ``size`` with the occurrences of any symbol before any place."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            one = (symbols >> bit & 1).astype(bool)
            zeros = len(symbols) - int(np.count_nonzero(one))
            self.levels.append((bit, Bits(one), zeros))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, s = bits.rank(at), bits.rank(start)
            at = np.where(one, zeros + a, at - a)
            start = np.where(one, zeros + s, start - s)
        return at - start

    def get(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one, a = bits.get(at), bits.rank(at)
            out |= one.astype(np.int64) << bit
            at = np.where(one, zeros + a, at - a)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order, by doubling; only tied groups are sorted again.

    Symbols are positive; 0 is a separator, each one unlike the others (ordered by
    place), so no comparison reads past one and repeated texts cost no more
    rounds than their length asks.
    """
    n = len(symbols)
    part = symbols == 0
    rank = symbols + int(np.count_nonzero(part))
    rank[part] = np.arange(1, int(np.count_nonzero(part)) + 1)
    bits = max(1, int(rank.max()).bit_length())
    held = max(1, 63 // bits)
    padded = np.r_[rank, np.zeros(held, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(held):
        key = key << bits | padded[i:i + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    span = held
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = head
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            return order
        at = order[tied]
        after = at + span
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.lexsort((key, rank[at]))
        order[tied] = at[again]
        key = key[again]
        group = head[tied]
        new[tied] = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        span *= 2


class FMIndex:
    """Index of runs of positive symbols below ``size`` that single zeros part (also before and after all)."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = 16):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1], size)
        self.less = np.r_[0, np.cumsum(np.bincount(symbols, minlength=size))]
        # Sampled are a run's first place and every ``sample``-th after it, so no walk reaches a separator.
        place = np.arange(self.n)
        run = place - np.maximum.accumulate(np.where(symbols == 0, place, 0)) - 1
        chosen = (run % sample == 0)[order]
        self.sampled = Bits(chosen)
        self.places = order[chosen]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that begin with each phrase (rows of ``phrases``), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in phrases.T[::-1]:
            symbol = column[live]
            low[live] = self.less[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.bwt.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: step back until a sampled one, then add the steps."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows, 0
        while len(left):
            hit = self.sampled.get(at)
            out[left[hit]] = self.places[self.sampled.rank(at[hit])] + steps
            left, at, steps = left[~hit], at[~hit], steps + 1
            symbol = self.bwt.get(at)
            at = self.less[symbol] + self.bwt.rank(symbol, at)
        return out
