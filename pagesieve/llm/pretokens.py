"""Byte-level BPE ids of many texts, with each distinct pre-token encoded once.

The tokenizer's own splitter cuts a text into pre-tokens (letters, digits or
signs with one leading space, contractions, white space) and merges inside each,
so a text's ids are its pre-tokens' ids in order. Here the cuts of a whole block
of texts are found with arrays; only pre-tokens not met before go to the
tokenizer library. Texts with letters beyond the Latin blocks (where Unicode
versions could differ) go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from . import vec

LATIN = 0x250
LETTER, NUMBER, SPACE, SIGN, EDGE = range(5)
CACHE = 1 << 19   # distinct strings kept by a worker before it starts anew ...
POOL = 1 << 22    # ... or when their ids are more than so many
CHUNK = 1 << 13   # strings given to the library at once
_U = np.uint64


def _classes() -> np.ndarray:
    out = np.full(LATIN + 1, SIGN, np.uint8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = SPACE
        elif kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
    out[LATIN] = EDGE
    return out


_CLASS = _classes()
_CODE = vec.constants(LATIN + 1, 21)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True   # their strings in a text are ordinary text
    return t


def cuts(cp: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points below LATIN; texts are parted by LATIN itself."""
    k = _CLASS[cp]
    n = len(cp)
    cut = np.ones(n, bool)
    cut[1:] = k[1:] != k[:-1]
    cut |= k == EDGE
    cut[1:] |= k[:-1] == EDGE
    space = k == SPACE
    # The last of several white spaces before something else stands apart ...
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & (k[1:] != EDGE)
    cut[last] = True
    # ... and a blank there leads the token that follows.
    lead = np.flatnonzero(last & (cp == 32))
    cut[lead + 1] = False
    # Contractions: an apostrophe alone between a non-blank and one of s t m d / re ve ll.
    sign = np.flatnonzero(cp == 39)
    sign = sign[cut[sign]]
    if len(sign):
        pad = np.r_[cp, np.full(3, LATIN, cp.dtype)]
        one, two = pad[sign + 1], pad[sign + 2]
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for at, size in ((sign[short], 2), (sign[long & ~short], 3)):
            cut[at + 1] = False
            after = at + size
            after = after[after < n]
            cut[after] |= k[after] == LETTER
    return np.flatnonzero(cut)


def encoded(path: str, texts: list[str], chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of ids of each text.

    The library's encodings, far larger than their ids, live for a chunk of texts only.
    """
    flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i in range(0, len(texts), chunk):
        got = [e.ids for e in tokenizer(path).encode_batch(texts[i:i + chunk], add_special_tokens=False)]
        size.append(np.fromiter(map(len, got), np.int64, len(got)))
        flat.append(np.fromiter((x for g in got for x in g), np.uint32, int(size[-1].sum())))
    return np.concatenate(flat), np.concatenate(size)


class IdPool:
    """Id lists of strings by the strings' hash; starts anew beyond ``CACHE`` strings or ``POOL`` ids."""

    def __init__(self):
        self._clear()

    def _clear(self):
        self.known = np.zeros(0, np.uint64)   # ascending
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, h: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings one after another, and each one's number of ids.

        ``encode`` gets the positions of strings not met before and returns their
        ids one after another and the number of ids of each.
        """
        if len(self.known) > CACHE or len(self.pool) > POOL:
            self._clear()
        order = np.argsort(h)
        s = h[order]
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        each, first = s[new], order[new]
        slot = np.empty(len(h), np.int64)
        slot[order] = np.cumsum(new) - 1
        at = np.searchsorted(self.known, each)
        missing = np.ones(len(each), bool)
        if len(self.known):
            missing = self.known[np.minimum(at, len(self.known) - 1)] != each
        if missing.any():
            flat, size = encode(first[missing])
            where = len(self.pool) + np.cumsum(size) - size
            self.pool = np.r_[self.pool, flat.astype(np.uint32)]
            known = np.r_[self.known, each[missing]]
            order = np.argsort(known, kind="stable")     # two ascending runs
            self.known = known[order]
            self.at, self.size = np.r_[self.at, where][order], np.r_[self.size, size][order]
            at = np.searchsorted(self.known, each)
        at = at[slot]
        size = self.size[at]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.at[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class Encoder:
    """Ids of blocks of texts; keeps the ids of pre-tokens met so far."""

    def __init__(self, path: str):
        self.path = path
        self.known = IdPool()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        counts = np.zeros(len(texts), np.int64)
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        width = np.array([len(r) for r in raw], np.int64) // 4
        cp = np.frombuffer(b"".join(raw), np.uint32)
        heads = np.cumsum(width) - width
        odd = np.zeros(len(texts), bool)
        far = np.flatnonzero(cp >= LATIN)
        odd[np.searchsorted(heads + width, far, "right")] = True
        odd &= width > 0
        whole = {}
        if odd.any():
            rows = np.flatnonzero(odd)
            flat, size = encoded(self.path, [texts[i] for i in rows], 16)
            whole = dict(zip(rows, np.split(flat, np.cumsum(size)[:-1]), strict=True))
        plain = np.flatnonzero(~odd)
        ids, per = self._plain([texts[i] for i in plain])
        counts[plain] = per
        if not whole:
            return ids, counts
        parts, ends = [], np.cumsum(per)
        upto, done = dict(zip(plain, ends, strict=True)), 0
        for i in range(len(texts)):
            if i in whole:
                counts[i] = len(whole[i])
                parts.append(whole[i])
            else:
                parts.append(ids[done:upto[i]])
                done = upto[i]
        return np.concatenate(parts), counts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        edge = chr(LATIN)
        text = edge.join(texts) + edge
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = np.flatnonzero(cp == LATIN)
        if len(edges) == len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        start = cuts(cp)
        seg = np.diff(start, append=len(cp))
        pos = np.arange(len(cp)) - np.repeat(start, seg)
        p = vec.powers(int(seg.max()) + 1)
        h = vec.mix(np.add.reduceat(_CODE[cp] * p[pos], start))
        real = cp[start] != LATIN
        start, seg, h = start[real], seg[real], h[real]

        def fresh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words = [text[a:b] for a, b in zip(start[at].tolist(), (start[at] + seg[at]).tolist(), strict=True)]
            return encoded(self.path, words, CHUNK)
        ids, size = self.known.ids(h, fresh)
        bounds = np.searchsorted(start, edges)
        total = np.r_[0, np.cumsum(size)]
        return ids, np.diff(np.r_[0, total[bounds]])
