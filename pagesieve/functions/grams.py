"""T1 and T2 over arrays of words inside Arrow tasks: what a text's words encode to, without a row per n-gram.

Same n-grams and buckets as ``hashing``; the code is sent to tasks by value, so it needs no copy of this package there.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = np.uint64(2 ** 40 + 435)
_U = np.uint64


def feed(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """The FNV-1a states after the UTF-8 bytes of one more character each."""
    if (cp < 0x80).all():
        return (h ^ cp) * FNV_PRIME
    lead = np.select([cp < 0x80, cp < 0x800, cp < 0x10000],
                     [cp, _U(0xC0) | cp >> _U(6), _U(0xE0) | cp >> _U(12)], _U(0xF0) | cp >> _U(18))
    h = (h ^ lead) * FNV_PRIME
    for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
        h = np.where(cp >= least, (h ^ (_U(0x80) | (cp >> _U(shift)) & _U(0x3F))) * FNV_PRIME, h)
    return h


def word_ids(words: list[str], min_n: int, max_n: int, buckets: int, mask: np.ndarray | None = None):
    """Pairs ``word`` (its place), ``bucket`` of each model token's n-grams (hash 0 and ids outside ``mask`` dropped)."""
    size = np.array([len(w) for w in words], np.int64)
    head = np.cumsum(size) - size
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    whole = np.array([len(w) >= 5 and w.startswith("__") and w.endswith("__") for w in words], bool)

    def kept(word, h):
        b = (h % _U(buckets)).astype(np.int64)
        keep = b != 0 if mask is None else (b != 0) & mask[b]
        return word[keep], b[keep]
    for n in range(min_n, max_n + 1):
        has = np.flatnonzero((size > n) & ~whole)
        per = size[has] - n + 1
        word = np.repeat(has, per)
        at = head[word] + np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)
        chars = [cp[at + j] for j in range(n)]
        order = np.lexsort((*chars, word))          # a word's equal n-grams count once
        word, chars = word[order], [c[order] for c in chars]
        same = word[1:] == word[:-1]
        for c in chars:
            same &= c[1:] == c[:-1]
        first = np.r_[True, ~same][:len(word)]
        h = np.full(int(first.sum()), FNV_OFFSET, np.uint64)
        for c in chars:
            h = feed(h, c[first])
        yield kept(word[first], h)
    alone = np.flatnonzero(whole | (max_n > min_n) | (size != min_n + 1))      # the word itself
    alone = alone[np.argsort(-size[alone], kind="stable")]
    h = np.full(len(alone), FNV_OFFSET, np.uint64)
    for j in range(int(size[alone[0]]) if len(alone) else 0):
        some = int(np.searchsorted(-size[alone], -j, "left"))
        h[:some] = feed(h[:some], cp[head[alone[:some]] + j])
    yield kept(alone, h)


def word_sums(words: list[str], min_n: int, max_n: int, buckets: int,
              mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each model token: how many kept ids its n-grams have, and their sum."""
    count, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for word, b in word_ids(words, min_n, max_n, buckets, mask):
        count += np.bincount(word, minlength=len(words))
        np.add.at(total, word, b)
    return count, total


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct keys, ascending, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    return [key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def word_buckets(words: list[str], min_n: int, max_n: int, buckets: int, mask: np.ndarray | None = None):
    """``ends``, ``bucket``, ``c``: word ``i`` has the distinct kept buckets from ``ends[i]`` to ``ends[i + 1]``, ``c`` times each."""
    word, b = (np.concatenate(x) for x in zip(*word_ids(words, min_n, max_n, buckets, mask), strict=True))
    key, c = _sums(word * buckets + b, np.ones(len(b), np.int64))
    return np.searchsorted(key, np.arange(len(words) + 1) * buckets), key % buckets, c


def _structs(ends: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x) for x in columns.values()], list(columns)))


def _bytes(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Each row's numbers, from ``ends[i]`` to ``ends[i + 1]``, as bytes."""
    at = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))])


WORDS_AT_ONCE = 1 << 16
TOKENS_AT_ONCE = 1 << 17      # of whole texts, one at least


def ids_of_words(min_n: int, max_n: int, buckets: int, mask=None):
    """For batches of distinct words: ``word, n_ids_w, ids`` of those that have ids. ``mask`` as in :func:`text_sums`."""
    def run(batches):
        kept = None if mask is None else mask.value
        for whole in batches:
            for at in range(0, whole.num_rows, WORDS_AT_ONCE):
                b = whole.slice(at, WORDS_AT_ONCE)
                ends, bucket, c = word_buckets(b.column(0).to_pylist(), min_n, max_n, buckets, kept)
                n = np.diff(np.r_[0, np.cumsum(c)][ends])
                yield pa.record_batch([b.column(0), pa.array(n), _structs(ends, bucket=bucket, c=c)],
                                      ["word", "n_ids_w", "ids"]).filter(pa.array(n > 0))
    return run


def counted_tokens(batches):
    """For ``(id, tokens)`` batches: ``id, counted``, a text's number of tokens and its distinct words with their counts."""
    for whole in batches:
        sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // TOKENS_AT_ONCE)) + 1, whole.num_rows]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            b, n_words = whole.slice(a, z - a), sizes[a:z]
            coded = b.column(1).flatten().dictionary_encode()
            at, n = _text_words(coded, n_words)
            words = coded.dictionary.take(pa.array(at % max(len(coded.dictionary), 1)))
            ends = np.searchsorted(at, np.arange(len(n_words) + 1) * len(coded.dictionary))
            counted = pa.StructArray.from_arrays([pa.array(n_words), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array(n)], ["word", "n"]))], ["n_words", "words"])
            yield pa.record_batch([b.column(0), counted], [whole.schema.names[0], "counted"]).filter(pa.array(n_words > 0))


def _text_words(coded: pa.DictionaryArray, n_words: np.ndarray) -> list[np.ndarray]:
    """``text * size of the dictionary + word`` of texts of ``n_words`` tokens, ascending, and how often each comes."""
    return _sums(np.repeat(np.arange(len(n_words)), n_words) * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False),
                 np.ones(len(coded), np.int64))


def text_entries(min_n: int, max_n: int, buckets: int, mask=None, apart: bool = False):
    """For batches of rows whose last column is a list of texts: the other columns, ``n_ids`` and ``entries``.

    A text is a list of tokens, or what :func:`counted_tokens` made of it.

    An entry is a distinct bucket, its share ``w`` of a text's mean word vector and its occurrences ``occ``, both
    summed over the row's texts. A row without ids has nulls. With ``apart`` these are the bytes of three arrays, not a list of structs.
    """
    def run(batches):
        held = HeldWords(min_n, max_n, buckets, None if mask is None else mask.value)
        for whole in batches:
            if not whole.num_rows:
                continue
            sizes = pc.list_value_length(whole.column(whole.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False)
            texts = whole.column(whole.num_columns - 1).flatten()
            n_words = (texts.field("n_words") if pa.types.is_struct(texts.type) else pc.list_value_length(texts)).to_numpy(
                zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(whole.num_rows), sizes)       # of each text
            of_row = np.bincount(row, n_words, whole.num_rows).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(of_row) // TOKENS_AT_ONCE)) + 1, whole.num_rows]
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                first, last = np.searchsorted(row, [a, z]).tolist()
                key, w, occ = _entries(texts.slice(first, last - first), n_words[first:last], row[first:last] - a, held)
                ends = np.searchsorted(key, np.arange(z - a + 1) * buckets)
                n_ids = np.diff(np.r_[0, np.cumsum(occ)][ends])
                if apart:
                    parts = {"bucket": _bytes(ends, (key % buckets).astype(np.int32)), "w": _bytes(ends, w),
                             "occ": _bytes(ends, occ.astype(np.int32))}
                else:
                    ends = pa.array(ends, pa.int32(), mask=np.r_[n_ids == 0, False])
                    parts = {"entries": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                        [pa.array(x) for x in (key % buckets, w, occ)], ["bucket", "w", "occ"]))}
                yield pa.record_batch([*whole.slice(a, z - a).columns[:-1], pa.array(n_ids, mask=n_ids == 0), *parts.values()],
                                      [*whole.schema.names[:-1], "n_ids", *parts])
    return run


WORDS_HELD = 1 << 18


class HeldWords:
    """:func:`word_buckets` of a task's words: one that comes again is not taken apart again. At most ``WORDS_HELD``
    words, or those asked for at once, are held."""

    def __init__(self, min_n: int, max_n: int, buckets: int, mask: np.ndarray | None):
        self.how, self.buckets = (min_n, max_n, buckets, mask), buckets
        self.forget()

    def forget(self):
        self.at, self.start, self.many, self.n_ids = {}, *(np.zeros(0, np.int64) for _ in range(3))
        self.bucket, self.c = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def places(self, words: list[str]) -> np.ndarray:
        """Of each word: its place in ``start`` and ``many`` (of its buckets and their counts) and ``n_ids``."""
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > WORDS_HELD:
            self.forget()
            new = words
        if new:
            ends, bucket, c = word_buckets(new, *self.how)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.start = np.r_[self.start, ends[:-1] + len(self.bucket)]
            self.many = np.r_[self.many, np.diff(ends)]
            self.n_ids = np.r_[self.n_ids, np.diff(np.r_[0, np.cumsum(c)][ends])]
            self.bucket, self.c = np.r_[self.bucket, bucket.astype(np.int32)], np.r_[self.c, c.astype(np.int32)]
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def _entries(texts, n_words, row, words: HeldWords):
    """``row * buckets + bucket``, ``w``, ``occ`` of texts of ``n_words`` tokens each, that belong to the rows ``row``."""
    if pa.types.is_struct(texts.type):
        held = pc.struct_field(texts, "words")
        coded, n = held.flatten().field("word").dictionary_encode(), held.flatten().field("n").to_numpy(zero_copy_only=False)
        per = pc.list_value_length(held).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(n_words)), per) * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    else:
        coded = texts.flatten().dictionary_encode()
        at, n = _text_words(coded, n_words)
    many = max(len(coded.dictionary), 1)
    text, word = at // many, words.places(coded.dictionary.to_pylist())[at % many]
    per = words.many[word]
    src = np.repeat(words.start[word] - (np.cumsum(per) - per), per) + np.arange(per.sum())
    occ = np.repeat(n, per) * words.c[src]
    key = np.repeat(row[text] * words.buckets, per) + words.bucket[src]
    return _sums(key, occ / np.repeat(n_words[text] * words.n_ids[word], per), occ)


def text_vectors(min_n: int, max_n: int, buckets: int, table, names: list[str], mask=None):
    """For ``(id, counted)`` batches: ``names``, that is the id and the mean over a text's words of their mean id vectors.

    ``table`` is a broadcast pair of buckets, ascending, and their vectors with one of zeros after them. Texts
    without known buckets have no row.
    """
    def run(batches):
        kept = None if mask is None else mask.value
        keys, vectors = table.value
        for whole in batches:
            sizes = whole.column(1).field("n_words").to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // TOKENS_AT_ONCE)) + 1, whole.num_rows]
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                held, n_words = pc.struct_field(whole.column(1).slice(a, z - a), "words"), sizes[a:z]
                coded = held.flatten().field("word").dictionary_encode()
                ends, bucket, c = word_buckets(coded.dictionary.to_pylist(), min_n, max_n, buckets, kept)
                at = np.searchsorted(keys, bucket)
                known = np.r_[keys, -1][at] == bucket
                at[~known] = len(keys)
                n, per = len(coded.dictionary), np.diff(ends)
                of = np.repeat(np.arange(n), per)
                share = c / np.repeat(np.diff(np.r_[0, np.cumsum(c)][ends]), per)
                text = np.repeat(np.arange(z - a), pc.list_value_length(held).to_numpy(zero_copy_only=False))
                word = coded.indices.to_numpy(zero_copy_only=False)
                part = held.flatten().field("n").to_numpy(zero_copy_only=False) / n_words[text]
                x = [np.bincount(text, part * np.bincount(of, share * v[at], n)[word], z - a) for v in vectors.T]
                has = np.bincount(text, np.bincount(of, known, n)[word], z - a) > 0
                yield pa.record_batch([whole.column(0).slice(a, z - a), *map(pa.array, x)], names).filter(pa.array(has))
    return run


def text_sums(min_n: int, max_n: int, buckets: int, mask=None):
    """For ``(id, tokens)`` batches: ``id, n_ids, bucket_sum, n_words`` of the texts that have ids.

    ``mask`` is a broadcast array of a flag per bucket. Words are taken apart once per batch.
    """
    def run(batches):
        kept = None if mask is None else mask.value
        for b in batches:
            tokens = b.column(1)
            coded = tokens.flatten().dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64))
            count, total = word_sums(coded.dictionary.to_pylist(), min_n, max_n, buckets, kept)
            sums = [np.diff(np.r_[0, np.cumsum(x[at])][np.r_[0, ends]]) for x in (count, total, count > 0)]
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.int64()) for x in sums)],
                                  ["id", "n_ids", "bucket_sum", "n_words"]).filter(pa.array(sums[2] > 0))
    return run
