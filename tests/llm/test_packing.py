import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.llm import packing
from pagesieve.llm.pretokens import Encoder, tokenizer

PATH = packing.vocabulary()
ALPHABET = st.text(st.sampled_from(list(" \n\t\r\u0085 a'stmdrevelB ñé1½9!?.,-—中😀<|>_ɉ")), max_size=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=12), st.sampled_from(["<|endoftext|>", "don't we'll", " 's"])),
                min_size=1, max_size=12))
def test_ids_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = Encoder(PATH).encode(texts)
    want = [e.ids for e in tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == want[0]
    assert ids.tolist() == [x for w in want for x in w]


@given(st.integers(1, 5000), st.integers(1, 1024))
def test_cut(total, capacity):
    got = packing.cut_lengths(total, capacity)
    assert sum(got) == total and all(x == capacity for x in got[1:]) and 0 < got[0] <= capacity


def brute_sum_of_squares(sizes, capacity):
    bins = []
    for i, s in enumerate(sizes):
        best = None
        for b in [*range(len(bins)), None]:
            fill = [sum(sizes[k] for k in x) for x in bins]
            if b is None:
                fill.append(s)
            elif fill[b] + s <= capacity:
                fill[b] += s
            else:
                continue
            gaps = [capacity - f for f in fill if f < capacity]
            gap = capacity - (fill[-1] if b is None else fill[b])
            cost = (sum(gaps.count(g) ** 2 for g in set(gaps)), gap)
            if best is None or cost < best[0]:
                best = (cost, b)
        if best[1] is None:
            bins.append([i])
        else:
            bins[best[1]].append(i)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_rule(sizes):
    got = packing.sum_of_squares(sizes, 12)
    want = brute_sum_of_squares(sizes, 12)
    fills = lambda bins: sorted(sum(sizes[i] for i in b) for b in bins)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert fills(got) == fills(want)      # which of the bins with one gap is taken is free


def check(rows, docs):
    got = packing.pack_pieces(packing.cut_pieces(docs)).collect()
    want = []
    for d, t, _ in rows:
        ids = np.array([*tokenizer(PATH).encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            want.append((d, k, at, n, zlib.crc32(ids[at:at + n])))
            at += n
    key = lambda r: (r[0] is None, *((r[0] or 0), *r[1:]))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(seqs), -(-sum(r.length for r in got) // 1024)


def test_edges(make_docs, edge_rows):
    check(edge_rows + [(None, "null id", None)], make_docs(edge_rows + [(None, "null id", None)]))
    assert packing.pack_pieces(packing.cut_pieces(make_docs([]))).collect() == []


@pytest.mark.parametrize("group", [1 << 16, 300])
def test_few_sequences(make_docs, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(5)
    rows = [(i, "ab " * rng.randint(1, 420), None) for i in range(2500)]
    used, least = check(rows, make_docs(rows, clash=False))
    assert used <= least * 1.02 + 2
