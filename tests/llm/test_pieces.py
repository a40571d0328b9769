import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.read_vocabulary(P.vocabulary())


def brute(v, text):
    """Best score over all cuts of the whole text, by dynamic programming over strings."""
    if not text:
        return [], 0.0
    s = ["\U0010ffff" if c == P.MARK else P.MARK if c == " " else c for c in " " + text]
    ids = {p: i for i, p in enumerate(v.pieces) if p}
    best, via = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for d in range(1, min(v.deepest, len(s) - i) + 1):
            k = ids.get("".join(s[i:i + d]))
            if k is None and d == 1:
                k = len(v.pieces)
            if k is not None and best[i] + v.score[k] > best[i + d] + 1e-9:
                best[i + d], via[i + d] = best[i] + v.score[k], (i, k)
    out, at = [], len(s)
    while at:
        i, k = via[at]
        raw = P.MARK if s[i] == "\U0010ffff" else s[i]
        out = ([k] if k < len(v.pieces) else [int(v.byte_id[b]) for b in raw.encode()]) + out
        at = i
    return out, best[-1]


TEXTS = st.lists(st.one_of(st.text(st.sampled_from("  the intaobrñ日\n▁😀."), max_size=30),
                           st.text(st.characters(exclude_categories=["Cs"]), max_size=12)), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_best_cut_and_round_trip(vocabulary, texts):
    ids, counts = P.PieceEncoder(vocabulary).encode(texts)
    assert P.decode(vocabulary, ids, counts) == texts
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == brute(vocabulary, t)[0]


def test_trie_holds_exactly_the_pieces(vocabulary):
    t = vocabulary.trie
    seen = 0
    for i, piece in enumerate(vocabulary.pieces):
        if piece:
            node = 0
            for ch in piece:
                child = t.base[node] + vocabulary.code[ord(ch)]
                assert t.check[child] == node
                node = child
            assert t.value[node] == i
            seen += 1
    assert (t.value >= 0).sum() == seen


def test_small_vocabulary_ties_and_bytes():
    v = P.Vocabulary.build({0: ("▁", -1.0), 1: ("a", -1.0), 2: ("ab", -2.0), 3: ("b", -1.0), 4: ("▁a", -2.0)},
                           list(range(5, 261)), 261)
    ids, counts = P.PieceEncoder(v).encode(["ab", "é", ""])
    assert counts.tolist() == [len(brute(v, "ab")[0]), 3, 0]
    assert ids[counts[0]:].tolist() == [0, 5 + 0xC3, 5 + 0xA9]
    assert P.decode(v, np.array([5 + 0xC3]), np.array([1])) == ["�"]
    with pytest.raises(ValueError):
        P.Vocabulary.build({0: ("a▁b", -1.0)}, list(range(1, 257)), 257)


def test_rows(make_docs, edge_rows):
    rows = [*edge_rows, (None, "null id", None)]
    out = P.encode_pieces(make_docs(rows))
    got = out.collect()
    assert len(got) == len(rows) and all(r.decodes and r.n_ids == len(r.ids) for r in got)
    assert {r.doc_id: r.n_ids for r in got}[2] == 0
    back = {r.doc_id: r.text for r in P.decode_pieces(out).collect()}
    assert all(back[d] == (t or "") for d, t, _ in rows)
    assert P.encode_pieces(make_docs([])).collect() == []
