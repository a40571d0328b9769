import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.llm import fingerprints as P

TEXT = st.text(st.sampled_from("abä😀 "), max_size=40)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.data())
def test_spans_and_extensions(texts, data):
    p = P.Prefixes(texts)
    i, j = (data.draw(st.integers(0, len(texts) - 1)) for _ in range(2))
    a, b = (data.draw(st.integers(0, len(texts[k]))) for k in (i, j))
    n = data.draw(st.integers(0, min(len(texts[i]) - a, len(texts[j]) - b)))
    x, y = p.spans(np.array([p.head[i] + a]), n), p.spans(np.array([p.head[j] + b]), n)
    assert (x[0] == y[0]) == (texts[i][a:a + n] == texts[j][b:b + n])
    most = min(len(texts[i]) - a, len(texts[j]) - b)
    want = next((k for k in range(most) if texts[i][a + k] != texts[j][b + k]), most)
    got = P.common_extension(p, np.array([p.head[i] + a]), p, np.array([p.head[j] + b]), np.array([most]))
    assert got[0] == want


@pytest.mark.parametrize("step", [1 << 19, 7])
def test_sketch(monkeypatch, step):
    monkeypatch.setattr(P, "SLICE", step)
    rng = random.Random(1)
    texts = ["", "short", *("".join(rng.choices("abcdef ", k=n)) for n in (15, 16, 17, 400))]
    p = P.Prefixes(texts)
    low, used = p.sketch()
    for k, t in enumerate(texts):
        wins = {t[i:i + P.WINDOW] for i in range(max(1, len(t) - P.WINDOW + 1))} if t else set()
        hashes = [int(P.vec.mix(P.Prefixes([w]).whole())[0]) for w in wins]
        least = {}
        for h in hashes:
            b, v = h >> 58, h & ((1 << 58) - 1)
            least[b] = min(v, least.get(b, v))
        assert {b: int(low[k, b]) for b in np.flatnonzero(used[k])} == {b: v & 0xFFFF for b, v in least.items()}


def brute_edit(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest(), t, nxt))
    return out


@pytest.mark.parametrize("part,block", [(1 << 30, 1 << 21), (2000, 300)])
def test_rows(make_docs, edge_rows, monkeypatch, part, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(2)
    rows = [*edge_rows, *[(100 + 3 * i, "".join(rng.choices("abc ", k=rng.randint(0, 90))), None) for i in range(80)],
            (None, "no id", None)]
    got = P.fingerprints(make_docs(rows), part_bytes=part).collect()
    want = brute_edit(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(
        (w[:3] for w in want), key=key)
    text = {w[2]: w for w in want}
    prints = {}
    for r in got:
        _, n, _, t, nxt = text[r.edited_sha256]
        assert prints.setdefault(r.fingerprint, t) == t
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == nxt:
            assert r.near_next == 1 and r.same_next == n
    assert len(prints) == len({t or "" for _, t, _ in rows})


def test_small_tables(make_docs):
    assert P.fingerprints(make_docs([])).collect() == []
    r = P.fingerprints(make_docs([(1, "abcd", None)])).collect()[0]
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1
    r = P.fingerprints(make_docs([(1, None, None)])).collect()[0]
    assert (r.n_chars, r.near_next, r.near_edited) == (0, 1, 1)


def test_likeness_follows_similarity():
    rng = random.Random(3)
    a, b = ("".join(rng.choices("abcdefghij", k=4000)) for _ in range(2))
    texts = [a, a[:2000] + b[:2000], b, a[:3800] + b[:200]]
    _, f = P._features(texts)
    like = lambda i, j: float(P.likeness(tuple(x[[i]] for x in f), tuple(x[[j]] for x in f))[0])
    assert like(0, 0) == 1 and like(0, 2) < 0.1 and abs(like(0, 1) - 1 / 3) < 0.2 and like(0, 3) > 0.7


def test_a_range_is_one_task(make_docs):
    docs = make_docs([(i, f"text number {i} " * 20, None) for i in range(400)])
    got = P.fingerprints(docs, part_bytes=4000).select("doc_id", F.spark_partition_id().alias("part")).collect()
    ids = {}
    for r in got:
        ids.setdefault(r.part, []).append(r.doc_id)
    spans = sorted((min(x), max(x), len(x)) for x in ids.values())
    assert len(spans) > 20 and max(n for *_, n in spans) <= 3 * 400 / len(spans)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
