import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.llm import decontaminate, fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, items, window):
    grams = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for d, text, *_ in rows:
        found = list(WORD.finditer(lower(text)))
        w = [m[0] for m in found]
        hit, names = set(), set()
        for g, who in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    names |= who
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
        spans = [(a, z, found[a].start(), found[z].end()) for a, z in spans]
        out.append((d, len(w), sorted(str(x) for x in names if x is not None), spans))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=6),
       st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=8), st.integers(1, 5))
def test_index(runs, phrases, sample):
    symbols = [0]
    for r in runs:
        symbols += [*r, 0]
    symbols = np.array(symbols)
    suffixes = []       # separators differ, the earlier ones are smaller
    for i in range(len(symbols)):
        own = [(0, j) if symbols[j] == 0 else (1, symbols[j]) for j in range(i, len(symbols))]
        suffixes.append((own, i))
    assert fmindex.suffix_order(symbols).tolist() == [i for _, i in sorted(suffixes)]
    index = fmindex.FMIndex(symbols, 5, sample)
    low, high = index.search(np.array(phrases))
    for p, a, z in zip(phrases, low, high):
        want = [i for i in range(len(symbols)) if symbols[i:i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, z)).tolist()) == want
    every = np.flatnonzero(symbols[fmindex.suffix_order(symbols)] > 0)
    assert sorted(index.locate(every).tolist()) == np.flatnonzero(symbols).tolist()


def test_wavelet():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 37, 500)
    tree = fmindex.WaveletMatrix(seq, 37)
    assert tree.get(np.arange(500)).tolist() == seq.tolist()
    for s in (0, 5, 36):
        want = np.r_[0, np.cumsum(seq == s)]
        assert tree.rank(np.full(501, s), np.arange(501)).tolist() == want.tolist()


def tables(spark, make_docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    return make_docs(rows), bench


def canonical(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def check(spark, make_docs, rows, items, window=10, **how):
    docs, bench = tables(spark, make_docs, rows, items)
    got = decontaminate.find_contamination(docs, bench, window, **how).collect()
    got = [(r.doc_id, r.n_words, list(r["items"]), [tuple(s) for s in r.spans]) for r in got]
    assert canonical(got) == canonical(brute(rows, items, window))


@pytest.mark.parametrize("how", [{}, {"block_words": 40}, {"shard_bytes": 200}])
def test_random(spark, make_docs, how):
    rng = random.Random(4)
    vocab = ["Alpha", "beta", "gÄmma", "δ", "e5", "x"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(3, text(6)), (None, "alpha beta x x x"), (90, None)]
    rows = [(i, text(rng.randint(0, 60)), None) for i in range(60)]
    rows += [(70, rows[3][1], None), (3, rows[3][1], None), (None, rows[4][1] + (items[2][1] or ""), None)]
    check(spark, make_docs, rows, items, window=4, **how)


def test_edges(spark, make_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 7)
    passage = " ".join(f"w{i}" for i in range(60))
    items = [(1, passage), (2, "the quick brown fox jumps over the lazy dog and then it sleeps"), (10, "X"),
             (None, "ein text über schöne alte mühlen"), (5, " !! "), (6, None), (1, "one two three four")]
    rows = edge_rows + [(30, "Start " + passage.upper() + ", end", None), (None, passage, None),
                        (31, passage[:40] + " break " + passage[40:], None), (32, "w1 w2 w3 w4 w5 w6 w7 w8 w9", None)]
    check(spark, make_docs, rows, items)
    check(spark, make_docs, rows, [])
    check(spark, make_docs, [], items)
    with pytest.raises(ValueError):
        decontaminate.find_contamination(*tables(spark, make_docs, [], []), window=0)


def test_removal(spark, make_docs):
    docs, bench = tables(spark, make_docs, [(1, "é keep ALPHA beta gamma. rest é", None), (2, "none", None)],
                         [(1, "alpha beta gamma")])
    spans = decontaminate.find_contamination(docs, bench)
    clean = decontaminate.without_spans(F.col("text"), F.col("spans")).alias("t")
    out = docs.select("doc_id", "text").join(spans, "doc_id").select("doc_id", clean)
    assert dict(map(tuple, out.collect())) == {1: "é keep . rest é", 2: "none"}
