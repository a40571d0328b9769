import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.llm import collocations


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(rows, least, longest, top, covered=80):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    long = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in long.items():
        inside = any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= covered * a
                     and any(q[1][i:i + len(p)] == p for i in range(len(q[1]))) for q, b in long.items())
        if inside:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def got(docs, *args, **kw):
    return sorted(tuple(r) for r in collocations.collocations(docs, *args, **kw).collect())


def prose(rng, n, vocab):
    return "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(n))


@pytest.mark.parametrize("shards, slot_bits", [(4, None), (1, None), (3, 4), (2, 1)])
def test_equals_brute_force(make_docs, monkeypatch, shards, slot_bits):
    """Also with so few slots that nearly all phrases share one."""
    monkeypatch.setattr(collocations, "DEAL_BYTES", 4000)
    rng = random.Random(8)
    vocab = ["New", "york", "city", "the", "of", "é", "a", "b", "c-d", "Ünder"] + [f"v{i}" for i in range(8)]
    rows = [(i, prose(rng, rng.randint(0, 80), vocab) + "new york city hall " * (i % 3), rng.choice(["en", "de", None]))
            for i in range(150)]
    rows += [(900, None, "en"), (901, "", None), (902, "only here", "fr"), (None, "new york city hall", "en")]
    rows += [(950, "the same line again and again\n" * 9, "und")] * 3
    want = brute(rows, 5, 4, 40)
    assert len(want) > 60
    assert got(make_docs(rows).repartition(5), 5, 4, 40, shards, slot_bits=slot_bits) == want


def test_edges(make_docs, edge_rows):
    assert got(make_docs(edge_rows)) == brute(edge_rows, 30, 4, 2000)       # the long text's phrases overlap
    assert got(make_docs([])) == []
    assert got(make_docs([(1, None, None), (2, "  ", "en")])) == []
    with pytest.raises(ValueError):
        collocations.collocations(make_docs([]), longest=1)


def test_ties_at_the_end(make_docs):
    rows = [(i, " ".join(f"x{k} y{k}." for k in range(30)), "en") for i in range(3)]
    for top in (1, 7, 29):
        assert got(make_docs(rows), 3, 3, top) == brute(rows, 3, 3, top)


def test_oracle(make_docs):
    rng = random.Random(2)
    docs = make_docs([(i, prose(rng, 60, [f"w{k}" for k in range(6)]), rng.choice(["en", None])) for i in range(60)], clash=False)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    rel = con.sql(collocations.SQL)
    order = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(rel.project(", ".join(order)).fetchall()) == got(docs)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.data())
def test_codec(words, data):
    rows = data.draw(st.integers(1, 30))
    cols = [np.array(data.draw(st.lists(st.integers(0, 2**64 - 1), min_size=rows, max_size=rows)), np.uint64)
            for _ in range(words)]
    count = np.array(data.draw(st.lists(st.integers(0, 2**40), min_size=rows, max_size=rows)), np.int64)
    texts = [b"t%d" % i for i in range(rows)] if words == 1 else None
    back, (n,), t = collocations.unpack(collocations.pack(cols, [count], texts), words, 1)
    flat = lambda c, n, t: sorted(zip(*(x.tolist() for x in c), n.tolist(), t))
    assert flat(back, n, t if words == 1 else [b""] * rows) == flat(cols, count, texts or [b""] * rows)
