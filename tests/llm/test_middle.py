import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.llm import middle
from pagesieve.llm.runs import CharIndex

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, unit="token", seed=42, fim=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def key(r):
    return tuple((x is None, str(x)) for x in r)


def check(docs, rows, **how):
    got = middle.fill_in_middle(docs, **{k: v for k, v in how.items()})
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    names = {"unit": "unit", "fim_percent": "fim", "spm_percent": "spm", "seed": "seed"}
    want = [brute(d, t, **{names[k]: v for k, v in how.items()}) for d, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    back = got.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((d, t or "") for d, t, _ in rows), key=key)


@given(st.text(st.sampled_from("ab \n\té€😀́"), max_size=40))
def test_index(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    index = CharIndex(raw)
    chars = np.arange(len(text) + 1)
    bytes_ = np.array([len(text[:i].encode()) for i in chars])
    assert index.bytes(chars).tolist() == bytes_.tolist()
    assert index.chars(bytes_).tolist() == chars.tolist()
    assert len(index.byte_at) == sum(ord(c) > 127 for c in text)     # ASCII has no entries


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("a é€😀 \n\t\x0b "), max_size=15), max_size=5))
def test_tokens(texts):
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    got = middle.token_ends(np.frombuffer(b"".join(raw), np.uint8), offs).tolist()
    want = [int(o) + len(t[:m.end()].encode()) for o, t in zip(offs, texts) for m in TOKEN.finditer(t)]
    assert got == want


@pytest.mark.parametrize("unit", ["token", "char"])
def test_edges(make_docs, edge_rows, unit):
    more = [(None, "null id é text", None), (50, "has <M> in it", None), (51, "<", None), (52, "< < <P", None),
            (53, "a<S", None), (54, "😀 é́ 中文   x", None)]
    more += [(100 + i, "<M <S é " * (i % 7) + "> S> x", None) for i in range(120)]
    rows = edge_rows + more
    check(make_docs(rows), rows, unit=unit)
    check(make_docs(rows), rows, unit=unit, fim_percent=100, spm_percent=0, seed=7)
    check(make_docs([]), [])


def test_bad_parameters(make_docs):
    for how in ({"unit": "line"}, {"marks": ("<P>", "<P>", "<M>")}, {"marks": ("P", "<S>", "<M>")}):
        with pytest.raises(ValueError):
            middle.fill_in_middle(make_docs([]), **how)
