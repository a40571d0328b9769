import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.llm import language as L

WORDS = {"en": "the of and with that from this have which their would there people through".split(),
         "de": "der und das mit nicht über eine werden schön Straße größer zwischen können".split(),
         "ru": "и в не на что быть этот который весь человек говорить время".split()}


def prose(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, lang, 40), lang) for i, lang in enumerate(["en", "de", "ru"] * 40)]


@pytest.fixture(scope="module")
def model(make_docs, corpus):
    return L.train(make_docs(corpus))


def test_held_out_accuracy(make_docs, model):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, 8), lang) for i, lang in enumerate(["en", "de", "ru"] * 30)]
    got = {r.doc_id: r for r in L.predict(make_docs(rows), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_spans_of_mixed_text(make_docs, model):
    rng = random.Random(3)
    a, b, c = prose(rng, "en", 30), prose(rng, "de", 50), prose(rng, "ru", 10)
    text = f"«{a}. {b}, {c}»"
    r = L.predict(make_docs([(1, text, None)]), model).collect()[0]
    assert [s.lang for s in r.spans] == ["en", "de", "ru"] and r.lang_pred == "de"
    assert [text[s.start:s.end] for s in r.spans] == [a, b, c]


def test_edges(make_docs, edge_rows, model):
    got = [(r.doc_id, r.lang_pred, r.score, len(r.spans)) for r in
           L.predict(make_docs([*edge_rows, (None, "the people", None)]), model).collect()]
    by = {d: (p, s, n) for d, p, s, n in got}
    assert len(got) == len(edge_rows) + 1
    assert all(by[d] == ("und", 0.0, 0) for d in (2, 3, 4, 5))
    assert by[8][0] in model.languages and by[8][2] == 1 and by[14][0] in model.languages
    assert by[11][0] in model.languages and by[11][1] == 0      # a script not seen in training
    assert by[None][0] == "en"
    assert L.predict(make_docs([]), model).collect() == []


def test_no_labels(make_docs):
    model = L.train(make_docs([(1, "abc", None), (2, None, "en")]))
    assert model.languages == []
    assert [tuple(r)[1:] for r in L.predict(make_docs([(1, "abc", None)]), model).collect()] == [("und", 0.0, [])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=5), st.integers(0, 10**6), st.sampled_from([0.0, 0.7, 3.0]))
def test_viterbi_is_best(sizes, seed, switch):
    rng = np.random.default_rng(seed)
    first = np.r_[0, np.cumsum(sizes)]
    scores, prior = rng.normal(size=(first[-1], 3)), rng.normal(size=3)
    got = L.viterbi(scores, first, prior, switch)

    def value(path, s):
        return prior[path[0]] + sum(s[i, k] for i, k in enumerate(path)) - switch * sum(
            a != b for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            best = max(value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a))
            assert value(tuple(got[a:b]), scores[a:b]) == pytest.approx(best)


def test_grams():
    w = L.LetterWords(["Ab, é! ab1b", ""])
    words = [("ab", 0), ("é", 0), ("ab", 0), ("b", 0)]
    assert [w.doc.tolist(), w.size.tolist()] == [[d for _, d in words], [len(x) for x, _ in words]]
    bucket, order, owner = w.grams(np.array([0, 1, 2]))
    for k, (x, _) in enumerate(words[:3]):
        padded = f"\0{x}\0"
        n = sum(1 for g in (1, 2, 3, 4) for i in range(len(padded) - g + 1)
                if (g > 1 or padded[i] != "\0") and "\0" not in padded[i + 1:i + g - 1])
        assert (owner == k).sum() == n
    mine = lambda k: sorted(zip(order[owner == k], bucket[owner == k], strict=True))
    assert mine(0) == mine(2) != mine(1)


def test_stage(spark, make_docs, corpus):
    docs = make_docs([*corpus, (900, None, None), (901, "123", None)])
    out = L.keep_identified(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [d for d, _, _ in corpus]


def test_sample_is_bounded(make_docs, monkeypatch):
    """Null and repeated ids, and one text in a third of the rows, do not make the sample larger."""
    taken = []
    rows = [(None if i % 3 else i % 7, prose(random.Random(i), "en", 6), "en") for i in range(4000)]
    rows += [(None, "the same text", "en")] * 2000
    frame = type(make_docs([]))
    repartition = frame.repartition

    def watch(self, n, *cols):
        taken.append(self.count())
        return repartition(self, n, *cols)
    monkeypatch.setattr(frame, "repartition", watch)
    L.train(make_docs(rows), per_language=500)
    assert 200 <= taken[0] <= 600


def test_dirty_language_column(make_docs, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", 10), "en") for i in range(20)] + [(i, prose(rng, "de", 10), "de") for i in range(10)]
    rows += [(i, "junk words", f"x{i}") for i in range(30)]
    assert L.train(make_docs(rows)).languages == ["de", "en"]


def test_a_block_of_words_holds_few_bytes_a_character():
    import tracemalloc

    from pagesieve.llm import language as L
    texts = ["plain words of some text " * 4000] * 10
    L.LetterWords(texts[:1])        # the tables and powers are made once
    tracemalloc.start()
    w = L.LetterWords(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.start) == 10 * 4000 * 5 and len(set(w.hash.tolist())) == 5
    assert peak < 42 * sum(map(len, texts)) and L.TEXT_BLOCK <= 1 << 20
