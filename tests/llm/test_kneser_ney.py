"""The model against dictionaries of word tuples."""
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from pagesieve.llm import kneser_ney as K
from pagesieve.llm import trigrams as T3

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return [*WORD.findall((text or "").translate(LOWER)), "</s>"]


class Brute:
    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        self.raw = Counter(t for x in texts for t in toks(x))
        top = Counter()
        for x in texts:
            t = ["<s>"] * (order - 1) + toks(x)
            top.update(tuple(t[i - order + 1:i + 1]) for i in range(order - 1, len(t)))
        self.counts[order] = top
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.disc, self.ctx = {}, {}
        for n, c in self.counts.items():
            of = Counter(c.values())
            self.disc[n] = K.discounts(*(of[i] for i in (1, 2, 3, 4)))
            self.ctx[n] = defaultdict(list)
            for g, x in c.items():
                self.ctx[n][g[:-1]].append(x)

    def p(self, gram, n):
        if n == 0:
            return 1 / (len(self.raw) + 1)
        gram = gram[-n:]
        lower = self.p(gram, n - 1)
        xs = self.ctx[n].get(gram[:-1])
        if not xs:
            return lower
        d = self.disc[n]
        cut = lambda x: d[min(x, 3) - 1] if x else 0
        x = self.counts[n].get(gram, 0)
        return (x - cut(x)) / sum(xs) + sum(map(cut, xs)) / sum(xs) * lower

    def score(self, text):
        t = ["<s>"] * (self.order - 1) + toks(text)
        return sum(math.log10(self.p(tuple(t[i - self.order + 1:i + 1]), self.order))
                   for i in range(self.order - 1, len(t)))

    def base(self, text):
        n, v = sum(self.raw.values()), len(self.raw)
        return sum(math.log10((self.raw[t] + 1) / (n + v + 1)) for t in toks(text))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choices(vocab, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(120)]
    return [*out, None, "", "W1 w1\tw2\n", "hot " * 700, *["the same line"] * 30]


@pytest.mark.parametrize("order,shard", [(1, 1 << 20), (2, 300), (3, 1 << 20), (3, 500), (4, 500)])
def test_scores(make_docs, texts, monkeypatch, order, shard):
    monkeypatch.setattr(K, "RUN_BYTES", 2000)
    monkeypatch.setattr(T3, "RUN_TOKENS", 300)
    rows = [(i, t, None) for i, t in enumerate(texts)]
    brute = Brute(texts[:100] + texts[-33:], order)
    docs = make_docs(rows)
    model = K.train(make_docs([r for r in rows if r[0] < 100 or r[0] >= len(rows) - 33]), order, shard_bytes=shard)
    assert (model.total, model.vocabulary) == (sum(brute.raw.values()), len(brute.raw))
    extra = [(900, "unseen words w1 here", None), (901, "w3", None)]
    for r in K.score(docs.unionByName(make_docs(extra)), model).collect():
        text = dict((a, b) for a, b, _ in rows + extra)[r.doc_id]
        assert r.n_tokens == len(toks(text)) and r.n_known == sum(brute.raw[t] > 0 for t in toks(text))
        assert r.base_score == pytest.approx(brute.base(text), rel=1e-9)
        assert r.score == pytest.approx(brute.score(text), rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_probabilities_sum_to_one(texts):
    b = Brute(texts, 3)
    for ctx in [("<s>", "<s>"), ("w0", "w1"), ("hot", "hot"), ("x", "y")]:
        assert sum(b.p((*ctx, w), 3) for w in [*b.raw, "unseen"]) == pytest.approx(1)


def test_edges(make_docs, edge_rows):
    docs = make_docs([*edge_rows, (None, "the fox", None)])
    got = K.score(docs, K.train(docs)).collect()
    assert len(got) == len(edge_rows) + 1 and all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    none = K.train(make_docs([]))
    assert (none.total, none.vocabulary) == (0, 0)
    r = K.score(make_docs([(1, "a b", None)]), none).collect()[0]
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)
    assert K.score(make_docs([]), none).collect() == []


def test_large_counts(make_docs):
    text = "a " * 1000 + "b"
    docs = make_docs([(1, text, None)])
    assert K.score(docs, K.train(docs)).collect()[0].score == pytest.approx(Brute([text], K.ORDER).score(text))


def test_query_scores_with_two_words_of_context(make_docs, texts):
    docs = make_docs([(i, t, None) for i, t in enumerate(texts)])
    model = K.train(docs)
    assert model.order == 3
    brute = Brute(texts, 3)
    for r in K.score(docs, model).collect():
        assert r.score == pytest.approx(brute.score(texts[r.doc_id]), rel=1e-9)


@pytest.mark.parametrize("words", [1, 2, 3])
def test_blobs_hold_their_rows(words):
    rng = random.Random(words)
    pool = [rng.getrandbits(64) for _ in range(300)]
    rows = {(*(rng.choice(pool) for _ in range(words)), rng.choice([1, 2, 300, 70_000, 1 << 40])) for _ in range(2000)}
    cols = [K.np.array(c, K.np.uint64) for c in zip(*rows, strict=True)]
    cols[-1] = cols[-1].astype(K.np.int64)
    got = K._unblob(K._blob(cols, words), words + 1, words)
    assert {tuple(map(int, r)) for r in zip(*got, strict=True)} == rows and got[-1].dtype == K.np.int64


def test_trigram_rows_hold_their_rows():
    rng = random.Random(5)
    voc = K.np.unique(K.np.array([rng.getrandbits(56) for _ in range(300)], K.np.uint64))
    rows = sorted({tuple(rng.randrange(len(voc)) for _ in range(3)) for _ in range(2000)})
    n = [rng.choice([1, 2, 300, 70_000]) for _ in rows]
    words, *cols = T3.unpack_trigrams(T3.pack_trigrams(voc, *K.np.array(rows).T, K.np.array(n)))
    assert [tuple(int(words[i]) for i in r) for r in zip(*cols[:3], strict=True)] == [
        tuple(int(voc[i]) for i in r) for r in rows]
    assert cols[3].tolist() == n


def test_hot_middle_words_are_split(make_docs, texts):
    docs = make_docs([(i, t, None) for i, t in enumerate(texts)])
    model = T3.train(docs, shard_bytes=500)
    assert 0 < len(model.hot) <= 4 << model.bits and len(model.written["context"])
    brute = Brute(texts, 3)
    assert [int(n) for n in model.lowest[:1]] == [sum(brute.counts[1].values())]


def test_an_absent_file_raises(make_docs, texts):
    docs = make_docs([(i, t, None) for i, t in enumerate(texts)])
    model = T3.train(docs)
    fs, root = T3.pyarrow.fs.FileSystem.from_uri(model.path)
    fs.move(f"{root}/gram-0", f"{root}/gone")
    with pytest.raises(Exception, match="gram-0"):
        K.score(docs, model).collect()


def test_more_words_than_numbers_in_a_run(make_docs, texts, monkeypatch):
    monkeypatch.setattr(T3, "LOCAL", 5)
    docs = make_docs([(i, t, None) for i, t in enumerate(texts[:40])])
    whole = T3.train(docs)
    monkeypatch.undo()
    assert (whole.total, whole.counts, whole.lowest) == tuple(
        getattr(T3.train(docs), k) for k in ("total", "counts", "lowest"))
