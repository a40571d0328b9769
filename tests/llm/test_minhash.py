"""Near-duplicate groups against all pairs."""
import random
import re

import pytest

from pagesieve.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _, _) in enumerate(rows))


def result(df):
    return sorted(tuple(r) for r in minhash.near_groups(df).collect())


def test_edges(make_docs, edge_rows):
    assert result(make_docs(edge_rows)) == brute(edge_rows)


def test_null_ids_and_empty_table(make_docs):
    text = "a b c d e f g"
    got = minhash.near_groups(make_docs([(None, text, None), (5, text, None), (None, "q r s t u", None)])).collect()
    by = sorted((r.doc_id is None, r.component_id is None, r.kept) for r in got)
    assert by == [(False, False, True), (True, False, False), (True, True, True)]
    assert minhash.near_groups(make_docs([])).collect() == []


def variants(rng, n_groups, copies, words=120):
    """Groups of edited copies around the threshold, one large, all sharing a passage."""
    vocab = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=30)
    rows = []
    for g in range(n_groups):
        base = rng.choices(vocab, k=words) + passage
        for _ in range(copies[g % len(copies)]):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w), None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [2048, 16])
def test_groups_of_copies(make_docs, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    rows = variants(random.Random(3), 24, [1, 2, 3, 150])
    assert result(make_docs(rows, clash=False)) == brute(rows)


def test_stage_keeps_one_of_each_group(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = minhash.keep_one(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(d for d, _, c, k in brute(edge_rows) if k)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(kept))


def near(words, *changes):
    """A text of ``words`` with the words at ``changes`` replaced."""
    return " ".join("other" if i in changes else w for i, w in enumerate(words))


def test_near_copies_among_null_ids_are_linked(make_docs):
    words = [f"w{i}" for i in range(200)]
    # the ends are alike only through the middle, whose id is null
    left, right = near(words, *range(0, 25)), near(words, *range(175, 200))
    got = minhash.near_groups(make_docs([(8, left, None), (None, near(words), None), (9, right, None)])).collect()
    assert sorted((r.component_id, r.kept) for r in got) == [(8, False), (8, False), (8, True)]


def test_stage_keeps_unlike_texts_of_one_id(spark, make_docs):
    words = [[f"{g}{i}" for i in range(100)] for g in "abcdef"]
    a, b, c, d, e, f = (near(w) for w in words)
    rows = [(None, a, None), (None, b, None), (None, near(words[0], 5), None),   # null ids: one pair alike, one not
            (7, c, None), (7, d, None), (7, near(words[2], 50), None),           # one id, reused
            (3, near(words[4], 9), None), (None, e, None), (2, e, None),         # the smallest id of a group stays
            (None, f, None), (None, None, None), (None, "", None)]
    got = sorted((r.doc_id or 0, r.text or "") for r in minhash.keep_one(spark, make_docs(rows), "").collect())
    assert got == sorted([(0, a), (0, b), (7, c), (7, d), (2, e), (0, f), (0, ""), (0, "")])


def test_stage_keeps_columns_named_like_its_own(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, near(words), "keep1", "a"), (2, near(words), "drop", "b"), (None, "x y", "keep2", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, `_ROW_2` string")
    got = minhash.keep_one(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted((r["_row"], r["_ROW_2"]) for r in got.collect()) == [("keep1", "a"), ("keep2", "c")]
