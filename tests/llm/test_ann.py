import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import ann

SCHEMA = "vec_id long, embedding array<float>, list long, v string, score double, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.0, 2) for i, v in rows], SCHEMA)


def brute(rows, query, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if query(i):
            cos = [(-ann.cosine(v[None], w[None])[0], j) for j, w in ok if j != i]
            out[i] = [(j, -s) for s, j in sorted(set(cos))[:k]]
    return out


def answers(df, k=5):
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 50 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def floats(x):
    return [float(np.float32(y)) for y in x]


def test_edges_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, floats(rng.normal(size=4))) for i in range(120)]
    hot = floats([1, 2, 3, 4])
    rows += [(200 + i, hot) for i in range(60)]              # copies: ties go to the smaller id
    rows += [(300, None), (350, [0.0] * 4), (400, [1.0, None, 1.0, 1.0]), (450, [float("nan"), 1.0, 1.0, 1.0]),
             (500, [float("inf"), 1.0, 1.0, 1.0]), (550, []), (None, hot), (200, hot), (600, [-0.0, 0.0, 0.0, 0.0])]
    assert answers(table(spark, rows)) == brute(rows, lambda i: i % 50 == 0)


def test_few_rows(spark):
    assert answers(table(spark, [])) == {}
    assert answers(table(spark, [(0, [1.0, 0.0])])) == {}
    assert answers(table(spark, [(0, [1.0, 0.0]), (7, [0.5, 0.5])])) == {0: [(7, pytest.approx(0.5 ** 0.5))]}


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 64)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    rows = [(i, floats(centre[i % 12] + 0.6 * rng.normal(size=16))) for i in range(4000)]
    got, want = answers(table(spark, rows)), brute(rows, lambda i: i % 50 == 0)
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 5 * len(want) and all(len(v) == 5 for v in got.values())
    exact = {(q, j): s for q, v in want.items() for j, s in v}
    assert all(exact[q, j] == s for q, v in got.items() for j, s in v if (q, j) in exact)


def test_many_queries_of_one_list_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 25)
    rng = np.random.default_rng(5)
    rows = [(i, floats(rng.normal(size=3) * 0.01 + 1)) for i in range(300)]     # all near one direction
    want = brute(rows, lambda i: True)
    got = {}
    for r in ann.nearest(table(spark, rows), F.lit(True)).collect():
        got.setdefault(r.query_id, set()).add((r.vec_id, r.score))
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.95 * 5 * len(rows)


def test_graph_search_finds_the_best(spark):
    rng = np.random.default_rng(3)
    c = ann.unit(rng.normal(size=(300, 8)))
    index = ann.Index(c, ann.neighbour_graph(c), 1.0)
    q = ann.unit(rng.normal(size=(100, 8)))
    ids, sim = ann.search_graph(index, q)
    assert (ids[:, 0] == (q @ c.T).argmax(1)).mean() >= 0.97
    assert all(len(set(r[s > -2.5])) == (s > -2.5).sum() for r, s in zip(ids, sim, strict=True))


def test_lists_are_balanced():
    rng = np.random.default_rng(4)
    x = ann.unit(np.r_[rng.normal(size=(900, 6)), rng.normal(size=(300, 6)) * 0.05 + 3])
    c = ann.balanced_centroids(x, 50)
    assert np.bincount((x @ c.T).argmax(1), minlength=len(c)).max() <= 200
