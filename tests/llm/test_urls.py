import math
import random

import pytest

from pagesieve.llm import urls

RULED = [("http://a.net/x", "a.net", "/x", "net/", "block"), ("http://a.net", "a.net", "", None, None),
         ("HTTP://Blog.Example.NET/en/1?q#f", "blog.example.net", "/en/1", "example.net/en/", "allow"),
         ("https://example.net/en", "example.net", "/en", "net/", "block"),
         ("x://notexample.com/de/1", "notexample.com", "/de/1", None, None),
         ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
         ("x://m.example.org/fr/?a=/en/", "m.example.org", "/fr/", "org/fr/", "allow"),
         ("x://y?u=http://z.net/", "y", "", None, None), ("x://#://a.net/", "", "", None, None),
         ("no scheme a.net/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
         ("http://ä.NET/ü\n/b", "ä.net", "/ü\n/b", "net/", "block"), ("http://net/" + "a" * 50_000, "net", None, "net/", "block")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "v", 0.5) for i, u in enumerate(rows)],
                                 "page_id long, url string, host string, verdict string, f_length double")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "url string, blocked int")


def test_rules_and_edges(spark):
    model = urls.train(labelled(spark, []))
    rows = [u for u, *_ in RULED] + ["http://a.net/x"] * 2
    got = {r.page_id: r for r in urls.judge(pages(spark, rows), model).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(RULED):
        assert (got[i].host, got[i].rule, got[i].verdict) == (host, rule, verdict or "allow")
        assert path is None or got[i].path == path
    assert urls.judge(pages(spark, []), model).collect() == []


def test_one_class(spark):
    model = urls.train(labelled(spark, [("http://a.com/1", 1), ("http://b.com/2", 1), (None, 0), ("http://c.d/", None)]))
    assert model.trees is None and model.prior == 1
    assert [r.verdict for r in urls.judge(pages(spark, ["http://q.com/"]), model).collect()] == ["block"]


def test_features(spark):
    u = "http://a-b.c1.example.com/x/y2.html?p=1&q=22#z"
    r = urls.lexical(pages(spark, [u, ""]).select("url")).collect()
    p = [u.count(c) / len(u) for c in set(u)]
    assert r[0].f_entropy == pytest.approx(-sum(x * math.log2(x) for x in p))
    assert (r[0].f_length, r[0].f_depth, r[0].f_params, r[0].f_labels, r[0].f_hyphens) == (len(u), 2, 2, 4, 1)
    assert r[0].f_digits == pytest.approx(sum(c.isdigit() for c in u) / len(u))
    assert (r[1].f_length, r[1].f_entropy, r[1].f_params) == (0, 0, 0)


def test_held_out_accuracy(spark):
    rng = random.Random(1)

    def some(n):
        out = []
        for _ in range(n):
            bad = rng.random() < 0.4
            host = f"{rng.choice(['cheap-pills', 'win-now', 'x']) if bad else rng.choice(['news', 'blog', 'x'])}.{rng.randrange(50)}.com"
            path = "/".join(str(rng.randrange(10**6 if bad else 10)) for _ in range(rng.randint(2, 5) if bad else 2))
            out.append((f"http://{host}/{path}{'?a=1&b=2&c=3' if bad else ''}", int(bad)))
        return out
    model = urls.train(labelled(spark, some(1500)))
    test = some(400)
    got = {r.page_id: r.verdict for r in urls.judge(pages(spark, [u for u, _ in test]), model, rules=[]).collect()}
    assert sum((got[i] == "block") == bool(b) for i, (_, b) in enumerate(test)) >= 0.95 * len(test)


def test_labels_by_document(spark):
    p = pages(spark, ["http://a.net/en/5?x", "http://a.net/en/6", "http://a.net/en/7", "http://a.net/en/", None])
    lab = spark.createDataFrame([(5, 0, 0), (6, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in urls.labelled_urls(p, lab).collect())
    assert got == [("http://a.net/en/5?x", 1), ("http://a.net/en/6", 0), ("http://a.net/en/7", 1)]


def test_sample_is_bounded_and_repeats_count(spark):
    many = [("http://hot.com/1", 1)] * 900 + [(f"http://h{i % 40}.com/{i}", i % 2) for i in range(900)] + [(None, 1)] * 50
    model = urls.train(labelled(spark, many), train_rows=200)
    assert model.prior == pytest.approx(1350 / 1800)
    assert sum(r["n"] for r in model.stats.collect()) == 1800 * len(urls.SUFFIXES)


def test_statistics_come_from_the_other_folds(spark):
    F = urls.F
    data = [(f"http://{'ab'[i % 2]}.com/{i}.{'html' if i % 3 else 'php'}", i % 2, 1 + i % 3, i % urls.FOLDS) for i in range(40)]
    rows = urls.lexical(spark.createDataFrame([(u, float(y), t, f) for u, y, t, f in data],
                                              "url string, label double, times long, fold int"))
    stats = urls._counted(rows)
    rated = urls._with_stats(rows, urls._other_folds(rows, stats), 0.25).collect()
    assert len(rated) == 40
    for r in rated:
        others = [(y, t) for u, y, t, f in data if f != r.fold]       # all hosts end in com
        n, bad = sum(t for _, t in others), sum(y * t for y, t in others)
        assert r.f_last1_rate == pytest.approx((bad + urls.SMOOTH * 0.25) / (n + urls.SMOOTH))
        assert r.f_last1_count == pytest.approx(math.log1p(n))
    whole = urls._with_stats(rows, stats, 0.25).select(F.max("f_last1_count")).first()[0]
    assert whole == pytest.approx(math.log1p(sum(t for _, _, t, _ in data)))


def test_labels_without_signal_ask_no_trees(spark):
    rng = random.Random(4)
    rows = [(f"http://{rng.choice('abcdef')}.com/{rng.randrange(9)}/{i}", int(rng.random() < 0.2)) for i in range(1500)]
    model = urls.train(labelled(spark, rows))
    assert 0.35 < model.auc < 0.65 and (model.trees is None) == (model.auc < urls.LEAST_AUC)


def test_host_path_and_rule_in_sql(spark):
    """The rules' part of the query against plain SQL."""
    import duckdb
    rows = [u for u, *_ in RULED]
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages(spark, rows), urls.train(labelled(spark, []))).collect()}
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(rows)))
    want = con.sql(urls.RULES_SQL).fetchall()
    assert {i: (h, p, r) for i, h, p, r in want} == got
