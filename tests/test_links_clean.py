import itertools
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagesieve import constants as K
from pagesieve.operators import clean as CL
from pagesieve.operators import links as LK


def test_anchor_dedup_last_title_first_position(spark):
    html = ('<a href="/a">First</a><a href="/b">B</a><a href="/a">  Second <b>x</b> </a>'
            "<a class='c' href='/c'>C</a>")
    df = spark.createDataFrame([(1, "http://h.example.com/p/q", html)], "page_id long, url string, html string")
    rows = df.select(F.inline(LK.dedup_by_href(LK.anchors(F.col("html"))))).collect()
    assert [(r.pos, r.href, r.title) for r in rows] == [(0, "/a", "Secondx"), (1, "/b", "B"), (3, "/c", "C")]


def test_resolve_url_matches_urljoin(spark):
    base = "http://h.example.com/dir/page.html?q=1#f"
    hrefs = ["http://x.org/a", "https://y.org", "//cdn.example.com/x.js", "/abs/path", "#frag", "?k=v",
             "", "rel/path", "mailto:a@b.c"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = [r.u for r in df.select(LK.resolve_url(F.col("b"), F.col("h")).alias("u")).collect()]
    assert got == [urljoin(base, h) for h in hrefs]


def test_resolve_url_folds_dot_segments(spark):
    parts = ["a", "b", ".", "..", "", "c.html"]
    bases = ["http://h.org", "http://h.org/", "http://h.org/x", "http://h.org/x/y/", "http://h.org/x/y/z?q#f"]
    hrefs = ["/".join(p) + tail for n in (1, 2, 3, 4) for p in itertools.product(parts, repeat=n)
             for tail in (["", "?k=v#w"] if n < 3 else [""])]
    pairs = [(b, h) for b in bases for h in hrefs if h and not h.startswith("//")]
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in df.select("b", "h", LK.resolve_url(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.h), (r.b, r.h)


def test_host_of_urls_that_strict_parsers_reject(spark):
    urls = {"http://a_b.Example.com/x": "a_b.example.com", "http://h.org/a b": "h.org", "http://h.org/?q={x}": "h.org",
            "http://u:p@h.org:80/|": "h.org", "mailto:a@b.c": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", LK.host_of("u").alias("h")).collect()} == urls


def test_like_match_rules(spark):
    vals = spark.createDataFrame([(1, "https://Docs.Example.com/a"), (2, "http://spam-farm.example.org/x"),
                                  (3, "http://other.org/50%off")], "k long, v string")
    pats = spark.createDataFrame([("  EXAMPLE.COM ",), ("",), ("%spam%farm%",), ("50%off",)], "pattern string")
    assert {r.k for r in LK.matching_keys(vals, "k", "v", pats).collect()} == {1, 2, 3}
    assert LK.matching_keys(vals, "k", "v", pats.where("pattern = ''")).collect() == []
    everything = spark.createDataFrame([("%",)], "pattern string")
    assert {r.k for r in LK.matching_keys(vals, "k", "v", everything).collect()} == {1, 2, 3}


def test_default_allow_list_when_user_list_empty(spark):
    assert len(K.DEFAULT_ALLOW_LIST) == 143
    empty = spark.createDataFrame([], "pattern string")
    assert LK.effective_allow_list(spark, empty).count() == 143
    user = spark.createDataFrame([("a.com",)], "pattern string")
    assert [r.pattern for r in LK.effective_allow_list(spark, user).collect()] == ["a.com"]


def test_article_score_rules(spark):
    df = spark.createDataFrame([("/news/article-1", "A real title", "http://s.com/news/article-1"),
                                ("javascript:void", "Home", "javascript:void"),
                                ("/img.png", "x", "http://s.com/img.png")], "h string, t string, u string")
    got = [r.s for r in df.select(LK.article_score(F.col("h"), F.col("t"), F.col("u")).alias("s")).collect()]
    assert got == [len("http://s.com/news/article-1") + 500, len("javascript:void") - 1000,
                   len("http://s.com/img.png") - 500]


def test_split_exact_sizes_no_overlap(spark):
    df = spark.range(0, 103).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    s = CL.split_train_test(df, 0.2, 42, "doc_id", "label")
    rows = s.collect()
    assert len(rows) == 103 and len({r.doc_id for r in rows}) == 103
    for lab in (0, 1):
        n = sum(1 for r in rows if r.label == lab)
        t = sum(1 for r in rows if r.label == lab and r.split == "test")
        import math
        assert t == math.ceil(0.2 * n)


def test_shared_prefix_against_brute_force(spark):
    texts = ["Header: alpha beta", "Header: alpha gamma", "Header: other", "Unique text", "x" * 200 + "a",
             "x" * 200 + "b", "same", "same", ""]
    rows = [(i, "site" if i < 4 else "s2", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, website string, text string")
    got = {r.doc_id: r.prefix_len for r in CL.strip_shared_prefix(df).collect()}
    import os.path
    for i, w, t in rows:
        others = [o for j, ww, o in rows if ww == w and j != i]
        best = max([len(os.path.commonprefix([t, o])) for o in others] or [0])
        assert got[i] == best, (i, got[i], best)


def test_split_keeps_rows_without_a_class(spark):
    df = spark.range(0, 20).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("label"))
    rows = CL.split_train_test(df, 0.2, 42, "doc_id", "label").collect()
    assert len(rows) == 20
    assert sorted((str(r.label), r.split) for r in rows).count(("None", "test")) == 1


def test_seed_index_equals_trying_every_pattern(spark):
    import random
    import re
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc./%") for _ in range(n))
    urls = ["http://" + word(rng.randint(0, 12)).replace("%", "d") for _ in range(60)] + ["", "x" * 5000 + "needle", "HTTP://ABC", None]
    pats = [(word(rng.randint(1, 5)), rng.choice(["allow", "deny"])) for _ in range(40)]
    pats += [("needle", "deny"), (" Abc ", "allow"), ("", "deny"), (None, "allow"), ("a%c%b", "deny"), ("zz", "allow"), ("q", "deny")]
    got = LK.matching_lists(spark.createDataFrame([(u,) for u in urls], "u string"), "u",
                            spark.createDataFrame(pats, "pattern string, list string")).collect()
    want = set()
    for u in {u.lower() for u in urls if u is not None}:
        for p, name in pats:
            p = (p or "").strip().lower()
            if p and re.search(".*".join(map(re.escape, p.split("%"))), u, re.S):
                want.add((u, name))
    assert sorted((r.value, r["list"]) for r in got) == sorted(want)


def test_cascade_needs_no_ids(spark):
    rows = [(None, "http://good.com/a", "<p>"), (None, "http://bad.com/a", "<p>"), (1, "http://bad.com/a", "<p>"),
            (1, "http://other.org/", ""), (2, None, "<p>"), (3, "https://google.com/x", None), (4, "http://other.org/", "<p>")]
    links = spark.createDataFrame(rows, "link_id long, url string, html string")
    lists = [spark.createDataFrame([(p,)], "pattern string") for p in ("good.com", "%bad%")]
    got = [(r.link_id, r.url, r.rule) for r in LK.policy_cascade(links, *lists).collect()]
    rules = ["allow", "deny", "deny", "no_html", "bad_url", "google", "model"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted([(i, u, r) for (i, u, _), r in zip(rows, rules)], key=key)
