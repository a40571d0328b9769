"""Link operators (L1..L13): anchors, url resolution, article-link ranking,
url policy lists and the scoring cascade.

Per-page work (L1..L6) is done inside each page row: anchors are extracted,
deduplicated by href with an in-row sort, scored and cut to the top N with
array functions. A page is one row, so the whole chain is map-only and no
link ever crosses an executor. Policy matching (L7..L10) is an equi-join of
url substrings with a pattern table of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns as P
from ..functions import text as T
from ..session import write_shared

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>.*?</a>"""
ANCHOR_HREF = r"""(?is)^<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
ANCHOR_INNER = r"""(?is)^<a\s[^>]*>(.*)</a>$"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def anchor_title(inner: Column) -> Column:
    """``get_text(strip=True)``: text pieces between tags, each stripped, joined."""
    return F.array_join(F.transform(F.split(inner, P.TAG, -1), T.py_strip), "")


def anchors(html) -> Column:
    """L1 raw: array<struct(pos, href, title)> of every ``<a href>`` in page order."""
    tags = T.extract_all(F.coalesce(_c(html), F.lit("")), ANCHOR)
    return F.transform(tags, lambda t, i: F.struct(
        i.alias("pos"), F.regexp_extract(t, ANCHOR_HREF, 1).alias("href"),
        anchor_title(F.regexp_extract(t, ANCHOR_INNER, 1)).alias("title")))


def dedup_by_href(arr: Column) -> Column:
    """L1: one entry per href at its first position, holding the last tag's title.

    Sort by (href, pos); the first of each run gives the position, the last of
    each run the title; the two filtered arrays are aligned run by run.
    """
    s = F.array_sort(F.transform(arr, lambda a: F.struct(
        a["href"].alias("href"), a["pos"].alias("pos"), a["title"].alias("title"))))
    n = F.size(s)
    firsts = F.filter(s, lambda x, i: (i == 0) | (F.element_at(s, F.greatest(i, F.lit(1))).getField("href") != x["href"]))
    lasts = F.filter(s, lambda x, i: (i == n - 1) | (F.element_at(s, F.least(i + 2, n)).getField("href") != x["href"]))
    merged = F.zip_with(firsts, lasts, lambda f, la: F.struct(
        f["pos"].alias("pos"), f["href"].alias("href"), la["title"].alias("title")))
    return F.array_sort(merged)


def fold_path(path: Column, relative: Column) -> Column:
    """A path without ``.`` and ``..`` segments; empty segments inside go if it came from a relative href."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    parts = F.filter(parts, lambda x, i: ~relative | (x != "") | (i == 0) | (i == n - 1))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(
        F.array_append(acc, x)))
    last = F.element_at(parts, -1)
    out = F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def resolve_url(base, href) -> Column:
    """L2: ``urljoin`` for absolute, ``//x``, ``/x``, ``#x``, ``?x``, empty and relative hrefs."""
    b, h = _c(base), _c(href)
    origin = F.regexp_extract(b, ORIGIN, 1)
    path = F.regexp_extract(b, PATH, 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    dir_ = F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)", 1)).otherwise(F.lit("/"))
    own = F.regexp_extract(h, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_replace(F.regexp_extract(h, r"(?s)^[^?#]*(.*)", 1), r"^\?(?=#|$)|#$", "")
    rooted = h.startswith("/")
    folded = fold_path(F.when(rooted, own).otherwise(F.concat(dir_, own)), ~rooted)
    return (F.when(h.rlike(SCHEME), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", b)
            .when(h.startswith("#"), F.concat(F.regexp_replace(b, "(?s)#.*$", ""), rest))
            .when(h.startswith("?"), F.concat(origin, path, rest))
            .otherwise(F.concat(origin, folded, rest)))


def _any(col: Column, words, op) -> Column:
    out = None
    for w in words:
        c = op(col, w)
        out = c if out is None else (out | c)
    return out


def article_score(href: Column, title: Column, full_url: Column, penalty: int = K.LINK_PENALTY) -> Column:
    """L3: len(url), minus a penalty per failed rule, plus one if it looks like an article."""
    pen = F.lit(penalty)
    zero = F.lit(0)
    ok_prefix = _any(href, K.LINK_PREFIXES_OK, lambda c, w: c.startswith(w))
    generic = (title == "") | F.lower(title).isin(K.GENERIC_TITLES)
    bad_end = _any(full_url, K.NON_ARTICLE_ENDINGS, lambda c, w: c.endswith(w))
    skip = _any(full_url, K.SKIP_KEYWORDS, lambda c, w: c.contains(w))
    social = _any(full_url, K.SOCIAL_DOMAINS, lambda c, w: c.contains(w))
    art = _any(full_url, K.ARTICLE_KEYWORDS, lambda c, w: c.contains(w))
    return (F.length(full_url)
            - F.when(~ok_prefix, pen).otherwise(zero)
            - F.when(generic, pen).otherwise(zero)
            - F.when(bad_end, pen).otherwise(zero)
            - F.when(skip, pen).otherwise(zero)
            - F.when(social, pen).otherwise(zero)
            + F.when(art, pen).otherwise(zero))


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """L1 + L2 + L3 as rows ``(page_id, pos, href, title, link, score)``."""
    arr = dedup_by_href(anchors(F.col(html_col)))
    scored = F.transform(arr, lambda a: F.struct(
        a["pos"].alias("pos"), a["href"].alias("href"), a["title"].alias("title"),
        resolve_url(F.col(url_col), a["href"]).alias("link")))
    scored = F.transform(scored, lambda a: F.struct(
        a["pos"].alias("pos"), a["href"].alias("href"), a["title"].alias("title"), a["link"].alias("link"),
        article_score(a["href"], a["title"], a["link"]).alias("score")))
    return pages.select(id_col, F.inline(scored))


def top_article_links(pages: DataFrame, n: int = 15, id_col: str = "page_id",
                      url_col: str = "url", html_col: str = "html") -> DataFrame:
    """L4: the ``n`` best links per page by score, ties in page order, in-row."""
    arr = dedup_by_href(anchors(F.col(html_col)))
    resolved = F.transform(arr, lambda a: F.struct(
        a["pos"].alias("pos"), a["href"].alias("href"), a["title"].alias("title"),
        resolve_url(F.col(url_col), a["href"]).alias("link")))
    # the resolved links are a column of their own, so each url is resolved once
    staged = pages.select(id_col, resolved.alias("_links"))
    ranked = F.transform(F.col("_links"), lambda a: F.struct(
        (-article_score(a["href"], a["title"], a["link"])).alias("neg"),
        a["pos"].alias("pos"), a["title"].alias("title"), a["link"].alias("link")))
    top = F.slice(F.array_sort(ranked), 1, n)
    out = F.transform(top, lambda a, i: F.struct(
        (i + 1).alias("rank"), a["title"].alias("title"), a["link"].alias("link"),
        (-a["neg"]).alias("score")))
    return staged.select(id_col, F.inline(out))


# --- legacy link rule (L5, L6) ----------------------------------------------

# FIXED VALUES: the legacy link rule's titles and skipped parts.
LEGACY_GENERIC_TITLES = ["Home", "About Us", "Contact Us", "Privacy Policy",
                         "Terms and Conditions", "Leave a comment", "Read more"]
LEGACY_SKIP = ["/category", "/tag", "/about", "/contact", "/home", "/privacy", "/terms",
               "/headlines", "/location", ".php", "/content", "/login", "email-protection",
               "/app", "/newsletter", "/author", "/press-room"]


def legacy_valid(link: Column, title: Column, root: Column) -> Column:
    """Title not generic, not blank; no skip part; under the root; not the root; title >= 20 chars."""
    return (~title.isin(LEGACY_GENERIC_TITLES) & title.rlike(P.NOT_S)
            & ~_any(link, LEGACY_SKIP, lambda c, w: c.contains(w))
            & (F.instr(link, root) > 0) & (link != root) & (F.length(title) >= 20))


def legacy_article_links(pages: DataFrame, n: int = 12, id_col: str = "page_id",
                         url_col: str = "url", html_col: str = "html") -> DataFrame:
    """First valid link per absolute url (tag order), then the ``n`` longest urls."""
    arr = F.transform(anchors(F.col(html_col)), lambda a: F.struct(
        resolve_url(F.col(url_col), a["href"]).alias("link"), a["pos"].alias("pos"),
        a["title"].alias("title")))
    valid = F.filter(arr, lambda a: legacy_valid(a["link"], a["title"], F.col(url_col)))
    firsts = dedup_first(valid)
    ranked = F.transform(firsts, lambda a: F.struct(
        (-F.length(a["link"])).alias("neg"), a["pos"].alias("pos"), a["link"].alias("link"),
        a["title"].alias("title")))
    top = F.slice(F.array_sort(ranked), 1, n)
    out = F.transform(top, lambda a, i: F.struct((i + 1).alias("rank"), a["link"].alias("link"),
                                                  a["title"].alias("title")))
    return pages.select(id_col, F.inline(out))


def dedup_first(arr: Column) -> Column:
    """Keep the first entry (lowest pos) per link, as struct(link, pos, title)."""
    s = F.array_sort(arr)
    return F.filter(s, lambda x, i: (i == 0) | (F.element_at(s, F.greatest(i, F.lit(1))).getField("link") != x["link"]))


# --- policy lists, cascade (L7..L10, L12, L13) --------------------------------

def host_of(url) -> Column:
    """Lower-cased host by pattern; null when there is none (browsers accept urls that strict parsers reject)."""
    return F.nullif(F.lower(F.regexp_extract(_c(url), HOST, 1)), F.lit(""))


def clean_list(lines: Column) -> Column:
    """Trim lines, drop blanks (an array column of raw lines)."""
    return F.filter(F.transform(lines, T.py_strip), lambda x: x != "")


def pattern_table(patterns: DataFrame, col: str = "pattern") -> DataFrame:
    """Normalize patterns: trimmed, lower-cased, blanks dropped; ``%`` -> regex."""
    p = F.lower(T.py_strip(F.col(col)))
    out = patterns.select(*[c for c in patterns.columns if c != col], p.alias("p")).where(F.col("p") != "")
    esc = F.regexp_replace(F.col("p"), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return out.select("*", F.col("p").contains("%").alias("wild"),
                      F.concat(F.lit("(?s)"), F.regexp_replace(esc, "%", ".*")).alias("rx"))


SEED = 3   # characters of a pattern's seed


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), _sub(c, n))).otherwise(
        F.array().cast("array<string>"))


def pattern_seeds(pat: DataFrame) -> DataFrame:
    """``(list, p, gram)``: the 3-gram of each pattern's longest literal piece that the fewest patterns hold.

    Pieces of one or two characters are their own seed.
    """
    grams = pat.where(F.length("piece") >= SEED).select(
        "list", "p", F.explode(F.array_distinct(_grams(F.col("piece"), SEED))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    best = grams.join(often, "gram").groupBy("list", "p").agg(F.min(F.struct("n", "gram")).alias("s"))
    short = pat.where(F.length("piece").between(1, SEED - 1)).select("list", "p", F.col("piece").alias("gram"))
    return best.select("list", "p", F.col("s.gram").alias("gram")).unionByName(short)


def matching_lists(values: DataFrame, value_col: str, patterns: DataFrame) -> DataFrame:
    """L7 as a relation: ``(value, list)`` for each distinct lower-cased value and list with a matching pattern.

    ``patterns`` has ``pattern, list``. A seed index: a value posts its distinct
    3-grams once, each with a hash of the value only; the postings meet the patterns
    of which they are the seed, and just these pairs are verified (substring, or the
    wildcard's regex). So no value meets every pattern, however many there are, and
    a repeated value is matched once.
    """
    pat = pattern_table(patterns)
    piece = F.get(F.array_sort(F.transform(F.filter(F.split(F.col("p"), "%", -1), lambda s: s != ""),
                                           lambda s: F.struct((-F.length(s)).alias("k"), s.alias("s")))), F.lit(0))
    pat = write_shared(pat.select("list", "p", "wild", "rx", F.coalesce(piece.getField("s"), F.lit("")).alias("piece"))
                       .distinct(), "pattern-table")
    bounds = pat.select(F.length("piece").alias("n"), "list").where(F.col("n") < SEED).distinct().collect()
    short = sorted({r.n for r in bounds if r.n})             # 1, 2 or none
    always = sorted({r.list for r in bounds if not r.n})     # lists with a pattern of only '%': they match everything
    v = values.select(F.lower(F.col(value_col)).alias("value")).where(F.col("value").isNotNull()).distinct()
    v = write_shared(v.withColumn("h", F.xxhash64("value")), "policy-values")
    posts = v.select("h", F.explode(F.array_distinct(F.flatten(F.array(*[
        _grams(F.col("value"), n) for n in (*short, SEED)])))).alias("gram"))
    pairs = posts.join(pattern_seeds(pat), "gram").select("h", "list", "p").distinct()
    checked = pairs.join(pat.select("list", "p", "wild", "rx"), ["list", "p"]).join(v, "h")
    hit = checked.where((F.col("wild") & F.rlike("value", F.col("rx"))) | (~F.col("wild") & F.contains("value", F.col("p"))))
    hit = hit.select("value", "list")
    for name in always:
        hit = hit.unionByName(v.select("value", F.lit(name).alias("list")))
    return hit.distinct()


def matching_keys(values: DataFrame, key: str, value_col: str, patterns: DataFrame) -> DataFrame:
    """Distinct ``key`` whose ``value_col`` matches any pattern."""
    hit = matching_lists(values, value_col, patterns.select("pattern", F.lit("").alias("list"))).select(
        F.col("value").alias("_lv"))
    return values.join(hit, F.lower(F.col(value_col)) == F.col("_lv"), "left_semi").select(key).distinct()


def tagged(allow: DataFrame, deny: DataFrame) -> DataFrame:
    """Both lists as ``pattern, list``."""
    return allow.select("pattern", F.lit("allow").alias("list")).unionByName(
        deny.select("pattern", F.lit("deny").alias("list")))


def _sub(c: Column, n: int):
    return lambda i: F.substring(c, i, n)


def effective_allow_list(spark: SparkSession, user: DataFrame, col: str = "pattern") -> DataFrame:
    """The user's allow list, or the built-in list when the user list is empty."""
    default = spark.createDataFrame([(p,) for p in K.DEFAULT_ALLOW_LIST], f"{col} string")
    one = user.select(F.lit(1).alias("_f")).limit(1)
    return user.select(col).unionByName(default.join(one, how="left_anti"))


def policy_cascade(links: DataFrame, allow: DataFrame, deny: DataFrame, id_col: str = "link_id",
                   url_col: str = "url", html_col: str = "html",
                   model_score: Column | None = None) -> DataFrame:
    """First hit wins: bad url 1; allow 1; deny 0; google.com 1; no html 1; else model.

    Both lists are matched in one pass over the distinct urls and hosts, whose
    hits are written and joined back by value, so rows need no id; the model score
    is only evaluated on rows that no earlier rule decided.
    """
    base = links.select(id_col, url_col, html_col,
                        host_of(url_col).alias("_host"), F.lower(F.col(url_col)).alias("_href"))
    values = base.select(F.explode(F.array("_href", "_host")).alias("_v"))
    hits = matching_lists(values, "_v", tagged(allow, deny)).groupBy("value").agg(
        F.bool_or(F.col("list") == "allow").alias("_a"), F.bool_or(F.col("list") == "deny").alias("_d"))
    hits = write_shared(hits, "policy-hits")
    j = base
    for c in ("_href", "_host"):
        j = j.join(hits.select(F.col("value").alias(c), F.col("_a").alias(f"_a{c}"), F.col("_d").alias(f"_d{c}")), c, "left")
    no = F.lit(False)
    j = j.withColumns({"_allow": F.coalesce("_a_href", no) | F.coalesce("_a_host", no),
                       "_deny": F.coalesce("_d_href", no) | F.coalesce("_d_host", no)})
    rule = (F.when(F.col("_host").isNull(), F.lit("bad_url"))
            .when(F.col("_allow"), F.lit("allow"))
            .when(F.col("_deny"), F.lit("deny"))
            .when(F.col("_href").contains(K.ALWAYS_OK_HOST_TEXT), F.lit("google"))
            .when(F.col(html_col).isNull() | (F.col(html_col) == ""), F.lit("no_html"))
            .otherwise(F.lit("model")))
    return j.select(id_col, url_col, html_col, rule.alias("rule"))


def links_worth_scoring(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                        html_col: str = "html") -> DataFrame:
    """Raw href starting with http, resolved url without google.com, once per page."""
    arr = anchors(F.col(html_col))
    res = F.transform(F.filter(arr, lambda a: a["href"].startswith("http")),
                      lambda a: resolve_url(F.col(url_col), a["href"]))
    keep = F.array_distinct(F.filter(res, lambda u: ~u.contains(K.ALWAYS_OK_HOST_TEXT)))
    return pages.select(id_col, F.explode(keep).alias("link"))
