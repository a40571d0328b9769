"""Link queries L1..L13 over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns as P
from ..operators import links as LK
from ..operators import scoring as SC
from ..sources import tables
from . import sqlparts as Q
from .q_model import _M, _model, scored_sql_ctes
from .registry import query

# --- SQL pieces ---------------------------------------------------------------

_STRIP = Q.lit(f"^{P.S}+|{P.S}+$")


def sql_fold(path: str, relative: str) -> str:
    parts = (f"list_filter(string_split({path}, '/'), lambda x, i: NOT {relative} OR x <> '' OR i = 1 "
             f"OR i = len(string_split({path}, '/')))")
    kept = (f"list_reduce({parts}, lambda acc, x: CASE WHEN x = '..' THEN acc[1:len(acc) - 1] "
            "WHEN x = '.' THEN acc ELSE list_append(acc, x) END, []::VARCHAR[])")
    tail = f"CASE WHEN ({parts})[-1] IN ('.', '..') THEN ['']::VARCHAR[] ELSE []::VARCHAR[] END"
    return f"'/' || regexp_replace(array_to_string(list_concat({kept}, {tail}), '/'), '^/', '')"


def sql_resolve(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, {Q.lit(LK.ORIGIN)}, 1)"
    path = f"regexp_extract({base}, {Q.lit(LK.PATH)}, 1)"
    scheme = f"regexp_extract({base}, {Q.lit('^([A-Za-z][A-Za-z0-9+.-]*):')}, 1)"
    dir_ = f"(CASE WHEN contains({path}, '/') THEN regexp_extract({path}, '^(.*/)', 1) ELSE '/' END)"
    own = f"regexp_extract({href}, '(?s)^([^?#]*)', 1)"
    rest = (f"regexp_replace(regexp_replace(regexp_extract({href}, '(?s)^[^?#]*(.*)', 1), '^\\?(#|$)', '\\1'), "
            "'#$', '')")
    rooted = f"starts_with({href}, '/')"
    folded = sql_fold(f"(CASE WHEN {rooted} THEN {own} ELSE {dir_} || {own} END)", f"(NOT {rooted})")
    return (f"(CASE WHEN regexp_matches({href}, {Q.lit(LK.SCHEME)}) THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} "
            f"WHEN {href} = '' THEN {base} "
            f"WHEN starts_with({href}, '#') THEN regexp_replace({base}, '(?s)#.*$', '') || {rest} "
            f"WHEN starts_with({href}, '?') THEN {origin} || {path} || {rest} "
            f"ELSE {origin} || {folded} || {rest} END)")


def anchors_cte() -> str:
    """``an(page_id, url, pos, href, title)``: every anchor of every page."""
    return f"""al AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), {Q.lit(LK.ANCHOR)}) AS l FROM pages),
atg AS (SELECT page_id, url, unnest(l) AS tag, unnest(range(len(l))) AS pos FROM al),
an AS (SELECT page_id, url, pos, regexp_extract(tag, {Q.lit(LK.ANCHOR_HREF)}, 1) AS href,
  array_to_string(list_transform(string_split_regex(regexp_extract(tag, {Q.lit(LK.ANCHOR_INNER)}, 1), {Q.lit(P.TAG)}),
    lambda x: regexp_replace(x, {_STRIP}, '', 'g')), '') AS title FROM atg)"""


def dedup_cte() -> str:
    return """dd AS (SELECT page_id, any_value(url) AS url, href, min(pos) AS pos, arg_max(title, pos) AS title
  FROM an GROUP BY page_id, href)"""


def _any_sql(expr: str, words, fn) -> str:
    return "(" + " OR ".join(fn(expr, Q.lit(w)) for w in words) + ")"


def sql_article_score(href: str, title: str, link: str) -> str:
    ok = _any_sql(href, K.LINK_PREFIXES_OK, lambda e, w: f"starts_with({e}, {w})")
    generic = f"({title} = '' OR lower({title}) IN {Q.in_list(K.GENERIC_TITLES)})"
    bad_end = _any_sql(link, K.NON_ARTICLE_ENDINGS, lambda e, w: f"ends_with({e}, {w})")
    skip = _any_sql(link, K.SKIP_KEYWORDS, lambda e, w: f"contains({e}, {w})")
    social = _any_sql(link, K.SOCIAL_DOMAINS, lambda e, w: f"contains({e}, {w})")
    art = _any_sql(link, K.ARTICLE_KEYWORDS, lambda e, w: f"contains({e}, {w})")
    p = K.LINK_PENALTY
    return (f"(length({link}) - CASE WHEN NOT {ok} THEN {p} ELSE 0 END - CASE WHEN {generic} THEN {p} ELSE 0 END "
            f"- CASE WHEN {bad_end} THEN {p} ELSE 0 END - CASE WHEN {skip} THEN {p} ELSE 0 END "
            f"- CASE WHEN {social} THEN {p} ELSE 0 END + CASE WHEN {art} THEN {p} ELSE 0 END)")


def host_sql(url: str) -> str:
    return (f"nullif(lower(regexp_extract({url}, "
            f"{Q.lit(LK.HOST)}, 1)), '')")


# --- L1..L6 -------------------------------------------------------------------

@query("l01_page_anchors", f"""WITH {anchors_cte()}, {dedup_cte()}
SELECT page_id, pos, href, title FROM dd""")
def l01_page_anchors(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", F.inline(LK.dedup_by_href(LK.anchors(F.col("html"))))) \
        .select("page_id", F.col("pos").cast("long").alias("pos"), "href", "title")


@query("l02_resolve_links", f"""WITH {anchors_cte()}
SELECT page_id, pos, {sql_resolve('url', 'href')} AS link FROM an""")
def l02_resolve_links(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", "url", F.inline(LK.anchors(F.col("html")))).select(
        "page_id", F.col("pos").cast("long").alias("pos"), LK.resolve_url(F.col("url"), F.col("href")).alias("link"))


@query("l03_article_score", f"""WITH {anchors_cte()}, {dedup_cte()},
rl AS (SELECT *, {sql_resolve('url', 'href')} AS link FROM dd)
SELECT page_id, pos, link, {sql_article_score('href', 'title', 'link')} AS score FROM rl""")
def l03_article_score(spark, sf_dir):
    return LK.page_links(tables.pages(spark, sf_dir)).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "link", F.col("score").cast("long").alias("score"))


@query("l04_top_article_links", f"""WITH {anchors_cte()}, {dedup_cte()},
rl AS (SELECT *, {sql_resolve('url', 'href')} AS link FROM dd),
sc AS (SELECT *, {sql_article_score('href', 'title', 'link')} AS score FROM rl),
rk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM sc)
SELECT page_id, rank, title, link, score FROM rk WHERE rank <= 15""")
def l04_top_article_links(spark, sf_dir):
    out = LK.top_article_links(tables.pages(spark, sf_dir), n=15)
    return out.select("page_id", F.col("rank").cast("long").alias("rank"), "title", "link",
                      F.col("score").cast("long").alias("score"))


def _legacy_valid_sql(link, title, root):
    skip = _any_sql(link, LK.LEGACY_SKIP, lambda e, w: f"contains({e}, {w})")
    return (f"(NOT {title} IN {Q.in_list(LK.LEGACY_GENERIC_TITLES)} AND regexp_matches({title}, {Q.lit(P.NOT_S)}) "
            f"AND NOT {skip} AND contains({link}, {root}) AND {link} <> {root} AND length({title}) >= 20)")


@query("l05_legacy_valid_links", f"""WITH {anchors_cte()},
rl AS (SELECT *, {sql_resolve('url', 'href')} AS link FROM an)
SELECT page_id, pos, link, {_legacy_valid_sql('link', 'title', 'url')} AS valid FROM rl""")
def l05_legacy_valid_links(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    a = p.select("page_id", "url", F.inline(LK.anchors(F.col("html"))))
    link = LK.resolve_url(F.col("url"), F.col("href"))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"), link.alias("link"),
                    LK.legacy_valid(link, F.col("title"), F.col("url")).alias("valid"))


@query("l06_legacy_article_links", f"""WITH {anchors_cte()},
rl AS (SELECT *, {sql_resolve('url', 'href')} AS link FROM an),
va AS (SELECT * FROM rl WHERE {_legacy_valid_sql('link', 'title', 'url')}),
fi AS (SELECT page_id, link, min(pos) AS pos, arg_min(title, pos) AS title FROM va GROUP BY page_id, link),
rk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(link) DESC, pos) AS rank FROM fi)
SELECT page_id, rank, link, title FROM rk WHERE rank <= 12""")
def l06_legacy_article_links(spark, sf_dir):
    out = LK.legacy_article_links(tables.pages(spark, sf_dir), n=12)
    return out.select("page_id", F.col("rank").cast("long").alias("rank"), "link", "title")


# --- policy (L7..L10, L12, L13) -------------------------------------------------

def policy_lists(spark, sf_dir):
    """Allow and deny lists derived from the page hosts.

    allow: every ``www.`` host (plain substring patterns);
    deny: ``%<first label>%`` wildcard for hosts whose first label holds a dash.
    """
    p = tables.pages(spark, sf_dir).select(LK.host_of("url").alias("host")).where(F.col("host").isNotNull())
    allow = p.where(F.col("host").startswith("www.")).select(F.col("host").alias("pattern")).distinct()
    first = F.split(F.col("host"), r"\.", 2)[0]
    deny = p.where(first.contains("-")).select(
        F.concat(F.lit("%"), first, F.lit("%")).alias("pattern")).distinct()
    return allow, deny


_POLICY_SQL = f"""hosts AS (SELECT DISTINCT {host_sql('url')} AS host FROM pages WHERE {host_sql('url')} IS NOT NULL),
allow_raw AS (SELECT DISTINCT host AS pattern FROM hosts WHERE starts_with(host, 'www.')),
deny_raw AS (SELECT DISTINCT '%' || split_part(host, '.', 1) || '%' AS pattern FROM hosts
             WHERE contains(split_part(host, '.', 1), '-')),
dflt AS (SELECT unnest({'[' + ', '.join(Q.lit(x) for x in K.DEFAULT_ALLOW_LIST) + ']'}) AS pattern),
allow_eff AS (SELECT pattern FROM allow_raw UNION ALL SELECT pattern FROM dflt WHERE NOT EXISTS (SELECT 1 FROM allow_raw)),
np AS (SELECT 'allow' AS list, lower(regexp_replace(pattern, {_STRIP}, '', 'g')) AS p FROM allow_eff
       UNION ALL SELECT 'deny', lower(regexp_replace(pattern, {_STRIP}, '', 'g')) FROM deny_raw),
pt AS (SELECT list, p, contains(p, '%') AS wild,
       '(?s)' || replace(regexp_replace(p, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '%', '.*') AS rx
       FROM np WHERE p <> ''),
lk AS (SELECT page_id, url, html, {host_sql('url')} AS host, lower(url) AS href FROM pages),
kv AS (SELECT page_id, href AS v FROM lk UNION ALL SELECT page_id, host FROM lk WHERE host IS NOT NULL),
hits AS (SELECT DISTINCT kv.page_id, pt.list FROM kv JOIN pt
         ON (CASE WHEN pt.wild THEN regexp_matches(lower(kv.v), pt.rx) ELSE contains(lower(kv.v), pt.p) END)),
cas AS (SELECT lk.page_id, lk.url, CASE WHEN host IS NULL THEN 'bad_url'
          WHEN EXISTS (SELECT 1 FROM hits h WHERE h.page_id = lk.page_id AND h.list = 'allow') THEN 'allow'
          WHEN EXISTS (SELECT 1 FROM hits h WHERE h.page_id = lk.page_id AND h.list = 'deny') THEN 'deny'
          WHEN contains(href, {Q.lit(K.ALWAYS_OK_HOST_TEXT)}) THEN 'google'
          WHEN html IS NULL OR html = '' THEN 'no_html' ELSE 'model' END AS rule FROM lk)"""


@query("l07_like_match", f"""WITH {_POLICY_SQL}
SELECT host, list, count(*) AS n FROM hits JOIN lk USING (page_id) GROUP BY host, list""")
def l07_like_match(spark, sf_dir):
    allow, deny = policy_lists(spark, sf_dir)
    allow = LK.effective_allow_list(spark, allow)
    p = tables.pages(spark, sf_dir)
    rows = p.select("page_id", LK.host_of("url").alias("host"), F.lower("url").alias("href"))
    rows = rows.select("page_id", "host", F.explode(F.array("href", "host")).alias("value"))
    hits = LK.matching_lists(rows, "value", LK.tagged(allow, deny))
    return rows.join(hits, "value").select("page_id", "host", "list").distinct().groupBy("host", "list").agg(
        F.count("*").alias("n"))


@query("l08_url_host", f"""SELECT page_id, {host_sql('url')} AS host FROM pages""")
def l08_url_host(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", LK.host_of("url").alias("host"))


def _cascade(spark, sf_dir):
    allow, deny = policy_lists(spark, sf_dir)
    allow = LK.effective_allow_list(spark, allow)
    p = tables.pages(spark, sf_dir)
    return LK.policy_cascade(p, allow, deny, id_col="page_id")


@query("l09_policy_cascade", f"""WITH {_POLICY_SQL}
SELECT page_id, rule FROM cas""")
def l09_policy_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir).select("page_id", "rule")


@query("l09_policy_score", f"""WITH {_POLICY_SQL},
{scored_sql_ctes(_M)}
SELECT cas.page_id, cas.rule, round(CASE rule WHEN 'bad_url' THEN 1.0 WHEN 'allow' THEN 1.0 WHEN 'deny' THEN 0.0
  WHEN 'google' THEN 1.0 WHEN 'no_html' THEN 1.0 ELSE 1.0 - sv.p_slop END, 6) AS score
FROM cas LEFT JOIN sv USING (page_id)""")
def l09_policy_score(spark, sf_dir):
    """The full cascade: listed links never meet the model; the rest are scored."""
    cas = _cascade(spark, sf_dir)
    decided = cas.where(F.col("rule") != "model").select(
        "page_id", "rule", F.when(F.col("rule") == "deny", F.lit(0.0)).otherwise(F.lit(1.0)).alias("score"))
    to_score = cas.where(F.col("rule") == "model").select("page_id", "html")
    scored = SC.score_pages(to_score, _model(spark)).select(
        "page_id", F.lit("model").alias("rule"), (F.lit(1.0) - F.col("p_slop")).alias("score"))
    return decided.unionByName(scored).select("page_id", "rule", F.round("score", 6).alias("score"))


@query("l10_effective_allow_list", f"""WITH {_POLICY_SQL}
SELECT pattern FROM allow_eff""")
def l10_effective_allow_list(spark, sf_dir):
    allow, _ = policy_lists(spark, sf_dir)
    return LK.effective_allow_list(spark, allow)


@query("l12_links_worth_scoring", f"""WITH {anchors_cte()},
rl AS (SELECT page_id, {sql_resolve('url', 'href')} AS link FROM an WHERE starts_with(href, 'http'))
SELECT DISTINCT page_id, link FROM rl WHERE NOT contains(link, {Q.lit(K.ALWAYS_OK_HOST_TEXT)})""")
def l12_links_worth_scoring(spark, sf_dir):
    return LK.links_worth_scoring(tables.pages(spark, sf_dir))


@query("l13_list_lines", f"""SELECT item_id, line FROM (SELECT item_id,
  unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {_STRIP}, '', 'g'))) AS line
  FROM benchmark) WHERE line <> ''""")
def l13_list_lines(spark, sf_dir):
    b = tables.load(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(LK.clean_list(F.split(F.col("text"), "\n", -1))).alias("line"))
