"""Scoring and explanation queries: M2, M4, M14, M15, E7..E12, L11 and the flagship."""

from __future__ import annotations

import functools
import json

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns as P
from ..operators import explain as EX
from ..operators import links as LK
from ..operators import scoring as SC
from ..sources import model_io, tables
from . import sqlparts as Q
from .common import round_doubles
from .registry import query


@functools.lru_cache(maxsize=1)
def shipped() -> model_io.CollapsedModel:
    with open(model_io.SHIPPED_MODEL, encoding="utf-8") as f:
        return model_io.CollapsedModel.from_dict(json.load(f))


def _model(spark):
    return model_io.load_model(spark)


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def scored_sql_ctes(model: model_io.CollapsedModel, table: str = "pages") -> str:
    """CTEs ending in ``sc``: per page features, text part, logits, p, verdict, grams."""
    ex = Q.feature_exprs()
    feats = ", ".join(f"{ex[c]} AS {c}" for c in model.num_columns)
    uvals = ", ".join(f"({Q.lit(g)}, {dbl(v[0])}, {dbl(v[1])})" for g, v in sorted(model.u.items()))
    lens = ", ".join(f"({n})" for n in model.gram_lengths)

    def numeric(k):
        terms = [f"((({c})::FLOAT::DOUBLE - {dbl(model.mu[i])}) / {dbl(model.sigma[i])}) * "
                 f"{dbl(model.w_num[i][k])}" for i, c in enumerate(model.num_columns)]
        return " + ".join(terms)

    return f"""{Q.page_base_cte(table)},
u(ngram, u0, u1) AS (VALUES {uvals}),
lens(n) AS (VALUES {lens}),
mt AS (SELECT page_id, {Q.model_tokens('html')} AS toks FROM pb),
tw AS (SELECT page_id, unnest(toks) AS w, unnest(range(len(toks))) AS pos FROM mt),
subs AS (SELECT page_id, pos, substr(w, i::BIGINT, n::BIGINT) AS ngram
         FROM (SELECT page_id, pos, w, n, unnest(range(1, length(w) - n + 2)) AS i
               FROM tw JOIN lens ON length(w) >= n)),
pw AS (SELECT page_id, pos, avg(u0) AS w0, avg(u1) AS w1, list(DISTINCT s.ngram) AS g
       FROM subs s JOIN u USING (ngram) GROUP BY page_id, pos),
pp AS (SELECT page_id, sum(w0) AS s0, sum(w1) AS s1, count(*) AS n_hit,
              list_sort(list_distinct(flatten(list(g)))) AS grams FROM pw GROUP BY page_id),
tp AS (SELECT mt.page_id, len(mt.toks) AS n_words, coalesce(pp.n_hit, 0) AS n_hit_words,
              CASE WHEN len(mt.toks) > 0 THEN coalesce(pp.s0, 0.0) / len(mt.toks) ELSE 0.0 END AS text0,
              CASE WHEN len(mt.toks) > 0 THEN coalesce(pp.s1, 0.0) / len(mt.toks) ELSE 0.0 END AS text1,
              coalesce(pp.grams, []::VARCHAR[]) AS grams
       FROM mt LEFT JOIN pp USING (page_id)),
fe AS (SELECT page_id, html, text, {feats} FROM pk),
zz AS (SELECT fe.*, tp.n_words, tp.n_hit_words, tp.text0, tp.text1, tp.grams,
              tp.text0 + ({numeric(0)}) + {dbl(model.bias[0])} AS z0,
              tp.text1 + ({numeric(1)}) + {dbl(model.bias[1])} AS z1
       FROM fe JOIN tp USING (page_id)),
sc AS (SELECT *, exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p_not_slop,
              exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p_slop
       FROM zz),
sv AS (SELECT *, CASE WHEN p_slop > p_not_slop THEN 'slop' ELSE 'not slop' END AS verdict FROM sc)"""


def _scored(spark, sf_dir, keep=None):
    return SC.score_pages(tables.pages(spark, sf_dir), _model(spark), keep=keep)


# ---------------------------------------------------------------------------

_M = shipped()


@query("m14_page_score", f"""WITH {scored_sql_ctes(_M)}
SELECT page_id, round(text0, 6) AS text0, round(text1, 6) AS text1, n_words, n_hit_words,
       round(z0, 3) AS z0, round(z1, 3) AS z1, round(z1 - z0, 3) AS logit_diff,
       round(p_slop, 6) AS p_slop FROM sv""")
def m14_page_score(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("page_id", F.round("text0", 6).alias("text0"), F.round("text1", 6).alias("text1"),
                    F.col("n_words").cast("long").alias("n_words"),
                    F.col("n_hit_words").cast("long").alias("n_hit_words"),
                    F.round("z0", 3).alias("z0"), F.round("z1", 3).alias("z1"),
                    F.round(F.col("z1") - F.col("z0"), 3).alias("logit_diff"),
                    F.round("p_slop", 6).alias("p_slop"))


@query("m15_verdict", f"""WITH {scored_sql_ctes(_M)}
SELECT verdict, count(*) AS n_pages FROM sv GROUP BY verdict""")
def m15_verdict(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n_pages"))


def _std_sql(model):
    ex = Q.feature_exprs()
    cols = ", ".join(
        f"round(((({ex[c]})::FLOAT::DOUBLE - {dbl(model.mu[i])}) / {dbl(model.sigma[i])}), 3) AS z_{c}"
        for i, c in enumerate(model.num_columns))
    return f"WITH {Q.page_base_cte()} SELECT page_id, {cols} FROM pk"


@query("m02_standardize", _std_sql(_M))
def m02_standardize(spark, sf_dir):
    from ..operators.features import page_features
    m = _model(spark)
    f = page_features(tables.pages(spark, sf_dir))
    return f.select("page_id", *[F.round(SC.standardized(F.col(c), i, m), 3).alias(f"z_{c}")
                                 for i, c in enumerate(m.num_columns)])


@query("m04_softmax", f"""WITH {scored_sql_ctes(_M)}
SELECT page_id, round(p_not_slop, 6) AS p_not_slop, round(p_slop, 6) AS p_slop,
       round(p_not_slop + p_slop, 6) AS p_sum FROM sv""")
def m04_softmax(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("page_id", F.round("p_not_slop", 6).alias("p_not_slop"),
                    F.round("p_slop", 6).alias("p_slop"),
                    F.round(F.col("p_not_slop") + F.col("p_slop"), 6).alias("p_sum"))


def _host_sql(url: str) -> str:
    return f"nullif(lower(regexp_extract({url}, {Q.lit(LK.HOST)}, 1)), '')"


@query("flagship_host_scores", f"""WITH {scored_sql_ctes(_M).replace(
    'pb AS (SELECT page_id, coalesce(html', 'pb AS (SELECT page_id, url, coalesce(html')},
hs AS (SELECT {_host_sql('pb.url')} AS host, sv.* FROM sv JOIN pb USING (page_id))
SELECT host, count(*) AS n_pages, round(avg(p_slop), 6) AS avg_p_slop,
       round(avg(z1 - z0), 3) AS avg_logit_diff,
       sum(CASE WHEN verdict = 'slop' THEN 1 ELSE 0 END) AS n_slop
FROM hs GROUP BY host""")
def flagship_host_scores(spark, sf_dir):
    return host_scores(SC.score_pages(tables.pages(spark, sf_dir), _model(spark), keep=["url"]))


def host_scores(scored):
    """Per-host average slop probability and logit difference (map side partial agg)."""
    host = LK.host_of("url")
    return scored.groupBy(host.alias("host")).agg(
        F.count("*").alias("n_pages"),
        F.round(F.avg("p_slop"), 6).alias("avg_p_slop"),
        F.round(F.avg(F.col("z1") - F.col("z0")), 3).alias("avg_logit_diff"),
        F.sum(F.when(F.col("verdict") == "slop", 1).otherwise(0)).cast("long").alias("n_slop"))


# --- explanations -----------------------------------------------------------

def _feature_arr_sql(model, signed: bool) -> str:
    """SQL list of structs (pos, feature, value, cval) for one row of ``sv``."""
    items = []
    for i, c in enumerate(model.num_columns):
        delta = float(model.w_num[i][1]) - float(model.w_num[i][0])
        z = f"(({c})::FLOAT::DOUBLE - {dbl(model.mu[i])}) / {dbl(model.sigma[i])}"
        items.append(f"{{'pos': {i}, 'feature': {Q.lit(c)}, 'value': {c}, 'cval': ({z}) * {dbl(delta)}}}")
    return "[" + ", ".join(items) + "]"


@query("e07_plain_contributions", f"""WITH {scored_sql_ctes(_M)},
fx AS (SELECT page_id, unnest({_feature_arr_sql(_M, False)}) AS s FROM sv),
rk AS (SELECT page_id, s.feature AS feature, s.value AS value, abs(s.cval) AS contribution,
              row_number() OVER (PARTITION BY page_id ORDER BY abs(s.cval) DESC, s.pos) AS rank FROM fx)
SELECT page_id, rank, feature, round(contribution, 3) AS contribution FROM rk
WHERE rank <= 5 AND value <> 0""")
def e07_plain_contributions(spark, sf_dir):
    m = _model(spark)
    out = EX.plain_contributions(_scored(spark, sf_dir), m)
    return out.select("page_id", F.col("rank").cast("long").alias("rank"), "feature",
                      F.round("contribution", 3).alias("contribution"))


@query("e08_signed_contributions", f"""WITH {scored_sql_ctes(_M)},
fx AS (SELECT page_id, verdict, unnest({_feature_arr_sql(_M, True)}) AS s FROM sv),
sg AS (SELECT page_id, s.pos AS pos, s.feature AS feature, abs(s.cval) AS abs_c,
              CASE WHEN (s.cval > 0) = (verdict = 'slop') THEN abs(s.cval) ELSE -abs(s.cval) END AS signed FROM fx),
rk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY signed DESC, pos) AS rank FROM sg),
t5 AS (SELECT *, sum(abs_c) OVER (PARTITION BY page_id) AS tot FROM rk WHERE rank <= 5)
SELECT page_id, rank, feature, round(signed, 3) AS signed,
       round(abs_c / CASE WHEN tot = 0 THEN 1.0 ELSE tot END, 6) AS share,
       printf('%.2f', abs_c / CASE WHEN tot = 0 THEN 1.0 ELSE tot END) <> '0.00' AS shown FROM t5""")
def e08_signed_contributions(spark, sf_dir):
    m = _model(spark)
    out = EX.signed_contributions(_scored(spark, sf_dir), m)
    return out.select("page_id", F.col("rank").cast("long").alias("rank"), "feature",
                      F.round("signed", 3).alias("signed"), F.round("share", 6).alias("share"), "shown")


@query("e09_matched_grams", f"""WITH {scored_sql_ctes(_M)}
SELECT page_id, array_to_string(grams, ',') AS grams, len(grams) AS n_grams FROM sv""")
def e09_matched_grams(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("page_id", F.array_join("grams", ",").alias("grams"),
                    F.size("grams").cast("long").alias("n_grams"))


@query("e10_ranked_grams", f"""WITH {scored_sql_ctes(_M)},
gx AS (SELECT page_id, verdict, unnest(grams) AS ngram FROM sv),
gd AS (SELECT gx.page_id, gx.verdict, gx.ngram, u.u1 - u.u0 AS delta FROM gx JOIN u USING (ngram)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY abs(delta) DESC, ngram) AS r FROM gd),
sg AS (SELECT *, CASE WHEN (delta > 0) = (verdict = 'slop') THEN abs(delta) ELSE -abs(delta) END AS signed
       FROM r1 WHERE r <= 5)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY signed DESC, r) AS rank, ngram,
       round(delta, 6) AS delta, round(signed, 6) AS signed FROM sg""")
def e10_ranked_grams(spark, sf_dir):
    m = _model(spark)
    out = EX.ranked_grams(_scored(spark, sf_dir), m)
    return round_doubles(out.withColumn("rank", F.col("rank").cast("long")))


_PH = {
    "as_i_x_i_will_y": (P.PHRASE_AS_I_WILL_JAVA, P.PHRASE_AS_I_WILL_RE2),
    "i_x_that_is_not_y_but_z": (P.PHRASE_I_NOT_BUT_JAVA, P.PHRASE_I_NOT_BUT_RE2),
}


@query("e11_phrase_examples", f"""WITH {Q.page_base_cte()}
SELECT page_id,
  array_to_string(regexp_extract_all(text, {Q.lit(_PH['as_i_x_i_will_y'][1])}, 1)[1:3], ' | ') AS as_i_examples,
  array_to_string(regexp_extract_all(text, {Q.lit(_PH['i_x_that_is_not_y_but_z'][1])}, 1)[1:3], ' | ') AS i_not_examples
FROM pb""")
def e11_phrase_examples(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    return p.select("page_id",
                    F.array_join(EX.phrase_examples(F.col("html"), _PH["as_i_x_i_will_y"][0]), " | ")
                    .alias("as_i_examples"),
                    F.array_join(EX.phrase_examples(F.col("html"), _PH["i_x_that_is_not_y_but_z"][0]), " | ")
                    .alias("i_not_examples"))


def _report_sql(model) -> str:
    labels = {c: K.FEATURE_LABELS[c] for c in model.num_columns}
    lab_case = "CASE s.feature " + " ".join(
        f"WHEN {Q.lit(c)} THEN {Q.lit(l)}" + (
            f" || '(''' || array_to_string(regexp_extract_all(text, {Q.lit(_PH[c][1])}, 1)[1:3], ''', ''') || ''')'"
            if c in _PH else "")
        for c, l in labels.items()) + " END"
    return f"""WITH {scored_sql_ctes(model)},
fx AS (SELECT page_id, text, unnest({_feature_arr_sql(model, False)}) AS s FROM sv),
rk AS (SELECT page_id, s.value AS value, s.pos AS pos, {lab_case} AS label,
              row_number() OVER (PARTITION BY page_id ORDER BY abs(s.cval) DESC, s.pos) AS rank FROM fx),
rs AS (SELECT page_id, string_agg('\n- ' || label, '' ORDER BY rank) AS reasons
       FROM rk WHERE rank <= 5 AND value <> 0 GROUP BY page_id)
SELECT sv.page_id, verdict, round(p_not_slop, 6) AS p_not_slop, round(p_slop, 6) AS p_slop,
  'I think this is more likely ' || verdict || ' (P(not-slop)=' || printf('%.2f', p_not_slop)
  || ', P(slop)=' || printf('%.2f', p_slop) || ').\n'
  || coalesce('\nReasoning: ' || rs.reasons, '')
  || CASE WHEN len(grams) > 0 THEN '\n- Contains n-grams like '
       || array_to_string(list_transform(grams, lambda g: '''' || g || ''''), ', ') ELSE '' END AS report
FROM sv LEFT JOIN rs USING (page_id)"""


@query("e12_page_report", _report_sql(_M))
def e12_page_report(spark, sf_dir):
    m = _model(spark)
    s = SC.score_pages(tables.pages(spark, sf_dir), m, keep=["html"])
    return round_doubles(EX.report(s, m))


# --- bands ------------------------------------------------------------------

@query("l11_score_band", f"""WITH {scored_sql_ctes(_M)}
SELECT page_id, round(1.0 - p_slop, 6) AS ok_score,
  CASE WHEN 1.0 - p_slop < 0.15 THEN 'Slop!' WHEN 1.0 - p_slop < 0.3 THEN 'Risk'
       WHEN 1.0 - p_slop < 0.6 THEN 'Hmm' ELSE 'No Slop' END AS band FROM sv WHERE p_slop IS NOT NULL""")
def l11_score_band(spark, sf_dir):
    s = SC.with_band(_scored(spark, sf_dir).withColumn("ok_score", F.lit(1.0) - F.col("p_slop")), "ok_score")
    return s.select("page_id", F.round("ok_score", 6).alias("ok_score"), "band")
