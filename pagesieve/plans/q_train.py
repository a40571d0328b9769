"""Model queries that SQL can follow, on the initial model: scaler, embedding, init, forward, loss,
collapse (M1..M13), impact studies (E1..E5); dropout (M6) and the linear baseline (M17, M20)."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import lexical as LX
from ..operators import model as MD
from ..operators import ngrams as NG
from ..operators import regression as RG
from ..operators import training as TR
from ..session import write_shared
from ..sources import tables
from . import sqlparts as Q
from .common import round_doubles
from .q_clean import TRAIN_CTE
from .q_lexical import CHUNKS_SQL, _legacy_sql_feats
from .q_ngrams import _encode_sql, _tokens_sql, sql_bucket, sql_word_ngrams
from .registry import query

EMB = 4          # embedding width of the initial model, whose queries have SQL; q_trained has the trained one
SEED = 0
REG = 1e-4
NUM = K.NUM_COLUMNS


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


@functools.lru_cache(maxsize=4)
def init_W(emb: int = EMB, nf: int = len(NUM)) -> np.ndarray:
    return MD.init_dense(emb + nf, 2, SEED, xavier=True)


# --- Spark side shared inputs ------------------------------------------------------

def _train_docs(spark, sf_dir):
    return tables.train_table(spark, sf_dir)


def _doc_feats(spark, sf_dir, docs=None):
    docs = docs if docs is not None else _train_docs(spark, sf_dir)
    return FE.page_features(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))) \
        .withColumnRenamed("page_id", "doc_id")


# --- SQL side shared CTEs ----------------------------------------------------------

def _sql_normal(key: str) -> str:
    def u(suffix):
        return f"((('0x' || substr(md5({key} || '{suffix}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u(':a')})) * cos({dbl(2.0 * math.pi)} * {u(':b')}))"


def _sql_init(bucket: str, j: int) -> str:
    return f"(0.1 * {_sql_normal(f'{Q.lit(str(SEED) + ':v:')} || CAST({bucket} AS VARCHAR) || {Q.lit(':' + str(j))}')})"


_FEAT_EX = Q.feature_exprs()
DOCFEAT_CTE = (f"dpb AS (SELECT doc_id, coalesce(text, '') AS html, {Q.visible_text('text')} AS text FROM tr), "
               f"dpk AS (SELECT *, {Q.word_tokens('text')} AS toks FROM dpb), "
               f"dfe AS (SELECT doc_id, {', '.join(f'{_FEAT_EX[c]} AS {c}' for c in NUM)} FROM dpk), "
               f"scl AS (SELECT {', '.join(f'avg({c}) AS m_{c}, greatest(coalesce(stddev_pop({c}), 0.0), 1e-6) AS s_{c}' for c in NUM)} FROM dfe), "
               f"dz AS (SELECT doc_id, {', '.join(f'({c} - m_{c}) / s_{c} AS z_{c}' for c in NUM)} FROM dfe, scl)")

EMBED_CTE = (f"{_encode_sql('tr', 'doc_id', 'text', 3, 4, False)}, "
             "nw AS (SELECT doc_id, count(*) AS n_words FROM occ GROUP BY doc_id), "
             "pwid AS (SELECT doc_id, word_pos, count(*) AS n_ids_w FROM enc GROUP BY doc_id, word_pos), "
             "dbw AS (SELECT e.doc_id, e.bucket, sum(1.0::DOUBLE / (nw.n_words * pwid.n_ids_w)) AS w FROM enc e "
             "JOIN pwid USING (doc_id, word_pos) JOIN nw USING (doc_id) GROUP BY e.doc_id, e.bucket), "
             f"voc AS (SELECT bucket, {', '.join(f'{_sql_init('bucket', j)} AS e{j}' for j in range(EMB))} "
             "FROM (SELECT DISTINCT bucket FROM dbw)), "
             f"emb AS (SELECT doc_id, {', '.join(f'sum(w * e{j}) AS x{j}' for j in range(EMB))} "
             "FROM dbw JOIN voc USING (bucket) GROUP BY doc_id)")


def _sql_logit(k: int) -> str:
    W = init_W()
    cols = [f"coalesce(emb.x{j}, 0.0)" for j in range(EMB)] + [f"dz.z_{c}" for c in NUM]
    return "(0.0" + "".join(f" + {c} * {dbl(W[j, k])}" for j, c in enumerate(cols)) + ")"


PRED_CTE = (f"{TRAIN_CTE}, {DOCFEAT_CTE}, {EMBED_CTE}, "
            f"zz AS (SELECT tr.doc_id, tr.label, {_sql_logit(0)} AS z0, {_sql_logit(1)} AS z1 "
            "FROM tr JOIN dz USING (doc_id) LEFT JOIN emb USING (doc_id)), "
            "pr AS (SELECT doc_id, label, exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p0, "
            "exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p1 FROM zz)")


def _prepared(spark, sf_dir):
    """The labelled documents with all their n-gram ids, encoded once under their version's name."""
    docs = _train_docs(spark, sf_dir)
    return TR.prepared(spark, docs, TR.Inputs(masked=False))


def _embedded(prep):
    return TR.embed_by_word(prep, MD.init_vocab(TR.word_entries(prep), EMB, SEED), EMB)


def _predictions(spark, sf_dir):
    prep = _prepared(spark, sf_dir)
    dense = MD.Dense(init_W(), np.zeros(2), EMB, list(NUM))
    return MD.predict(MD.fused(prep.rows, _embedded(prep), dense), dense), dense


# --- queries -------------------------------------------------------------------------

@query("m01_fit_scaler", f"""WITH {TRAIN_CTE}, {DOCFEAT_CTE}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(m_{c}, 6) AS mu, round(s_{c}, 6) AS sigma FROM scl" for c in NUM)}""")
def m01_fit_scaler(spark, sf_dir):
    return round_doubles(MD.scaler_frame(_doc_feats(spark, sf_dir), NUM))


@query("m03_document_embedding", f"""WITH {TRAIN_CTE}, {EMBED_CTE}
SELECT doc_id, {', '.join(f'round(x{j}, 6) AS x{j}' for j in range(EMB))} FROM emb""")
def m03_document_embedding(spark, sf_dir):
    return round_doubles(_embedded(_prepared(spark, sf_dir)))


@query("m09_init_vocab", f"""WITH {TRAIN_CTE}, {EMBED_CTE}
SELECT bucket, {', '.join(f'round(e{j}, 6) AS e{j}' for j in range(EMB))} FROM voc""")
def m09_init_vocab(spark, sf_dir):
    return round_doubles(MD.init_vocab(TR.word_entries(_prepared(spark, sf_dir)), EMB, SEED))


@query("m12_class_probabilities", f"""WITH {PRED_CTE}
SELECT doc_id, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM pr""")
def m12_class_probabilities(spark, sf_dir):
    pr, _ = _predictions(spark, sf_dir)
    return round_doubles(pr.select("doc_id", "p0", "p1"))


def _sql_loss(where: str = "") -> str:
    reg = REG * float(np.abs(init_W()).sum())
    return (f"SELECT round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN p1 ELSE p0 END, 1e-15), 1 - 1e-15))) "
            f"+ {dbl(reg)}, 6) AS loss, count(*) AS n FROM pr {where}")


@query("m05_loss", f"WITH {PRED_CTE} {_sql_loss()}")
def m05_loss(spark, sf_dir):
    pr, dense = _predictions(spark, sf_dir)
    return round_doubles(MD.loss_frame(pr, dense, REG))


@query("m11_validation_loss", f"""WITH {PRED_CTE},
rk AS (SELECT doc_id, row_number() OVER (PARTITION BY label ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM tr),
te AS (SELECT doc_id FROM rk WHERE r <= ceil(0.2 * n))
{_sql_loss('WHERE doc_id IN (SELECT doc_id FROM te)')}""")
def m11_validation_loss(spark, sf_dir):
    pr, dense = _predictions(spark, sf_dir)
    split = CL.split_train_test(_train_docs(spark, sf_dir).select("doc_id", "label"), 0.2, 42, "doc_id", "label")
    te = split.where(F.col("split") == "test").select("doc_id")
    return round_doubles(MD.loss_frame(pr.join(te, "doc_id", "left_semi"), dense, REG))


MIN_FREQ = 3


@query("m13_collapse", f"""WITH {TRAIN_CTE}, tok AS (SELECT unnest({_tokens_sql('text')}) AS w FROM tr),
wc AS (SELECT w, count(*) AS n FROM tok GROUP BY w),
gc AS (SELECT unnest({sql_word_ngrams('w', 3, 4)}) AS ngram, n FROM wc),
g AS (SELECT ngram FROM gc GROUP BY ngram HAVING sum(n) >= {MIN_FREQ}),
gb AS (SELECT ngram, {sql_bucket('ngram')} AS bucket FROM g),
gv AS (SELECT ngram, {', '.join(f'{_sql_init('bucket', j)} AS e{j}' for j in range(EMB))} FROM gb)
SELECT ngram, {', '.join("round(" + ' + '.join(f'e{j} * {dbl(init_W()[j, c])}' for j in range(EMB)) + f", 6) + 0.0 AS u{c}" for c in (0, 1))} FROM gv""")
def m13_collapse(spark, sf_dir):
    """Collapse the embedding through the dense layer for the n-grams that the training texts hold often enough."""
    grams = NG.frequent_grams(_train_docs(spark, sf_dir), "text", 3, 4, MIN_FREQ)
    grams = NG.H.with_bucket(grams, "ngram", "bucket")
    dense = MD.Dense(init_W(), np.zeros(2), EMB, list(NUM))
    return round_doubles(MD.collapse(MD.init_vocab(grams, EMB, SEED), dense, grams))


# --- impact studies with the initial model ----------------------------------------------

def _diffs(spark, sf_dir):
    """Per distinct (word, gram) diffs, and the word counts: one scan of the texts."""
    words = _train_docs(spark, sf_dir).select(F.explode(NG.split_tokens(F.col("text"))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n_occ"))
    dense = MD.Dense(init_W(), np.zeros(2), EMB, list(NUM))
    return MD.word_gram_diffs(words, NG.H.word_ngrams(F.col("word"), 3, 4), MD.initial_diff(dense, SEED),
                              NG.H.DEFAULT_BUCKETS), words


def _wd_sql() -> str:
    W = init_W()
    return " + ".join(f"e{j} * {dbl(W[j, 1] - W[j, 0])}" for j in range(EMB))


DIFF_CTE = (f"{TRAIN_CTE}, {_encode_sql('tr', 'doc_id', 'text', 3, 4, False)}, "
            "de AS (SELECT DISTINCT doc_id, word_pos, ngram, bucket FROM enc), "
            f"dv AS (SELECT bucket, {', '.join(f'{_sql_init('bucket', j)} AS e{j}' for j in range(EMB))} FROM (SELECT DISTINCT bucket FROM de)), "
            f"diffs AS (SELECT de.doc_id, de.word_pos, de.ngram, occ.word, {_wd_sql()} AS diff "
            "FROM de JOIN dv USING (bucket) JOIN occ USING (doc_id, word_pos))")


@query("e01_gram_word_impact", f"""WITH {DIFF_CTE}
SELECT ngram, word, round(avg(diff), 6) + 0.0 AS impact, count(*) AS n FROM diffs GROUP BY ngram, word""")
def e01_gram_word_impact(spark, sf_dir):
    d, _ = _diffs(spark, sf_dir)
    return round_doubles(MD.gram_word_impact_weighted(d))


_BEST_SQL = (f"{DIFF_CTE}, imp AS (SELECT ngram, word, avg(diff) AS impact FROM diffs GROUP BY ngram, word), "
             "best AS (SELECT ngram, arg_min(word, (-round(abs(impact), 12), word)) AS word, "
             "arg_min(impact, (-round(abs(impact), 12), word)) AS impact FROM imp GROUP BY ngram)")


@query("e02_best_word_per_gram", f"""WITH {_BEST_SQL}
SELECT ngram, word, round(impact, 6) + 0.0 AS impact FROM best""")
def e02_best_word_per_gram(spark, sf_dir):
    d, _ = _diffs(spark, sf_dir)
    return round_doubles(MD.best_word_per_gram(MD.gram_word_impact_weighted(d)))


@query("e03_top_impacts", f"""WITH {_BEST_SQL}
SELECT ngram, word, round(impact, 6) + 0.0 AS impact FROM best ORDER BY round(abs(impact), 12) DESC, ngram LIMIT 100""")
def e03_top_impacts(spark, sf_dir):
    d, _ = _diffs(spark, sf_dir)
    return round_doubles(MD.top_impacts(MD.best_word_per_gram(MD.gram_word_impact_weighted(d)), 100))


@query("e04_gram_table", f"""WITH {DIFF_CTE},
g AS (SELECT ngram, avg(diff) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(diff) ELSE 0.0 END AS std,
      count(*) AS count FROM diffs GROUP BY ngram)
SELECT ngram, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, count, round(abs(mean), 6) AS abs_mean
FROM g ORDER BY round(abs(mean), 12) DESC, ngram LIMIT 50""")
def e04_gram_table(spark, sf_dir):
    d, _ = _diffs(spark, sf_dir)
    return round_doubles(MD.gram_table_weighted(d, 50))


@query("e05_word_strength", f"""WITH {DIFF_CTE},
po AS (SELECT doc_id, word_pos, sum(diff) AS s FROM diffs GROUP BY doc_id, word_pos),
aw AS (SELECT occ.word, coalesce(po.s, 0.0) AS s FROM occ LEFT JOIN po USING (doc_id, word_pos)),
w AS (SELECT word, avg(s) AS avg_strength, count(*) AS count FROM aw GROUP BY word)
SELECT word, round(avg_strength, 6) + 0.0 AS avg_strength, count, round(abs(avg_strength), 6) AS abs_strength
FROM w ORDER BY round(abs(avg_strength), 12) DESC, word LIMIT 50""")
def e05_word_strength(spark, sf_dir):
    d, words = _diffs(spark, sf_dir)
    return round_doubles(MD.word_strength_weighted(d, words, 50))


def _kept_sql() -> str:
    def u(j):
        return (f"(('0x' || substr(md5('0:0:0:' || CAST(doc_id AS VARCHAR) || ':c{j}'), 1, 8))::BIGINT + 0.5) "
                "/ 4294967296.0")
    n = EMB + len(NUM)
    return "(" + " + ".join(f"CASE WHEN {u(j)} >= 0.1 THEN 1.0 ELSE 0.0 END" for j in range(n)) + f") / {n}"


@query("m06_dropout_mask", f"WITH {TRAIN_CTE} SELECT doc_id, CAST({_kept_sql()} AS DOUBLE) AS kept_share FROM tr")
def m06_dropout_mask(spark, sf_dir):
    """M6: share of kept inputs per document under rate 0.1 (reproducible md5 mask)."""
    docs = _train_docs(spark, sf_dir).select("doc_id")
    keeps = [MD.dropout_keep(F.concat_ws(":", F.lit("0:0:0"), F.col("doc_id").cast("string"), F.lit(f"c{j}")), 0.1)
             for j in range(EMB + len(NUM))]
    return docs.select("doc_id", (sum((F.when(k > 0, 1).otherwise(0) for k in keeps), F.lit(0))
                                  / F.lit(len(keeps))).alias("kept_share"))


def _legacy_rows(spark, sf_dir):
    """Legacy features and class (0 = slop) of 5 chunks per article, written once."""
    t = tables.train_table(spark, sf_dir).select("doc_id", "text", LX.class_col(F.col("label")).alias("cls"))
    ck = CL.equal_chunks(t, 5, keep=["cls"])
    f = LX.legacy_features(F.col("chunk"))
    return write_shared(ck.select(*[f[k].cast("double").alias(k) for k in LX.LEGACY_FEATURES],
                                  F.when(F.col("cls") == "slop", 0.0).otherwise(1.0).alias("label")), "m17-rows")


@query("m17_linear_regression")
def m17_linear_regression(spark, sf_dir):
    """Ordinary least squares on the legacy features of 5 chunks per article."""
    return RG.least_squares(_legacy_rows(spark, sf_dir), LX.LEGACY_FEATURES, "label")


def _least_rss_sql() -> str:
    """Squares left of the label after each feature, one by one, is taken out of all later columns."""
    feats = _legacy_sql_feats("chunk")
    names = [f"f{i}" for i in range(len(feats))] + ["y"]
    raw = ", ".join(f"({e})::DOUBLE AS f{i}" for i, e in enumerate(feats.values()))
    ctes = [f"r AS MATERIALIZED (SELECT {raw}, CASE WHEN cls = 'slop' THEN 0.0 ELSE 1.0 END AS y FROM chunks)",
            f"c0 AS MATERIALIZED (SELECT {', '.join(f'{c} - (SELECT avg({c}) FROM r) AS {c}' for c in names)} FROM r)"]
    for i in range(len(feats)):
        q = f"f{i}"
        rest = names[i + 1:]
        square = f"(SELECT sum({q} * {q}) FROM c{i})"
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT " + ", ".join(
            f"CASE WHEN {square} > 1e-9 THEN {c} - {q} * (SELECT sum({q} * {c}) FROM c{i}) / {square} ELSE {c} END AS {c}"
            for c in rest) + f" FROM c{i})")
    return ", ".join(ctes)


@query("m17_least_squares_left", f"""WITH {CHUNKS_SQL}, {_least_rss_sql()}
SELECT (SELECT count(*) FROM r) AS n, round((SELECT sum(y * y) FROM c0), 5) AS squares,
  round((SELECT sum(y * y) FROM c{len(LX.LEGACY_FEATURES)}), 5) AS squares_left, 0.0::DOUBLE AS largest_moment""")
def m17_least_squares_left(spark, sf_dir):
    """The fit's residuals: their squares are the least possible, and no feature correlates with them."""
    rows = _legacy_rows(spark, sf_dir)
    left = RG.residual(RG.least_squares(rows, LX.LEGACY_FEATURES, "label"), LX.LEGACY_FEATURES, "label")
    moments = [F.abs(F.avg(F.col("left") * F.col(f))) for f in LX.LEGACY_FEATURES]
    return rows.withColumn("left", left).agg(
        F.count("*").alias("n"), F.round(F.var_pop("label") * F.count("*"), 5).alias("squares"),
        F.round(F.sum(F.col("left") ** 2), 5).alias("squares_left"),
        F.round(F.greatest(F.abs(F.avg("left")), *moments), 6).alias("largest_moment"))


@query("m20_coefficient_ranking")
def m20_coefficient_ranking(spark, sf_dir):
    """Fitted legacy coefficients ranked by absolute value."""
    c = m17_linear_regression(spark, sf_dir).where(F.col("feature") != "intercept")
    return c.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(F.desc("abs_coefficient"), "feature")
