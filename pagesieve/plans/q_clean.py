"""Cleaning queries C1..C19 over the canonical article table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as CL
from ..sources import tables
from . import sqlparts as Q
from .common import round_doubles
from .registry import query

ART_CTE = """art AS (SELECT d.doc_id, d.source AS website, d.lang AS domain,
  split_part(d.text, chr(10), 1) AS title, 'http://' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS url,
  d.text, CASE WHEN l.quality = 0 THEN 'Slop' WHEN l.quality = 1 THEN 'Non-Slop' END AS slop
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

TRAIN_CTE = """tr AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS label
  FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1))"""

ART_COLS = ["doc_id", "website", "domain", "title", "url", "text", "slop"]


def _art(spark, sf_dir):
    return tables.articles(spark, sf_dir)


_C01 = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM art" for c in ART_COLS)


@query("c01_null_counts", f"WITH {ART_CTE} {_C01}")
def c01_null_counts(spark, sf_dir):
    return CL.null_counts(_art(spark, sf_dir)).select("column", F.col("n_null").cast("long").alias("n_null"))


@query("c02_rows_with_nulls", f"""WITH {ART_CTE}
SELECT doc_id FROM art WHERE {' OR '.join(f'{c} IS NULL' for c in ART_COLS)}""")
def c02_rows_with_nulls(spark, sf_dir):
    return CL.rows_with_nulls(_art(spark, sf_dir)).select("doc_id")


@query("c03_drop_missing_content", f"""WITH {ART_CTE}
SELECT doc_id FROM art WHERE text IS NOT NULL""")
def c03_drop_missing_content(spark, sf_dir):
    return CL.drop_missing(_art(spark, sf_dir)).select("doc_id")


@query("c04_fill_title", f"""WITH {ART_CTE}
SELECT doc_id, coalesce(title, website) AS title FROM art""")
def c04_fill_title(spark, sf_dir):
    return CL.fill_title(_art(spark, sf_dir)).select("doc_id", "title")


@query("c05_duplicate_count", f"""WITH {ART_CTE}
SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT text, count(*) AS n FROM art GROUP BY text)""")
def c05_duplicate_count(spark, sf_dir):
    return CL.duplicate_count(_art(spark, sf_dir), "text")


@query("c06_repeated_rows", f"""WITH {ART_CTE},
k AS (SELECT text FROM art GROUP BY text HAVING count(*) > 1)
SELECT doc_id FROM art WHERE EXISTS (SELECT 1 FROM k WHERE k.text IS NOT DISTINCT FROM art.text)""")
def c06_repeated_rows(spark, sf_dir):
    return CL.repeated_rows(_art(spark, sf_dir), "text", "doc_id").select("doc_id")


@query("c07_first_per_key", f"""WITH {ART_CTE}
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM art) WHERE rn = 1""")
def c07_first_per_key(spark, sf_dir):
    return CL.first_per_key(_art(spark, sf_dir), "text", "doc_id").select("doc_id")


@query("c08_min_length", f"""WITH {ART_CTE}
SELECT doc_id, length(text) AS n_chars FROM art WHERE length(text) >= 1000""")
def c08_min_length(spark, sf_dir):
    return CL.min_length(_art(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("c09_borderline_texts", f"""WITH {ART_CTE}
SELECT doc_id, length(text) AS n_chars FROM art WHERE length(text) >= 1000 AND length(text) < 1200""")
def c09_borderline_texts(spark, sf_dir):
    return CL.borderline(_art(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("c10_cast_to_string", f"""WITH {ART_CTE}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, website, domain, slop FROM art""")
def c10_cast_to_string(spark, sf_dir):
    return CL.cast_all_to_string(_art(spark, sf_dir).select("doc_id", "website", "domain", "slop"))


@query("c11_null_or_nan_cells", f"""WITH {ART_CTE},
lf AS (SELECT doc_id, length(text)::DOUBLE / NULLIF(length(title), 0) AS title_ratio, slop FROM art)
SELECT 'doc_id' AS "column", count(*) FILTER (WHERE doc_id IS NULL) AS n_bad FROM lf
UNION ALL SELECT 'title_ratio', count(*) FILTER (WHERE title_ratio IS NULL OR isnan(title_ratio)) FROM lf
UNION ALL SELECT 'slop', count(*) FILTER (WHERE slop IS NULL) FROM lf""")
def c11_null_or_nan_cells(spark, sf_dir):
    a = _art(spark, sf_dir)
    lf = a.select("doc_id", F.try_divide(F.length("text").cast("double"),
                                         F.when(F.length("title") != 0, F.length("title"))).alias("title_ratio"),
                  "slop")
    return CL.null_or_nan_cells(lf).select("column", F.col("n_bad").cast("long").alias("n_bad"))


@query("c12_label_binarize", f"""WITH {ART_CTE}
SELECT doc_id, CASE WHEN slop = 'Slop' THEN 1 ELSE 0 END AS label FROM art WHERE slop IN ('Slop', 'Non-Slop')""")
def c12_label_binarize(spark, sf_dir):
    ok, _ = CL.binarize(_art(spark, sf_dir))
    return ok.select("doc_id", F.col("label").cast("int").alias("label"))


@query("c12_label_quarantine", f"""WITH {ART_CTE}
SELECT doc_id FROM art WHERE slop IS NULL OR slop NOT IN ('Slop', 'Non-Slop')""")
def c12_label_quarantine(spark, sf_dir):
    _, bad = CL.binarize(_art(spark, sf_dir))
    return bad.select("doc_id")


def _lcp_sql(a: str, b: str) -> str:
    m = f"least(length({a}), length({b}))"
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE coalesce(nullif(list_position("
            f"list_transform(range(1, {m} + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)), false), 0) - 1, {m}) END)")


@query("c13_strip_shared_prefix", f"""WITH {ART_CTE},
nb AS (SELECT doc_id, website, text,
  lag(text) OVER (PARTITION BY website ORDER BY text, doc_id) AS prv,
  lead(text) OVER (PARTITION BY website ORDER BY text, doc_id) AS nxt FROM art),
pl AS (SELECT doc_id, website, text, greatest({_lcp_sql('text', 'prv')}, {_lcp_sql('text', 'nxt')}) AS prefix_len FROM nb)
SELECT doc_id, website, prefix_len, length(substr(text, prefix_len + 1)) AS rest_len FROM pl""")
def c13_strip_shared_prefix(spark, sf_dir):
    out = CL.strip_shared_prefix(_art(spark, sf_dir))
    return out.select("doc_id", "website", F.col("prefix_len").cast("long").alias("prefix_len"),
                      F.length("text").cast("long").alias("rest_len"))


# FIXED VALUES: the boilerplate strings removed from scraped articles.
BOILERPLATE = [
    "Get curated editors’ picks, peeks behind the scenes, film recommendations and more.",
    "science and spotlight its ripples in our lives and cultures",
    "Cutting-edge science, unraveled by the very brightest living thinkers",
    "© 2025 NautilusNext Inc., All rights reserved",
    "You’ve read your 2 free articles this month.Access unlimited ad-free stories, including this one, by becoming aNautilusmember",
    "Don’t limit your curiosity.Access unlimited ad-free stories like this one, and support independent journalism, by becoming aNautilusmember",
    "Literary and always interesting",
    "To read this story,sign up for the free Nautilus newsletter:science and culture for people who love beautiful writing.",
    "Sign up to receiveour biggest storiesas soon as they’re published",
    "Your donations allow us to invest in new open access titles and pay our",
    "bandwidth bills to ensure we keep our existing titles free to view",
    "amount, in any currency, is appreciated",
    "Many thanks! Donations are voluntary and not required to download the e-book -your link to download is below.",
    "support open access publishing",
    "E-IR is an independent non-profit publisher run by an all volunteer team.",
]


def _replace_chain_sql(expr: str, strings) -> str:
    out = expr
    for s in strings:
        out = f"replace({out}, {Q.lit(s)}, '')"
    return out


@query("c14_remove_boilerplate", f"""WITH {ART_CTE}
SELECT doc_id, length({_replace_chain_sql('text', BOILERPLATE)}) AS n_chars FROM art""")
def c14_remove_boilerplate(spark, sf_dir):
    a = _art(spark, sf_dir)
    return a.select("doc_id", F.length(CL.remove_substrings(F.col("text"), BOILERPLATE)).cast("long").alias("n_chars"))


@query("c16_equal_chunks", f"""WITH {ART_CTE},
ck AS (SELECT doc_id, slop, text, length(text) // 5 AS k FROM art WHERE length(text) >= 5)
SELECT doc_id, slop, i AS chunk_no, substr(text, i * k + 1, k) AS chunk
FROM (SELECT *, unnest(range(5)) AS i FROM ck)""")
def c16_equal_chunks(spark, sf_dir):
    out = CL.equal_chunks(_art(spark, sf_dir), 5, keep=["slop"])
    return out.select("doc_id", "slop", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


@query("c17_stratified_split", f"""WITH {TRAIN_CTE},
rk AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM tr)
SELECT doc_id, label, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM rk""")
def c17_stratified_split(spark, sf_dir):
    tr = tables.train_table(spark, sf_dir).select("doc_id", "label")
    return CL.split_train_test(tr, 0.2, 42, "doc_id", "label").select("doc_id", "label", "split")


@query("c18_random_split", f"""WITH {TRAIN_CTE},
rk AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
  count(*) OVER () AS n FROM tr)
SELECT doc_id, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM rk""")
def c18_random_split(spark, sf_dir):
    tr = tables.train_table(spark, sf_dir).select("doc_id")
    return CL.split_train_test(tr, 0.2, 42, "doc_id", None).select("doc_id", "split")


@query("c19_epoch_batches", f"""WITH {TRAIN_CTE},
rk AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3-' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM tr)
SELECT doc_id, (r - 1) // 32 AS batch_id FROM rk""")
def c19_epoch_batches(spark, sf_dir):
    tr = tables.train_table(spark, sf_dir).select("doc_id")
    return CL.epoch_batches(tr, epoch=3, batch_size=32).select("doc_id", "batch_id")


@query("c19_batch_sizes", f"""WITH {TRAIN_CTE},
rk AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3-' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM tr)
SELECT (r - 1) // 32 AS batch_id, count(*) AS n FROM rk GROUP BY 1""")
def c19_batch_sizes(spark, sf_dir):
    tr = tables.train_table(spark, sf_dir).select("doc_id")
    return CL.epoch_batches(tr, epoch=3, batch_size=32).groupBy("batch_id").agg(F.count("*").alias("n"))


_ = round_doubles
