"""Source and sink queries S1..S11."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..operators import ngrams as NG
from ..sources import csv_ranges as CR
from ..sources import files as FS
from ..sources import model_io, tables
from . import sqlparts as Q
from .q_clean import ART_CTE
from .common import round_doubles
from .q_model import _M
from .registry import query

SITES_CTE = """per_dom AS (SELECT source AS website, lang AS domain, count(*) AS n FROM documents GROUP BY 1, 2),
dom AS (SELECT website, arg_max(domain, (n, domain)) AS domain FROM per_dom GROUP BY website),
cls AS (SELECT website, count(*) FILTER (WHERE slop = 'Slop') AS n_slop, count(*) FILTER (WHERE slop = 'Non-Slop') AS n_ok
        FROM art GROUP BY website),
sites AS (SELECT dom.website AS website_name, dom.website || '.example.com' AS url, dom.domain,
          CASE WHEN n_slop > n_ok THEN 'Slop' ELSE 'Non-Slop' END AS slop FROM dom JOIN cls USING (website))"""


@query("s01_site_catalog", f"""WITH {ART_CTE}, {SITES_CTE}
SELECT website_name, url, domain, slop FROM sites""")
def s01_site_catalog(spark, sf_dir):
    return tables.sites(spark, sf_dir)


@query("s02_csv_roundtrip", f"""WITH {ART_CTE}
SELECT website, url, length(text) AS n_chars, slop FROM art""")
def s02_csv_roundtrip(spark, sf_dir):
    """Write the article table as CSV (quoted multi-line fields) to the shared folder, read it back."""
    a = tables.articles(spark, sf_dir).select(
        "website", "title", "url", F.col("text").alias("content"), "domain", "slop")
    path = shared_dir(spark, f"s02-{uuid.uuid4().hex}")
    FS.write_article_csv(a, path)
    back, _ = CR.read_csv_ranges(spark, path, FS.ARTICLE_CSV_SCHEMA)
    return back.select("website", "url", F.length("content").cast("long").alias("n_chars"), "slop")


@query("s02_csv_quarantine", f"""WITH {ART_CTE}
SELECT doc_id % 3 = 0 AS broken, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM art GROUP BY 1""")
def s02_csv_quarantine(spark, sf_dir):
    """CSV records of which a third, one field short, go to the quarantine and the others to the table."""
    a = tables.articles(spark, sf_dir).withColumnRenamed("text", "content")
    record = F.to_csv(F.struct("website", "title", "url", "content", "domain"), {"escape": '"', "quoteAll": "true"})
    last = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit(","), F.coalesce("slop", F.lit(""))))
    path = shared_dir(spark, f"s02-{uuid.uuid4().hex}")
    a.select(F.concat(record, last)).write.text(path)
    good, bad = CR.read_csv_ranges(spark, path, FS.ARTICLE_CSV_SCHEMA, header=False)
    short = F.from_csv("record", "website string, title string, url string, content string, domain string", {"escape": '"'})
    rows = good.select(F.lit(False).alias("broken"), F.length("content").alias("c")).unionByName(
        bad.select(F.lit(True).alias("broken"), F.length(short["content"]).alias("c")))
    return rows.groupBy("broken").agg(F.count("*").alias("n"), F.sum("c").cast("long").alias("n_chars"))


@query("s03_labelled_dataset", """SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS label,
  length(d.text) AS n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1)""")
def s03_labelled_dataset(spark, sf_dir):
    t = tables.train_table(spark, sf_dir)
    return t.select("doc_id", "label", F.length("text").cast("long").alias("n_chars"))


@query("s04_partitioned_save", f"""WITH {ART_CTE}
SELECT domain, count(*) AS n FROM art GROUP BY domain""")
def s04_partitioned_save(spark, sf_dir):
    """Append articles partitioned by domain to the shared folder, then count per partition."""
    path = shared_dir(spark, f"s04-{uuid.uuid4().hex}")
    FS.save_partitioned(tables.articles(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("domain").agg(F.count("*").alias("n"))


DONE_RULE = "length(text) < 200"


@query("s05_resume_sites", f"""WITH {ART_CTE}, {SITES_CTE},
done AS (SELECT DISTINCT website FROM art WHERE {DONE_RULE})
SELECT website_name, url, domain, slop FROM sites WHERE website_name NOT IN (SELECT website FROM done)""")
def s05_resume_sites(spark, sf_dir):
    """Sites still to fetch: the checkpoint holds the sites that already have a short article."""
    a = tables.articles(spark, sf_dir)
    done = a.where(F.length("text") < 200).select("website")
    return FS.remaining_sites(tables.sites(spark, sf_dir), done)


@query("s05_resume_after_stop", f"""WITH {ART_CTE}
SELECT website, domain, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM art GROUP BY 1, 2""")
def s05_resume_after_stop(spark, sf_dir):
    """Three runs over the sites: one commits a part, one stops before its commit, one saves what remains."""
    a, path = tables.articles(spark, sf_dir), shared_dir(spark, f"s05-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("website"), F.lit(3))
    FS.save_run(a.where(part == 0), path, "a")
    a.where(part == 1).write.partitionBy("domain").parquet(f"{path}/articles/run=b")
    done = FS.saved_sites(spark, path).select("website")
    FS.save_run(a.join(done, a["website"].eqNullSafe(done["website"]), "left_anti"), path, "c")
    saved = FS.read_saved(spark, path, a.schema)
    return saved.groupBy("website", "domain").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("s06_attach_catalog", f"""WITH {ART_CTE}, {SITES_CTE}
SELECT art.doc_id, art.website, sites.domain AS site_domain, sites.slop AS site_slop
FROM art JOIN sites ON art.website = sites.website_name""")
def s06_attach_catalog(spark, sf_dir):
    out = FS.attach_catalog(tables.articles(spark, sf_dir), tables.sites(spark, sf_dir))
    return out.select("doc_id", "website", "site_domain", "site_slop")


@query("s07_export_table", f"""WITH {ART_CTE}
SELECT website, domain, slop, title, url, NULL::VARCHAR AS html_text, length(text) AS text_len FROM art""")
def s07_export_table(spark, sf_dir):
    e = FS.export_table(tables.articles(spark, sf_dir))
    return e.select("website", "domain", "slop", "title", "url", "html_text",
                    F.length("text").cast("long").alias("text_len"))


_GRAM_VALUES = ", ".join(f"({Q.lit(g)}, CAST('{v[0]!r}' AS DOUBLE), CAST('{v[1]!r}' AS DOUBLE))"
                         for g, v in sorted(_M.u.items()))


@query("s08_model_relations", f"""WITH u(ngram, u0, u1) AS (VALUES {_GRAM_VALUES})
SELECT ngram, round(u0, 6) AS u0, round(u1, 6) AS u1, count(*) AS n_pages
FROM pages JOIN u ON contains(lower(html), ngram) GROUP BY ALL""")
def s08_model_relations(spark, sf_dir):
    """The model file as relations (n-gram table), joined to the pages that hold each gram.

    A gram is a part of one token, so the join is by equality on the tokens' substrings.
    """
    grams = model_io.model_relations(spark)["grams"]
    found = NG.allow_list_grams(tables.pages(spark, sf_dir), grams, "page_id", "html").select("page_id", "ngram").distinct()
    counts = found.groupBy("ngram").agg(F.count("*").alias("n_pages"))
    return round_doubles(grams.join(counts, "ngram").select("ngram", "u0", "u1", "n_pages"))


@query("s10_parse_site_lines", f"""WITH {ART_CTE}, {SITES_CTE},
ln AS (SELECT website_name || ' ' || url AS line FROM sites)
SELECT line, CASE WHEN contains(line, ' ') THEN regexp_extract(line, '^(.*) [^ ]*$', 1) ELSE '' END AS website_name,
  split_part(line, ' ', -1) AS url_parsed FROM ln""")
def s10_parse_site_lines(spark, sf_dir):
    s = tables.sites(spark, sf_dir).select(F.concat_ws(" ", "website_name", "url").alias("line"))
    return FS.parse_site_lines(s)


@query("s11_tag_and_union", f"""WITH {ART_CTE}
SELECT doc_id, 'slop' AS Type FROM art WHERE slop = 'Slop'
UNION ALL SELECT doc_id, 'human' FROM art WHERE slop = 'Non-Slop'""")
def s11_tag_and_union(spark, sf_dir):
    a = tables.articles(spark, sf_dir)
    return FS.tag_and_union({"slop": a.where(F.col("slop") == "Slop").select("doc_id"),
                             "human": a.where(F.col("slop") == "Non-Slop").select("doc_id")})
