"""Source and sink operators (S1..S11) as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..session import is_written

ARTICLE_CSV_SCHEMA = T.StructType([
    T.StructField("website", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("slop", T.StringType()),
])

EXPORT_ORDER = ["website", "domain", "slop", "title", "url", "html_text", "text"]


def read_article_csv(spark: SparkSession, path: str, schema: T.StructType = ARTICLE_CSV_SCHEMA,
                     keep_corrupt: bool = False) -> DataFrame:
    """S2 for small files: a file is one task (``csv_ranges`` splits it). Quoted multi-line
    fields of any size; malformed rows skipped (or kept apart in ``_corrupt`` when ``keep_corrupt``)."""
    r = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
         .option("escape", '"').option("encoding", "UTF-8"))
    if keep_corrupt:
        s = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
        return r.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return r.schema(schema).option("mode", "DROPMALFORMED").csv(path)


def write_article_csv(df: DataFrame, path: str) -> None:
    """The CSV form read by ``read_article_csv`` (quotes doubled, header)."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save_partitioned(df: DataFrame, path: str, by: str = "domain", mode: str = "append") -> None:
    """Append records partitioned by ``by`` (no whole-file rewrite per site)."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def save_run(articles: DataFrame, path: str, run: str, by: str = "domain", site: str = "website") -> None:
    """The articles of one run, then the list of its sites, then its commit.

    Nothing of a run counts before its commit, one row written last. A run that
    stopped earlier, at any place, leaves files that no reader takes; the next run
    needs a new name. ``path`` is a folder that the cluster shares.
    """
    spark = articles.sparkSession
    folder = f"{path}/articles/run={run}"
    articles.write.partitionBy(by).parquet(folder)
    saved = spark.read.schema(articles.schema).parquet(folder)
    saved.groupBy(site).agg(F.count("*").alias("n_articles")).write.parquet(f"{path}/sites/run={run}")
    commit_run(spark, path, run)


def commit_run(spark: SparkSession, path: str, run: str) -> None:
    """The last step of a run: its one row in the commit log."""
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def saved_sites(spark: SparkSession, path: str, site_type: str = "string", site: str = "website") -> DataFrame:
    """``site, run, n_articles`` of the committed runs; of a site that several runs saved, the run of least name."""
    schema = f"{site} {site_type}, n_articles long, run string"
    if not is_written(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    done = spark.read.schema("run string").parquet(f"{path}/commits").distinct()
    sites = spark.read.schema(schema).parquet(f"{path}/sites").join(done, "run", "left_semi")
    return sites.groupBy(site).agg(F.min("run").alias("run"), F.min_by("n_articles", "run").alias("n_articles"))


def read_saved(spark: SparkSession, path: str, schema: T.StructType, site: str = "website") -> DataFrame:
    """Each committed site's articles once (a null site counts as one more site)."""
    own = saved_sites(spark, path, schema[site].dataType.simpleString(), site).select(
        F.col(site).alias("_site"), F.col("run").alias("_run"))
    if not is_written(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).parquet(f"{path}/articles")
    return rows.join(own, rows["run"].eqNullSafe(own["_run"]) & rows[site].eqNullSafe(own["_site"]), "left_semi").select(
        *[F.col(f"`{c}`") for c in schema.names])


def remaining_sites(sites: DataFrame, done: DataFrame, key: str = "website_name",
                    done_key: str = "website") -> DataFrame:
    """Sites not yet in the checkpoint (anti join on the distinct done keys)."""
    d = done.select(F.col(done_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return sites.join(d, key, "left_anti")


def attach_catalog(articles: DataFrame, sites: DataFrame, site_limit: int = 1_000_000) -> DataFrame:
    """Give every article its site's name, domain and class.

    The catalog is broadcast only after its row count is checked; a larger
    catalog joins by shuffle.
    """
    cat = sites.select(F.col("website_name").alias("website"), F.col("domain").alias("site_domain"),
                       F.col("slop").alias("site_slop"))
    n = cat.count()
    c = F.broadcast(cat) if n <= site_limit else cat
    return articles.join(c, "website")


def export_table(articles: DataFrame) -> DataFrame:
    """The published article table in its fixed column order."""
    return articles.select(*[F.col(c) if c in articles.columns else F.lit(None).cast("string").alias(c)
                             for c in EXPORT_ORDER])


def parse_site_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """name = all but the last blank-split word, url = the last word."""
    s = TX.py_strip(F.col(col))
    has_space = s.contains(" ")
    name = F.when(has_space, F.regexp_extract(s, r"^(.*) [^ ]*$", 1)).otherwise(F.lit(""))
    url = F.substring_index(s, " ", -1)
    return lines.select("*", name.alias("website_name"), url.alias("url_parsed"))


def tag_and_union(frames: dict[str, DataFrame], col: str = "Type") -> DataFrame:
    """Stack class frames, each tagged with its type."""
    out = None
    for t, df in frames.items():
        x = df.withColumn(col, F.lit(t))
        out = x if out is None else out.unionByName(x)
    return out
