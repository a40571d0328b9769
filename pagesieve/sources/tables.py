"""Driver tables and the canonical tables derived from them (section 7.2).

Every derived table is a lazy DataFrame over the parquet inputs, so its work
grows with them; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels")


def slop_label(quality: F.Column) -> F.Column:
    """quality 0 -> Slop, 1 -> Non-Slop, anything else -> null."""
    return (F.when(quality == 0, F.lit(K.LABEL_SLOP))
            .when(quality == 1, F.lit(K.LABEL_NOT_SLOP))
            .otherwise(F.lit(None).cast("string")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical article table: documents left join labels.

    ``doc_id, website, domain, title, url, text, slop`` with website = source,
    domain = lang, title = first line, url = http://source/doc_id. ``labels`` is
    keyed by doc_id; the join is a shuffle join on doc_id (sizes grow together).
    """
    docs = documents(spark, sf_dir)
    labs = labels(spark, sf_dir).select("doc_id", "quality")
    return (docs.join(labs, "doc_id", "left")
            .select("doc_id",
                    F.col("source").alias("website"),
                    F.col("lang").alias("domain"),
                    F.split(F.col("text"), "\n", 2)[0].alias("title"),
                    F.concat(F.lit("http://"), F.col("source"), F.lit("/"),
                             F.col("doc_id").cast("string")).alias("url"),
                    "text",
                    slop_label(F.col("quality")).alias("slop")))


def train_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples ``(doc_id, text, label)``: label 1 = Slop, 0 = Non-Slop."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labs = labels(spark, sf_dir).where(F.col("quality").isin(0, 1))
    return docs.join(labs, "doc_id").select(
        "doc_id", "text", F.when(F.col("quality") == 0, 1).otherwise(0).cast("int").alias("label"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site catalog ``(website_name, url, domain, slop)`` from the documents.

    One row per source: its most frequent language is the domain (ties by
    name); the class is the majority label of its labelled documents.
    """
    a = articles(spark, sf_dir)
    per_dom = a.groupBy("website", "domain").agg(F.count("*").alias("n"))
    dom = per_dom.groupBy("website").agg(
        F.max_by("domain", F.struct(F.col("n"), F.col("domain"))).alias("domain"))
    cls = a.groupBy("website").agg(
        F.sum(F.when(F.col("slop") == K.LABEL_SLOP, 1).otherwise(0)).alias("n_slop"),
        F.sum(F.when(F.col("slop") == K.LABEL_NOT_SLOP, 1).otherwise(0)).alias("n_ok"))
    return dom.join(cls, "website").select(
        F.col("website").alias("website_name"),
        F.concat(F.col("website"), F.lit(".example.com")).alias("url"),
        "domain",
        F.when(F.col("n_slop") > F.col("n_ok"), F.lit(K.LABEL_SLOP))
        .otherwise(F.lit(K.LABEL_NOT_SLOP)).alias("slop"))
