"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a key's hash. All rows start in
one bucket of depth 0; a bucket over the byte limit splits on its next bit, the
others stay, until every bucket fits. A bucket whose rows all have one hash
cannot be split: it stays whole and is flagged ``oversize``.

Since a bucket's bytes never exceed its parent's, a row's shard is the shallowest
bucket on its path that fits. So one pass sums bytes per cell (a prefix a few
bits deeper than the expected depth), rolls the cells up to every shallower
depth and picks the first that fits; only rows of cells that are still too large
go to a further pass. Rows are shuffled as (id, hash, size), never with texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import llm_query
from .tables import load, write_table

BITS = 60
LIMIT = 1 << 20


def key_hash(key) -> F.Column:
    """The first 60 bits of the key's MD5 (as text); a null key counts as empty text."""
    hexed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _directory(rows: DataFrame, base: int, deep: int, limit: int) -> DataFrame:
    """For each cell of ``deep`` bits: the first depth from ``base`` on that fits, or null."""
    cells = rows.groupBy(F.expr(f"shiftright(h, {BITS - deep})").alias("cell")).agg(
        F.sum("size").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    paths = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
    nodes = (paths.groupBy("depth", "prefix")
             .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"),
                  F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
             .drop("lo", "hi"))
    return (paths.select("cell", "depth", "prefix").join(nodes, ["depth", "prefix"], "left")
            .groupBy("cell")
            .agg(F.min(F.when(F.col("shard_bytes").isNotNull(),
                              F.struct("depth", "prefix", "shard_bytes", "shard_rows"))).alias("leaf")))


def assign_shards(rows: DataFrame, key: str, size: F.Column, limit: int = LIMIT) -> DataFrame:
    """One row per input row: its key, its size and its shard.

    Columns: ``key, size, shard_id, depth, prefix, shard_bytes, shard_rows,
    oversize``. ``shard_id`` is ``2^depth + prefix``. Equal keys stay together;
    repeated rows count each time. A null size counts as 0, a null key as empty
    text. An empty table gives no row; other columns are left out. Only a shard
    that holds a single hash may exceed ``limit``; it has ``oversize`` true.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    left = write_table(rows.select(F.col(key).alias("key"), key_hash(key).alias("h"),
                                   F.coalesce(size, F.lit(0)).cast("long").alias("size")), "shard-rows")
    total = left.agg(F.sum("size")).first()[0] or 0
    done, base, deep = None, 0, min(BITS, 3 + math.ceil(math.log2(total / limit + 1)))
    while True:
        leaf = left.withColumn("cell", F.expr(f"shiftright(h, {BITS - deep})")).join(
            _directory(left, base, deep, limit), "cell", "left")
        leaf = write_table(leaf.select("key", "h", "size", "leaf.*"), f"shard-depth{deep}")
        fits = leaf.where(F.col("depth").isNotNull())
        done = fits if done is None else done.unionByName(fits)
        left = leaf.where(F.col("depth").isNull()).select("key", "h", "size")
        if left.isEmpty():
            break
        base, deep = deep + 1, min(BITS, deep + 4)
    return done.select(F.col("key").alias(key), "size",
                       F.expr("shiftleft(1L, depth) + prefix").alias("shard_id"),
                       "depth", "prefix", "shard_bytes", "shard_rows",
                       (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(rows: DataFrame, key: str, size: F.Column, path: str, limit: int = LIMIT) -> None:
    """Write ``rows`` to one folder per shard (``shard_id=...``) under ``path``; keys must be unique."""
    taken = set(rows.columns)
    if "shard_id" in taken:
        raise ValueError("rows already have a column shard_id")
    shards = assign_shards(rows, key, size, limit).select(F.col(key).alias("_shard_key"), "shard_id")
    (rows.join(shards, rows[key].eqNullSafe(shards["_shard_key"])).drop("_shard_key")
     .repartition("shard_id").write.partitionBy("shard_id").parquet(path))


SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
nodes AS (
  SELECT depth, h >> (60 - depth) AS prefix, CAST(sum(size) AS BIGINT) AS shard_bytes,
         count(*) AS shard_rows, min(h) AS lo, max(h) AS hi
  FROM d, range(0, 61) r(depth) GROUP BY ALL),
fit AS (SELECT * FROM nodes WHERE shard_bytes <= {LIMIT} OR lo = hi),
best AS (
  SELECT d.doc_id, d.h, d.size, min(fit.depth) AS depth
  FROM d JOIN fit ON fit.prefix = d.h >> (60 - fit.depth) GROUP BY ALL)
SELECT b.doc_id, b.size, (CAST(1 AS BIGINT) << f.depth) + f.prefix AS shard_id,
       CAST(f.depth AS INTEGER) AS depth, f.prefix, f.shard_bytes, f.shard_rows,
       f.shard_bytes > {LIMIT} AS oversize
FROM best b JOIN fit f ON f.depth = b.depth AND f.prefix = b.h >> (60 - b.depth)
"""


@llm_query("op7_sharding", SQL)
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard all documents by doc_id so that no shard holds over 1 MiB of text."""
    return assign_shards(load(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))
