"""Cleaning, dedup, filters and splits (C1..C19).

Skew: a duplicate key (a text copied many times, one site holding a third of
the rows) must not land in one task. Counts per key are partial aggregations
(map-side combine); "first row per key" is the least id per key joined back,
never a window over the hot key; text keys are grouped by a
256-bit digest. Exact splits rank rows by a hash inside small cells of it, so no
class is one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import write_shared


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, n_null)`` for every column, one pass."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return agg.unpivot([], df.columns, "column", "n_null")


def rows_with_nulls(df: DataFrame) -> DataFrame:
    """Rows holding any null."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns]))


def drop_missing(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows without content are dropped."""
    return df.dropna(subset=[col])


def fill_title(df: DataFrame, title: str = "title", fallback: str = "website") -> DataFrame:
    """C4: a missing title takes the site name."""
    return df.withColumn(title, F.coalesce(F.col(title), F.col(fallback)))


def digest(df: DataFrame, key: str) -> Column:
    """What equal keys are grouped by: the SHA-256 of a text (null stays null), else the key."""
    return F.sha2(F.col(key), 256) if isinstance(df.schema[key].dataType, T.StringType) else F.col(key)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """``(key digest, n)``: rows per key (nulls form one group, as pandas compares NaN equal here)."""
    return df.groupBy(digest(df, key).alias("_key")).agg(F.count("*").alias("n"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows that repeat an earlier key (all but the first of each key)."""
    return key_counts(df, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def repeated_rows(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Every row whose key occurs more than once.

    Keys are counted with a partial aggregation; the repeated keys are joined
    back (AQE splits a hot key on the large side).
    """
    rep = key_counts(df, key).where(F.col("n") > 1).select("_key")
    return df.join(rep, digest(df, key).eqNullSafe(F.col("_key")), "left_semi")


def first_per_key(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keep the first row (lowest id, i.e. file order; null ids last) per key, one row for each key.

    Rows of a key with one id (or none) are told apart by a hash of all their
    columns; of rows that are equal in all columns one stays. Only keys, ids and
    hashes are grouped, one row per key and task before the shuffle.
    """
    rows = df.withColumns({"_key": digest(df, key), "_hash": F.xxhash64(*df.columns)})
    order = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_hash").alias("hash")))
    firsts = rows.groupBy("_key").agg(order.alias("m")).select(
        F.col("_key").alias("_fkey"), F.col("m.id").alias("_fid"), F.col("m.hash").alias("_fhash"))
    kept = rows.join(firsts, rows["_key"].eqNullSafe(firsts["_fkey"]) & rows[id_col].eqNullSafe(firsts["_fid"])
                     & (rows["_hash"] == firsts["_fhash"]), "left_semi")
    return kept.dropDuplicates(["_key", id_col, "_hash"]).select(*df.columns)


def min_length(df: DataFrame, col: str = "text", n: int = 1000) -> DataFrame:
    """Keep texts of at least ``n`` characters."""
    return df.where(F.length(col) >= n)


def borderline(df: DataFrame, col: str = "text", lo: int = 1000, hi: int = 1200) -> DataFrame:
    """Kept texts below ``hi`` characters."""
    return min_length(df, col, lo).where(F.length(col) < hi)


def cast_all_to_string(df: DataFrame) -> DataFrame:
    """Every column as string (null stays null, D14)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def null_or_nan_cells(df: DataFrame) -> DataFrame:
    """C11: per column, cells that are null or NaN."""
    def bad(f):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return c.isNull() | F.isnan(c)
        return c.isNull()
    agg = df.agg(*[F.count_if(bad(f)).alias(f.name) for f in df.schema.fields])
    return agg.unpivot([], df.columns, "column", "n_bad")


def binarize(df: DataFrame, col: str = "slop") -> tuple[DataFrame, DataFrame]:
    """Slop -> 1, Non-Slop -> 0; other values go to a quarantine frame."""
    label = (F.when(F.col(col) == K.LABEL_SLOP, F.lit(1))
             .when(F.col(col) == K.LABEL_NOT_SLOP, F.lit(0)))
    x = df.withColumn("label", label)
    return x.where(F.col("label").isNotNull()), x.where(F.col("label").isNull()).drop("label")


def with_common_prefix_len(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: length of the longest common prefix of columns ``a`` and ``b``.

    Whole strings, no cap. Stage 1 compares 64-char blocks and finds the first
    differing block; stage 2 compares characters inside that block only. Each
    stage is its own projection, so no intermediate is re-evaluated per
    character: the cost is len/64 + 64 comparisons per pair.
    """
    ca, cb = F.col(a), F.col(b)
    x = df.withColumn(f"{out}_m", F.least(F.length(ca), F.length(cb)))
    m = F.col(f"{out}_m")
    nblk = F.floor(m / 64).cast("int")
    blk_eq = F.transform(F.sequence(F.lit(0), F.greatest(nblk - 1, F.lit(0))),
                         lambda k: F.substring(ca, k * 64 + 1, 64) == F.substring(cb, k * 64 + 1, 64))
    first_bad = F.array_position(blk_eq, False)
    x = x.withColumn(f"{out}_s", (F.when(nblk == 0, F.lit(0)).when(first_bad == 0, nblk)
                                  .otherwise(first_bad - 1) * 64).cast("int"))
    start = F.col(f"{out}_s")
    rest = F.least(F.lit(64), m - start)
    ch_eq = F.transform(F.sequence(F.lit(1), F.greatest(rest, F.lit(1))),
                        lambda i: F.substring(ca, start + i, 1) == F.substring(cb, start + i, 1))
    first_ch = F.array_position(ch_eq, False)
    tail = F.when(rest <= 0, F.lit(0)).when(first_ch == 0, rest).otherwise(first_ch - 1)
    x = x.withColumn(out, F.when(ca.isNull() | cb.isNull(), F.lit(0)).otherwise(start + tail))
    return x.drop(f"{out}_m", f"{out}_s")


RANGE_BYTES = 32 << 20


def strip_shared_prefix(df: DataFrame, group: str = "website", text: str = "text",
                        id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """Remove from each text the longest prefix it shares with another text of its site.

    In (site, text) order the best partner of a text is a neighbour. The order is
    cut into ranges of about ``RANGE_BYTES``, whatever the sites' sizes; neighbours
    inside a range are found by a window over the range, and only the first and last
    row of each range are joined to those of the ranges beside it. A null site is
    a site; a null text shares nothing.
    """
    spark = df.sparkSession
    rows = df.select(id_col, group, text)
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = write_shared(rows.repartitionByRange(ranges, group, text, id_col)
                         .withColumn("_r", F.spark_partition_id()), "prefix-ranges")
    w = Window.partitionBy("_r").orderBy(F.col(group), F.col(text), F.col(id_col))
    here = dealt.repartitionByRange(ranges, "_r")

    def beside(step):
        return F.when(step(group).over(w).eqNullSafe(F.col(group)), step(text).over(w))
    x = here.select(id_col, group, text, "_r", beside(F.lag).alias("_prev"), beside(F.lead).alias("_next"),
                    F.lag(F.lit(True)).over(w).isNull().alias("_first"), F.lead(F.lit(True)).over(w).isNull().alias("_last"))
    x = with_common_prefix_len(x, text, "_prev", "_lp")
    x = with_common_prefix_len(x, text, "_next", "_ln")
    x = write_shared(x.select(id_col, group, text, "_r", "_first", "_last",
                              F.greatest("_lp", "_ln").alias("prefix_len")), "prefix-inside")
    inner = x.where("not (_first or _last)")
    # Two rows a range: ranges with rows are numbered without gaps, then joined to the next and the last one.
    number = x.where("_first").select("_r", F.row_number().over(Window.orderBy("_r")).alias("_i"))
    edge = x.where("_first or _last").join(number, "_r")
    ends = edge.where("_last").select((F.col("_i") + 1).alias("_i"), F.lit(True).alias("_first"),
                                      F.col(group).alias("_pg"), F.col(text).alias("_prev"))
    heads = edge.where("_first").select((F.col("_i") - 1).alias("_i"), F.lit(True).alias("_last"),
                                        F.col(group).alias("_ng"), F.col(text).alias("_next"))
    edge = edge.join(ends, ["_i", "_first"], "left").join(heads, ["_i", "_last"], "left")
    edge = edge.withColumns({"_prev": F.when(F.col("_pg").eqNullSafe(F.col(group)), F.col("_prev")),
                             "_next": F.when(F.col("_ng").eqNullSafe(F.col(group)), F.col("_next"))})
    edge = with_common_prefix_len(edge, text, "_prev", "_lp")
    edge = with_common_prefix_len(edge, text, "_next", "_ln")
    edge = edge.withColumn("prefix_len", F.greatest("prefix_len", "_lp", "_ln"))
    return inner.select(id_col, group, text, "prefix_len").unionByName(
        edge.select(id_col, group, text, "prefix_len")).select(
        id_col, group, "prefix_len", F.expr(f"substring({text}, prefix_len + 1)").alias(text))


def remove_substrings(text: Column, strings: list[str]) -> Column:
    """C14: delete each listed string, in list order."""
    out = text
    for s in strings:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def equal_chunks(df: DataFrame, n: int = 5, text: str = "text", id_col: str = "doc_id",
                 keep: list[str] | None = None) -> DataFrame:
    """``n`` chunks of len // n chars each (tail dropped); texts shorter than n give none."""
    keep = keep or []
    k = F.floor(F.length(text) / n).cast("int")
    chunks = F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(i.alias("chunk_no"), F.substring(F.col(text), i * k + 1, k).alias("chunk"))))
    return df.select(id_col, *keep, F.inline_outer(chunks)).where(F.col("chunk_no").isNotNull())


def hash_order_key(seed: int | str, id_col: str, columns: list[str]) -> Column:
    """Reproducible random order: md5 of seed and id (also available in DuckDB); of a null id, of all columns."""
    return F.md5(F.concat(F.lit(str(seed)), F.coalesce(
        F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.xxhash64(*columns).cast("string")))))


CELL_DIGITS = 4


def exact_rank(df: DataFrame, group: str | None, key: Column, *ids: str, near: int = 0) -> DataFrame:
    """1-based rank of every row inside its group by (md5 ``key``, ids), exactly, at scale.

    Rows are counted per (group, first digits of the key); the running sum over a
    group's cells (65,536 at most) gives each cell's offset, and rows are ranked
    only inside their cell, so no group is one task. A null group is a group; a
    null ``key`` is ranked last. With ``near``, cells that begin within the same ``near`` ranks
    are ranked in one task, so a writer finds rows of near ranks together.
    """
    s = df.withColumns({"_g": F.col(group) if group else F.lit(0), "_k": F.coalesce(key, F.lit("~"))}).withColumn(
        "_cell", F.substring("_k", 1, CELL_DIGITS))
    cells = s.groupBy("_g", "_cell").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_g")
    cells = cells.withColumns({"_off": F.sum("_n").over(by.orderBy("_cell")) - F.col("_n"),
                               "group_size": F.sum("_n").over(by)}).select(
        F.col("_g").alias("_cg"), F.col("_cell").alias("_cc"), "_off", "group_size")
    if near and not group:
        cells = F.broadcast(cells)      # 65,536 rows at most
    out = s.join(cells, F.col("_g").eqNullSafe(F.col("_cg")) & (F.col("_cell") == F.col("_cc")))
    cell = ["_g", "_cell"]
    if near:
        out = out.withColumn("_run", F.floor(F.col("_off") / near)).repartition("_run")
        cell = ["_run", *cell]
    local = F.row_number().over(Window.partitionBy(*cell).orderBy("_k", *ids))
    return out.withColumn("rank_in_group", F.col("_off") + local).drop("_g", "_k", "_cell", "_cg", "_cc", "_off", "_run")


def split_train_test(df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "doc_id",
                     stratify: str | None = "label") -> DataFrame:
    """Exact reproducible split; ``ceil(test_size * n)`` rows per class go to test."""
    r = exact_rank(df, stratify, hash_order_key(seed, id_col, df.columns), id_col)
    is_test = F.col("rank_in_group") <= F.ceil(F.col("group_size") * F.lit(test_size))
    return r.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("rank_in_group", "group_size")


def epoch_batches(df: DataFrame, epoch: int, batch_size: int = 32, id_col: str = "doc_id", near: int = 0,
                  columns: list[str] | None = None) -> DataFrame:
    """The epoch's shuffle order cut into consecutive batches; ``near`` as in :func:`exact_rank`.

    Rows without an id are in the order of ``columns``, by default all.
    """
    r = exact_rank(df, None, hash_order_key(f"{epoch}-", id_col, columns or df.columns), id_col, near=near)
    return r.withColumn("batch_id", F.floor((F.col("rank_in_group") - 1) / batch_size).cast("long")) \
        .drop("rank_in_group", "group_size")
