"""Class and distribution reports (R1..R6): small aggregates over large tables.

All are ``groupBy`` aggregations with map-side partial aggregation, so the
shuffle carries one row per (task, group) no matter how large or skewed the
input is. Histogram edges come from a min/max aggregate joined back as a
one-row broadcast (its size is fixed: one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def class_counts(df: DataFrame, col: str = "slop") -> DataFrame:
    """Rows per class (missing class not counted, as ``value_counts``)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def domain_class_pivot(df: DataFrame, domain: str = "domain", col: str = "slop") -> DataFrame:
    """R2: domain x class counts, missing cells 0 (classes listed, so no extra pass)."""
    p = df.where(F.col(col).isNotNull()).groupBy(domain).pivot(
        col, [K.LABEL_NOT_SLOP, K.LABEL_SLOP]).count().na.fill(0)
    return p.select(domain, F.col(K.LABEL_NOT_SLOP).cast("long").alias("non_slop"),
                    F.col(K.LABEL_SLOP).cast("long").alias("slop"))


def equal_width_histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """``bins`` equal bins between min and max, last bin closed.

    The two edges are one scalar aggregate; they enter the bin expression as
    literals, so the histogram itself is one partial aggregation.
    """
    v = df.select(value.cast("double").alias("x")).where(F.col("x").isNotNull())
    r = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if r is None or r["lo"] is None:
        return v.select(F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("lower"),
                        F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi = float(r["lo"]), float(r["hi"])
    w = (hi - lo) / bins
    b = (F.lit(0) if hi == lo else
         F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(w)), F.lit(bins - 1))).cast("long")
    return v.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n")) \
        .select("bin", (F.lit(lo) + F.lit(w) * F.col("bin")).alias("lower"), "n")


def value_histogram(df: DataFrame, value: Column) -> DataFrame:
    """Counts per whole value."""
    return df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def mean_var(df: DataFrame, value: Column, by: str | None = None) -> DataFrame:
    """Mean and population variance (numpy ``var``, ddof 0)."""
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.count(value).alias("n"))


def rounded_histogram(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """Width-1 bins centred on whole numbers, floor(x + 0.5), per group of the columns ``by``."""
    by = by or []
    return df.select(*by, F.floor(value + F.lit(0.5)).cast("long").alias("bin")).groupBy(*by, "bin") \
        .agg(F.count("*").alias("n"))
