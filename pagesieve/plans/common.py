"""Helpers shared by the query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, places: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (results are compared at fixed precision)."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), overrides.get(f.name, places)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
