"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.tables import load  # noqa: F401  (re-exported for the operators' queries)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def free_name(columns: list[str], base: str) -> str:
    """``base``, with as many underscores in front as make it unlike all columns in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def write_table(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts the lineage.

    With ``slim`` the last stage runs as no more tasks than the cluster has cores
    (for tables of a few numbers per row, which loops write again and again).

    A lost executor makes Spark run its tasks again; the committed table has
    every row once.
    """
    path = shared_path(df.sparkSession, name)
    if slim:
        df = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
