"""Query registry: entries named after their inventory ID (some IDs share an entry or have two).

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the
operator is expressible in SQL, the DuckDB oracle text over the driver views.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query under ``name`` with its optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every plan module so that all queries register themselves."""
    from . import (q_clean, q_features, q_lexical, q_links,  # noqa: F401
                   q_model, q_ngrams, q_reports, q_sources, q_stream, q_text, q_train, q_trained)
    return REGISTRY
