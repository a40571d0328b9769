"""Corpus pipeline: documents in, packed training sequences out.

Each stage gets all documents that its predecessor kept, its result is written as
Parquet in the cluster's shared folder and read again for the next one. All but
the last return the columns of ``documents``:

1. language: rows without an identified language go;
2. near duplicates: one document of each group stays;
3. secrets: found secrets are masked in the text, no row goes;
4. packing: the documents' pieces with their places in sequences of 1024 tokens.

Null texts count as texts without letters, so stage 1 drops them; an empty table
passes through as an empty table; columns beyond those of ``documents`` are kept
up to the last stage. No stage can be written in SQL as a whole, so there is no
``ORACLE_SQL``; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesieve.llm.language import keep_identified
from pagesieve.llm.minhash import keep_one
from pagesieve.llm.packing import pack_stage
from pagesieve.llm.secrets import redact_stage
from pagesieve.llm.tables import load, write_table

STAGES = [
    ("language", keep_identified),
    ("near_duplicates", keep_one),
    ("secrets", redact_stage),
    ("packing", pack_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
