"""Stages one after another, each against brute force on what the one before kept."""
import os

import corpus_pipeline
from pyspark.sql import functions as F

from pagesieve.llm import language, secrets
from pagesieve.llm.tables import write_table
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    base = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "packing"]
    step = dict(corpus_pipeline.STAGES)

    first = write_table(step["language"](spark, docs, SF), "t1")
    pred = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    want = {i for i, r in pred.items() if r.lang_pred != "und" and r.score >= language.MIN_SCORE}
    assert first.columns == base and {r.doc_id for r in first.collect()} == want

    second = write_table(step["near_duplicates"](spark, first, SF), "t2")
    rows = [(r.doc_id, r.text, None) for r in first.collect()]
    assert second.columns == base
    assert sorted(r.doc_id for r in second.collect()) == [d for d, _, _, kept in brute(rows) if kept]

    third = write_table(step["secrets"](spark, second, SF), "t3")
    assert third.columns == base
    assert {r.doc_id: r.text for r in third.collect()} == {r.doc_id: secrets.redact(r.text) for r in second.collect()}

    last = write_table(step["packing"](spark, third, SF), "t4")
    fill = last.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert fill.where("n > 1024 or n <> e").count() == 0
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in third.collect()}


def test_empty_table(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, SF), f"e-{name}")
        assert docs.count() == 0
