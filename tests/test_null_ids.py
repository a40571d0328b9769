"""Rows with null and repeated ids, and one site that holds half of the rows."""
import os.path
import random

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import clean as CL


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_splits_and_batches_keep_rows_without_id(spark):
    rows = [(None, "a", 1), (None, "b", 1), (None, "a", 0), (4, "d", 1), (4, "e", 0), (6, "f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    split = CL.split_train_test(df, 0.2)
    assert rows_of(split.drop("split")) == rows_of(df)
    assert {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()} == {
        (1, "test"): 1, (1, "train"): 2, (0, "test"): 1, (0, "train"): 1, (None, "test"): 1}
    whole = CL.split_train_test(df, 0.5, stratify=None).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in whole} == {"test": 3, "train": 3}
    batches = CL.epoch_batches(df, 3, 4)
    assert rows_of(batches.drop("batch_id")) == rows_of(df)
    assert {r.batch_id: r["count"] for r in batches.groupBy("batch_id").count().collect()} == {0: 4, 1: 2}


def test_first_per_key_without_ids(spark):
    rows = [(None, "a", "x"), (None, "b", "x"), (None, "c", "y"), (3, "c", "z"), (2, "d", "p"), (2, "d", "q"),
            (1, "e", "r"), (1, "e", "r"), (None, None, "s"), (None, None, "s"), (5, "b", "t")]
    got = rows_of(CL.first_per_key(spark.createDataFrame(rows, "doc_id long, text string, other string"), "text", "doc_id"))
    assert [r[:2] for r in got] == [(1, "e"), (2, "d"), (3, "c"), (5, "b"), (None, "a"), (None, None)]


def prefix_brute(rows):
    out = []
    for i, (d, site, text) in enumerate(rows):
        best = max((len(os.path.commonprefix([text, t])) for j, (_, s, t) in enumerate(rows)
                    if j != i and s == site and text is not None and t is not None), default=0)
        out.append((d, site, best, None if text is None else text[best:]))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("ranges", [1, 8, 200])
def test_shared_prefix_with_a_hot_site(spark, ranges):
    rng = random.Random(5)
    heads = ["Menu | Home | " * 9, "Menu | Shop ", "", "é" * 70]
    rows = [(i, "hot" if i % 2 else rng.choice(["b", "c", None]),
             rng.choice(heads) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))) for i in range(160)]
    rows += [(500, "hot", None), (501, "hot", ""), (None, "hot", heads[0] + "q"), (502, "lonely", "alone")]
    rows += [(600 + i, "hot", "the very same text") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, website string, text string").withColumn("extra", F.lit(1))
    out = CL.strip_shared_prefix(df, ranges=ranges)
    assert rows_of(out) == prefix_brute(rows)
    assert "hashpartitioning(website" not in out._jdf.queryExecution().toString()
