"""CSV in byte ranges, and runs that stop before their commit."""
import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.sources import csv_ranges as CR
from pagesieve.sources import files as FS

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "t", "site")])


@pytest.fixture
def ranges_of(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def ranges(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield ranges
    for k, v in old.items():
        spark.conf.set(k, v)


def _rows(n):
    r = random.Random(5)
    parts = ["a", '"', "\n", ",", " ", "é", '""', "x\r\ny"]
    return [(str(i), "".join(r.choice(parts) for _ in range(r.randint(1, 30))) + "z", f"s{i % 7}") for i in range(n)]


def _write(path, rows, mode="w"):
    with open(path, mode, newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)


@pytest.mark.parametrize("size", [1 << 27, 5000, 700])
def test_ranges_equal_the_whole_file(spark, tmp_path, ranges_of, size):
    """Records over several lines and ranges, bad bytes, wrong field counts, a blank line, a carriage return."""
    rows = _rows(300)
    rows[100] = ("100", "long\n" * 2000 + "q", "s2")
    at = tmp_path / "x.csv"
    _write(at, [("id", "t", "site"), *rows[:150]])
    with open(at, "ab") as f:
        f.write(b'\nbad,row\nb,"a\nb",c,d\n7777,x\xff\xfey,s1\r\n')
    _write(at, rows[150:], "a")
    ranges_of(size)
    good, bad = CR.read_csv_ranges(spark, str(at), SCHEMA)
    assert sorted(map(tuple, good.collect())) == sorted([*rows, ("7777", "x��y", "s1")])
    assert sorted(r["record"] for r in bad.collect()) == ['b,"a\nb",c,d', "bad,row"]


def test_tiny_ranges(spark, tmp_path, ranges_of):
    """Ranges shorter than a line, and ranges wholly inside one record."""
    rows = _rows(12)
    _write(tmp_path / "x.csv", rows)
    ranges_of(23)
    good, bad = CR.read_csv_ranges(spark, str(tmp_path), SCHEMA, header=False)
    assert sorted(map(tuple, good.collect())) == sorted(rows) and bad.count() == 0


def test_open_quote_and_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,site\n1,a,b\n2,"open,c\n3,d,e\n')
    (tmp_path / "b.csv").write_text("")
    good, bad = CR.read_csv_ranges(spark, str(tmp_path), SCHEMA)
    assert [tuple(r) for r in good.collect()] == [("1", "a", "b")]
    assert [(r["line"], r["record"].strip()) for r in bad.collect()] == [(2, '2,"open,c\n3,d,e')]


def test_run_that_stops_before_its_commit(spark, tmp_path):
    """Files without a commit are not read; the next run saves the sites again, once; a null site counts as one."""
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a", "en"), (2, "a", "de"), (3, "b", "en"), (4, None, "en")],
                               "id int, website string, domain string")
    assert FS.read_saved(spark, path, df.schema).count() == 0 and FS.saved_sites(spark, path).count() == 0
    FS.save_run(df.where("website = 'a'"), path, "1")
    df.where("website = 'b'").write.partitionBy("domain").parquet(f"{path}/articles/run=2")
    assert sorted(r["id"] for r in FS.read_saved(spark, path, df.schema).collect()) == [1, 2]
    FS.save_run(df.where("website = 'b' OR website IS NULL"), path, "3")
    FS.save_run(df.where("website = 'a'"), path, "4")
    saved = FS.read_saved(spark, path, df.schema)
    assert sorted(r["id"] for r in saved.collect()) == [1, 2, 3, 4] and saved.columns == df.columns
    got = {r["website"]: (r["run"], r["n_articles"]) for r in FS.saved_sites(spark, path).select(
        "website", "run", F.col("n_articles")).collect()}
    assert got == {"a": ("1", 2), "b": ("3", 1), None: ("3", 1)}
