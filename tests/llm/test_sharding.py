import duckdb
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import sharding


def shards(df, limit):
    return sharding.assign_shards(df, "doc_id", F.octet_length("text"), limit).collect()


@pytest.mark.parametrize("limit", [1, 300, 5_000, 10**9])
def test_directory(make_docs, edge_rows, limit):
    rows = edge_rows + [(100 + i, "y" * (i % 97), None) for i in range(300)]
    got = shards(make_docs(rows), limit)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard_id, []).append(r)
    for sid, members in by.items():
        total = sum(r["size"] for r in members)
        assert {(r.shard_bytes, r.shard_rows) for r in members} == {(total, len(members))}
        assert sid == (1 << members[0].depth) + members[0].prefix
        assert total <= limit or len({r.doc_id for r in members}) == 1
    # A shard's sibling, however deep it is split, holds so much that the two together are over the limit.
    for sid, members in by.items():
        d, p = members[0].depth, members[0].prefix
        if d:
            near = [r for r in got if r.depth >= d - 1 and r.prefix >> (r.depth - d + 1) == p >> 1]
            assert sum(r["size"] for r in near) > limit


def test_oracle(make_docs, edge_rows, tmp_path):
    docs = make_docs([(i, ("text %d " % i) * 3000, None) for i in range(200)], clash=False)
    con = duckdb.connect()
    pdf = docs.toPandas()
    con.register("documents", pdf)
    rel = con.sql(sharding.SQL)
    want = sorted(rel.fetchall())
    got = sharding.assign_shards(docs, "doc_id", F.octet_length("text"))
    assert sorted(tuple(r) for r in got.select(*rel.columns).collect()) == want


def test_empty_and_null_keys(make_docs):
    assert shards(make_docs([]), 10) == []
    got = shards(make_docs([(None, "abc", None), (None, None, None), (1, "d", None)]), 2)
    assert sorted((r.doc_id is None, r["size"], r.oversize) for r in got) == [(False, 1, False), (True, 0, True),
                                                                               (True, 3, True)]


def test_write_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i, "z" * 50, None) for i in range(40)], clash=False)
    sharding.write_shards(docs, "doc_id", F.octet_length("text"), str(tmp_path / "out"), 400)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40
    assert back.groupBy("shard_id").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 400").count() == 0
