"""Streams over several micro-batches: lists that change, batches that run again, links once over a restart."""
from pyspark.sql import functions as F

from pagesieve.streaming import stream as ST

PAGE = "page_id long, url string, html string"


def rows_of(spark, path, *cols):
    return sorted(tuple(r) for r in spark.read.parquet(path).select(*cols).collect())


def test_lists_change_between_batches_and_a_replay_uses_its_own(spark, model, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    lists = ST.ListSnapshots(spark, str(tmp_path / "lists"))
    patterns = lambda *p: spark.createDataFrame([(x,) for x in p], "pattern string")

    def arrive(*rows):
        spark.createDataFrame(list(rows), PAGE).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(src)
        ST.start_link_scoring(stream, out, ckpt, lists, model).awaitTermination()
    assert lists.latest() == 0
    assert lists.publish(patterns("good.com"), patterns()) == 1
    first = (1, "http://good.com/a", None), (2, "http://bad.com/a", None)
    arrive(*first)
    assert rows_of(spark, f"{out}/batch_id=0", "page_id", "rule") == [(1, "allow"), (2, "no_html")]
    assert lists.publish(patterns("none.com"), patterns("bad", "good")) == 2
    arrive((3, "http://good.com/b", None), (4, "http://bad.com/b", None))
    assert rows_of(spark, f"{out}/batch_id=1", "page_id", "rule") == [(3, "deny"), (4, "deny")]
    # the first batch runs again after the change: same lists, same rows, once
    ST.batch_writer(out, lists, model)(spark.createDataFrame(list(first), PAGE), 0)
    assert rows_of(spark, out, "page_id", "rule") == [(1, "allow"), (2, "no_html"), (3, "deny"), (4, "deny")]


def test_no_snapshot_means_the_default_list(spark, tmp_path):
    allow, deny = ST.ListSnapshots(spark, str(tmp_path / "none")).lists(0)
    assert allow.count() > 100 and deny.count() == 0


def test_links_once_over_batches_and_a_restart(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    ST.state_on_disk(spark)
    try:
        def arrive(*rows):
            df = spark.createDataFrame(list(rows), "url string, t string").select("url", F.to_timestamp("t").alias("seen"))
            df.coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("url string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(src)
            # each call starts the query anew from the checkpoint
            return ST.run_to_parquet(ST.dedup_links(stream, "url", "seen", "1 hour"), out, ckpt).lastProgress
        day = "2024-01-01 "
        arrive(("a", day + "10:00:00"), ("b", day + "10:01:00"), ("a", day + "10:02:00"))
        arrive(("a", day + "10:30:00"), ("c", day + "10:40:00"))           # repeats across batches and a restart
        assert rows_of(spark, out, "url") == [("a",), ("b",), ("c",)]
        arrive(("d", day + "15:00:00"))
        last = arrive(("e", day + "09:00:00"), ("f", day + "15:10:00"), ("d", day + "15:20:00"))    # e: past the watermark
        assert rows_of(spark, out, "url") == [("a",), ("b",), ("c",), ("d",), ("f",)]
        assert sum(s.numRowsTotal for s in last.stateOperators) <= 2        # a, b and c have left the state
    finally:
        spark.conf.set(key, before)


def test_a_stream_reads_a_table_in_one_file_or_in_a_folder_of_part_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", '<a href="/x">x</a>') for i in range(6)]
    spark.createDataFrame(rows, PAGE).repartition(3).write.parquet(str(tmp_path / "parts" / "pages.parquet"))
    spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "one" / "pages.parquet")
    for kind in ("parts", "one"):
        got = ST.read_stream(spark, str(tmp_path / kind), "pages", PAGE)
        ST.run_to_parquet(got, str(tmp_path / f"{kind}-out"), str(tmp_path / f"{kind}-ckpt"))
        assert rows_of(spark, str(tmp_path / f"{kind}-out"), "page_id", "url", "html") == rows
