"""Structured Streaming operators (W1..W5).

W1 link scoring: a file stream of ``(page_id, url, html)`` goes through the
policy cascade and the collapsed-model scorer, then the score bands. Scoring
is per row (the page's two text aggregates are array functions inside the
row), so the stream needs no state. Policy lists are re-read for every
micro-batch inside ``foreachBatch`` (W4), and each batch is written to its own
``batch_id`` folder with overwrite, so a retried batch replaces its output
(idempotent sink, exactly-once together with the checkpoint). Lists that change
while the stream runs are numbered snapshots (:class:`ListSnapshots`): a batch notes
the one that it uses before it writes, and uses the same one when it is run again.

W2 keeps each url once (bounded state needs an event time: with one,
``dropDuplicatesWithinWatermark``); :func:`state_on_disk` keeps the state in RocksDB. W5 counts events per type in tumbling
windows with a watermark, append mode (bounded state).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links as LK
from ..operators import scoring as SC
from ..session import is_folder, is_written, sub_folders
from ..sources.model_io import CollapsedModel


def read_stream(spark: SparkSession, directory: str, table: str, schema, max_files: int | None = None):
    """A file stream over the table ``<directory>/<table>.parquet``: a folder of part files, or one file.

    A stream reads folders only, so a single file is picked by name from its folder.
    """
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    path = f"{directory.rstrip('/')}/{table}.parquet"
    return r.parquet(path) if is_folder(spark, path) else r.option("pathGlobFilter", f"{table}.parquet").parquet(directory)


def cascade_scores(batch: DataFrame, allow: DataFrame, deny: DataFrame, model: CollapsedModel,
                   id_col: str = "page_id") -> DataFrame:
    """L9 + M14 + L11 on one micro-batch: ``(id, url, rule, ok_score, band)``; the lists are tables of any size."""
    r = LK.policy_cascade(batch, allow, deny, id_col=id_col)
    decided = r.where(F.col("rule") != "model").select(
        id_col, "url", "rule", F.when(F.col("rule") == "deny", 0.0).otherwise(1.0).alias("ok_score"))
    scored = SC.score_pages(r.where(F.col("rule") == "model"), model, id_col=id_col, keep=["url"]).select(
        id_col, "url", F.lit("model").alias("rule"), (F.lit(1.0) - F.col("p_slop")).alias("ok_score"))
    out = decided.unionByName(scored)
    return SC.with_band(out, "ok_score")


class ListSnapshots:
    """Allow and deny lists as numbered tables in a folder that the cluster shares.

    A snapshot counts from the moment when it is written to its end; numbers grow.
    Before the first one both lists are empty, so the built-in allow list holds.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, number: int) -> str:
        return f"{self.folder}/snapshot={number:09d}"

    def latest(self) -> int:
        done = [int(n.split("=")[1]) for n in sub_folders(self.spark, self.folder)
                if n.startswith("snapshot=") and is_written(self.spark, f"{self.folder}/{n}")]
        return max(done, default=0)

    def publish(self, allow: DataFrame, deny: DataFrame) -> int:
        """Write both lists as the next snapshot; returns its number."""
        number = self.latest() + 1
        LK.tagged(allow, deny).write.mode("overwrite").parquet(self._path(number))
        return number

    def lists(self, number: int) -> tuple[DataFrame, DataFrame]:
        schema = "pattern string, list string"
        both = (self.spark.read.schema(schema).parquet(self._path(number)) if number
                else self.spark.createDataFrame([], schema))
        allow = both.where("list = 'allow'").select("pattern")
        return LK.effective_allow_list(self.spark, allow), both.where("list = 'deny'").select("pattern")

    def for_batch(self, out_dir: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """The lists of this batch: those noted by an earlier run of it, else the latest, which are noted."""
        note = f"{out_dir}/_lists/batch_id={batch_id}"
        if not is_written(self.spark, note):
            self.spark.createDataFrame([(self.latest(),)], "snapshot long").coalesce(1).write.mode("overwrite").parquet(note)
        return self.lists(self.spark.read.schema("snapshot long").parquet(note).first()["snapshot"])


def batch_writer(out_dir: str, lists: Callable[[], tuple[DataFrame, DataFrame]] | ListSnapshots,
                 model: CollapsedModel, id_col: str = "page_id") -> Callable[[DataFrame, int], None]:
    """What is done with each micro-batch: score it and (over)write its own folder."""
    def write_batch(df: DataFrame, batch_id: int) -> None:
        allow, deny = lists.for_batch(out_dir, batch_id) if isinstance(lists, ListSnapshots) else lists()
        res = cascade_scores(df, allow, deny, model, id_col)
        res.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
    return write_batch


def start_link_scoring(stream: DataFrame, out_dir: str, checkpoint: str,
                       lists: Callable[[], tuple[DataFrame, DataFrame]] | ListSnapshots, model: CollapsedModel,
                       available_now: bool = True, id_col: str = "page_id"):
    """W1 + W3 + W4: start the scoring stream; lists are re-read, or taken as a snapshot, per micro-batch."""
    write_batch = batch_writer(out_dir, lists, model, id_col)
    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def state_on_disk(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB, out of the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dedup_links(stream: DataFrame, key: str = "url", event_time: str | None = None,
                delay: str = "1 hour") -> DataFrame:
    """Each link once; bounded by a watermark when an event time exists."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def windowed_counts(stream: DataFrame, ts: str = "ts", by: str = "event_type",
                    window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per key in tumbling windows, late rows past the watermark dropped."""
    # watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read in the session time zone
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), F.col(by))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value_sum")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), by, "n", "value_sum")


def run_to_parquet(df: DataFrame, out_dir: str, checkpoint: str, mode: str = "append"):
    """Run a streaming DataFrame over everything available into a parquet sink."""
    q = (df.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q

