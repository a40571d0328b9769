"""Streaming queries W1..W5: each runs a Structured Streaming job over the
driver tables (available-now trigger, checkpoint in the shared folder) and
returns what the sink wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import links as LK
from ..session import shared_dir
from ..sources import model_io, tables
from ..streaming import stream as ST
from .q_links import _POLICY_SQL, anchors_cte, policy_lists, sql_resolve
from .q_model import _M, scored_sql_ctes
from .registry import query


def _lists(spark, sf_dir):
    """Re-read the policy lists (W4): the user allow list, or the default when empty."""
    def read():
        allow, deny = policy_lists(spark, sf_dir)
        return LK.effective_allow_list(spark, allow), deny
    return read


_SCORES_SQL = f"""WITH {_POLICY_SQL},
{scored_sql_ctes(_M)}
SELECT cas.page_id, cas.url, cas.rule, round(CASE rule WHEN 'deny' THEN 0.0 WHEN 'model' THEN 1.0 - sv.p_slop ELSE 1.0 END, 6) AS ok_score,
  CASE WHEN (CASE rule WHEN 'deny' THEN 0.0 WHEN 'model' THEN 1.0 - sv.p_slop ELSE 1.0 END) < 0.15 THEN 'Slop!'
       WHEN (CASE rule WHEN 'deny' THEN 0.0 WHEN 'model' THEN 1.0 - sv.p_slop ELSE 1.0 END) < 0.3 THEN 'Risk'
       WHEN (CASE rule WHEN 'deny' THEN 0.0 WHEN 'model' THEN 1.0 - sv.p_slop ELSE 1.0 END) < 0.6 THEN 'Hmm'
       ELSE 'No Slop' END AS band
FROM cas LEFT JOIN sv USING (page_id)"""


@query("w01_stream_link_scores", _SCORES_SQL)
def w01_stream_link_scores(spark, sf_dir):
    """Pages arrive as a file stream; cascade, score and band every link, one file batch at a time."""
    base = shared_dir(spark, f"w01-{uuid.uuid4().hex}")
    schema = tables.pages(spark, sf_dir).schema
    s = ST.read_stream(spark, sf_dir, "pages", schema)
    q = ST.start_link_scoring(s, f"{base}/out", f"{base}/ckpt", _lists(spark, sf_dir),
                              model_io.load_model(spark))
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("page_id", "url", "rule", F.round("ok_score", 6).alias("ok_score"),
                                                    "band")


@query("w01_batch_twin", _SCORES_SQL)
def w01_batch_twin(spark, sf_dir):
    """The same cascade on the batch table (the stream's result must equal it)."""
    allow, deny = _lists(spark, sf_dir)()
    out = ST.cascade_scores(tables.pages(spark, sf_dir), allow, deny, model_io.load_model(spark))
    return out.select("page_id", "url", "rule", F.round("ok_score", 6).alias("ok_score"), "band")


@query("w02_stream_dedup_links", f"""WITH {anchors_cte()}
SELECT DISTINCT {sql_resolve('url', 'href')} AS url FROM an""")
def w02_stream_dedup_links(spark, sf_dir):
    """Each link once: a stream of the pages' links, deduplicated within the watermark of their arrival time."""
    base = shared_dir(spark, f"w02-{uuid.uuid4().hex}")
    schema = tables.pages(spark, sf_dir).schema
    s = ST.read_stream(spark, sf_dir, "pages", schema)
    links = s.select("url", F.explode(LK.anchors(F.col("html"))).alias("a"), F.current_timestamp().alias("seen")).select(
        LK.resolve_url(F.col("url"), F.col("a.href")).alias("url"), "seen")
    ST.run_to_parquet(ST.dedup_links(links, "url", "seen"), f"{base}/out", f"{base}/ckpt", "append")
    return spark.read.parquet(f"{base}/out").select("url")


@query("w03_missing_page_score", f"""WITH {_POLICY_SQL}
SELECT rule, count(*) AS n FROM cas GROUP BY rule""")
def w03_missing_page_score(spark, sf_dir):
    """Rule counts of the cascade: a page without html scores 1 and the stream goes on."""
    allow, deny = _lists(spark, sf_dir)()
    out = ST.cascade_scores(tables.pages(spark, sf_dir), allow, deny, model_io.load_model(spark))
    return out.groupBy("rule").agg(F.count("*").alias("n"))


@query("w05_windowed_event_counts", """WITH mx AS (SELECT max(ts) AS m FROM events),
b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ws, event_type, value FROM events)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS value_sum
FROM b, mx WHERE ws + INTERVAL '1 hour' <= mx.m - INTERVAL '10 minutes' GROUP BY ws, event_type""")
def w05_windowed_event_counts(spark, sf_dir):
    """Events per type in 1-hour tumbling windows, watermark 10 minutes, append mode."""
    base = shared_dir(spark, f"w05-{uuid.uuid4().hex}")
    schema = tables.load(spark, sf_dir, "events").schema
    s = ST.read_stream(spark, sf_dir, "events", schema)
    ST.run_to_parquet(ST.windowed_counts(s), f"{base}/out", f"{base}/ckpt", "append")
    out = spark.read.parquet(f"{base}/out")
    return out.select("window_start", "event_type", "n", F.round("value_sum", 6).alias("value_sum"))
