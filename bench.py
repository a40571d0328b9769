"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Every query is forced to
completion through the ``noop`` sink (full plan, no collect); one warm-up run,
then the median of ``$BENCH_RUNS`` timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_host_scores",      # F1-F13 + T8 + M14 + M15, per-host aggregate
    "f13_feature_table",         # twelve page features
    "m14_page_score",            # collapsed-model page scores
    "l04_top_article_links",     # L1-L4 anchors, dedup, score, top-N in row
    "t06_subword_mask",          # corpus n-gram counts -> bucket mask
    "t04_encode",                # per-distinct-word grams + hash, joined back
    "x02_vocab_compare",         # two-class vocabulary comparison
    "c07_first_per_key",         # dedup: first row per text
    "e04_gram_table",            # impact study: gram table
    "w05_windowed_event_counts",  # streaming windowed aggregation
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from pagesieve.plans.registry import load_all
    from pagesieve.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", app="pagesieve-bench", shuffle_partitions=int(cpus))
    reg = load_all()
    names = [n for n in HEADLINE if n in reg]
    if len(sys.argv) > 1:
        names = [n for n in names if any(a in n for a in sys.argv[1:])]
    results = {}
    for name in names:
        q = reg[name]

        def once():
            t0 = time.perf_counter()
            q.fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up (JIT, file listing, codegen cache)
        results[name] = round(statistics.median([once() for _ in range(runs)]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
