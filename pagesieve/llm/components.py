"""Connected components of a table of links, by label spreading with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import write_table


def components(links: DataFrame) -> DataFrame:
    """``cid, comp`` for every end of a link ``a, b``: comp is the smallest end reachable.

    Each round a node takes the smallest label among its neighbours and then the
    label of that label, so paths shorten by half; rounds end when nothing
    changes. Labels are written each round, never collected.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = write_table(both, "cc-links", slim=True)
    labels = write_table(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("cid")).alias("comp")),
                         "cc-labels", slim=True)
    while True:
        near = (both.join(labels.withColumnRenamed("cid", "b"), "b")
                .groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near")))
        step = labels.join(near, "cid").select("cid", F.col("comp").alias("old"),
                                               F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("far"))
        step = step.join(jump, "comp", "left").select("cid", "old", F.coalesce("far", "comp").alias("comp"))
        step = write_table(step, "cc-labels", slim=True)
        changed = not step.where("comp <> old").isEmpty()
        labels = step.select("cid", "comp")
        if not changed:
            return labels
