"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids come from balanced k-means, split again and again, over a bounded
sample (``SAMPLE`` distinct vectors at most); all vectors are indexed. A vector
near a boundary is posted to several lists: to every centroid at most
``REPLICA_RATIO`` times as far as its nearest one, up to ``REPLICAS``, leaving
out a centroid that lies closer to one already taken than to the vector. Lists
for a vector or a query are found by a best-first search over a neighbour graph
of the centroids that is held in memory. A query reads the lists whose centroid
is within a ratio of its nearest centroid's distance; the ratio is the one that
would have found ``TARGET`` of the neighbours inside the sample.

Copies of one vector are posted once with their smallest ids. A list is dealt
into blocks by its size, and so are its queries; a task compares one block of
queries with one block of vectors. Scores are double-precision cosines of the original vectors,
computed pair by pair so that equal pairs have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vec
from .registry import llm_query
from .tables import load, write_table

SAMPLE = 32_768
LIST_SIZE = 256
REPLICAS = 4
REPLICA_RATIO = 1.10
DEGREE = 24
BEAM = 48
TARGET = 0.99
BLOCK_ROWS = 4096
K = 5


@dataclass
class Index:
    centroids: np.ndarray    # unit vectors
    graph: np.ndarray        # neighbours of each centroid
    ratio: float             # of distances, for queries
    sizes: np.ndarray | None = None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _split(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Labels of balanced k-means: rows choose in order of how much they lose by waiting; full clusters are closed."""
    c = x[rng.choice(len(x), k, replace=False)]
    room = -(-len(x) * 5 // (4 * k))
    label = np.zeros(len(x), np.int64)
    for _ in range(8):
        sim = x @ c.T
        top = np.sort(sim, axis=1)
        order = np.argsort(top[:, -2] - top[:, -1], kind="stable")
        pref = np.argsort(-sim, axis=1, kind="stable")
        left = np.full(k, room)
        for i in order:
            for j in pref[i]:
                if left[j]:
                    left[j] -= 1
                    label[i] = j
                    break
        for j in range(k):
            if (label == j).any():
                m = x[label == j].mean(0)
                c[j] = m / max(np.sqrt(m @ m), 1e-12)
    return label


def balanced_centroids(x: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Centroids of clusters of at most about ``size`` rows each."""
    rng = np.random.default_rng(seed)
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size or len(rows) < 4:
            m = x[rows].mean(0)
            n = np.sqrt(m @ m)
            out.append(m / n if n > 1e-9 else x[rows[0]])
            continue
        label = _split(x[rows], min(8, max(2, -(-len(rows) // size))), rng)
        todo += [rows[label == j] for j in np.unique(label)]
    return np.array(out)


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Nearest centroids of each centroid, and the next one in a ring so that all can be reached."""
    n, m = len(c), min(degree, len(c) - 1)
    near = np.zeros((n, m + 1), np.int32)
    for a in range(0, n, 1024):
        sim = c[a:a + 1024] @ c.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
        near[a:a + 1024, :m] = np.argsort(-sim, axis=1, kind="stable")[:, :m]
    near[:, m] = (np.arange(n) + 1) % n
    return near


def search_graph(index: Index, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best centroids found for each row of ``q`` and their similarity, best first; all rows advance together."""
    c, n = index.centroids, len(index.centroids)
    beam = min(beam, n)
    rows = np.arange(len(q))[:, None]
    start = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
    ids = np.tile(start, (len(q), 1))
    sim = q @ c[start].T
    seen = np.zeros((len(q), n), bool)
    seen[:, start] = True
    open_ = np.ones(ids.shape, bool)
    while open_.any():
        pick = np.argsort(np.where(open_, -sim, 3.0), axis=1, kind="stable")[:, :4]
        valid = open_[rows, pick]
        open_[rows, pick] = False
        new = index.graph[ids[rows, pick]].reshape(len(q), -1)
        fresh = np.repeat(valid, index.graph.shape[1], axis=1) & ~seen[rows, new]
        named = np.where(fresh, new, n)
        order = np.argsort(named, axis=1, kind="stable")
        s = np.take_along_axis(named, order, 1)
        again = np.zeros(new.shape, bool)
        np.put_along_axis(again, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
        fresh &= ~again
        r, k = np.nonzero(fresh)
        seen[r, new[r, k]] = True
        gain = np.full(new.shape, -3.0)
        gain[r, k] = np.einsum("ij,ij->i", q[r], c[new[r, k]])
        ids, sim = np.hstack([ids, new]), np.hstack([sim, gain])
        open_ = np.hstack([open_, fresh])
        keep = np.argsort(-sim, axis=1, kind="stable")[:, :max(beam, len(start))]
        ids, sim, open_ = ids[rows, keep], sim[rows, keep], open_[rows, keep]
        open_ &= sim > -2.5
    return ids, sim


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * sim, 0))


def replicas(index: Index, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each unit vector is posted to."""
    ids, sim = search_graph(index, v)
    ids, d = ids[:, :2 * REPLICAS], _distance(sim[:, :2 * REPLICAS])
    take = np.zeros(ids.shape, bool)
    take[:, 0] = True
    for j in range(1, ids.shape[1]):
        between = _distance(np.einsum("nd,nkd->nk", index.centroids[ids[:, j]], index.centroids[ids[:, :j]]))
        hidden = (take[:, :j] & (between < d[:, j:j + 1])).any(1)
        take[:, j] = (d[:, j] <= REPLICA_RATIO * d[:, 0]) & ~hidden & (take.sum(1) < REPLICAS) & (sim[:, j] > -2.5)
    row, k = np.nonzero(take)
    return row, ids[row, k]


def fit(sample: np.ndarray, rows: int) -> Index:
    """An index for ``rows`` vectors of which ``sample`` holds some (distinct, not zero)."""
    x = unit(sample.astype(np.float64))
    lists = max(1, min(rows // LIST_SIZE, len(x) // 8))
    c = balanced_centroids(x, -(-len(x) // lists))
    index = Index(c, neighbour_graph(c), 1.0)
    if len(c) > 1:
        step = max(1, len(x) // 256)
        q = x[::step]
        sim = q @ x.T
        sim[np.arange(len(q)), np.arange(0, len(x), step)] = -2
        near = np.argpartition(-sim, min(K, len(x) - 1) - 1, axis=1)[:, :K]
        by_row = []
        for a in range(0, len(x), 1024):
            row, lst = replicas(index, x[a:a + 1024])
            by_row += np.split(lst, np.flatnonzero(np.diff(row)) + 1)
        d = _distance(q @ c.T)
        ratios = [min(d[i, by_row[j]]) / max(d[i].min(), 1e-9) for i in range(len(q)) for j in near[i]]
        index.ratio = float(np.quantile(ratios, TARGET))
    return index


def chosen_lists(index: Index, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each unit query reads: those within the ratio, more until they hold ``least``."""
    ids, sim = search_graph(index, q, beam=len(index.centroids) if index.ratio > 2 else max(BEAM, len(index.centroids) // 4))
    d = _distance(sim)
    size = index.sizes[ids]
    before = np.cumsum(size, axis=1) - size
    take = ((d <= index.ratio * np.maximum(d[:, :1], 1e-9)) | (before < least)) & (sim > -2.5)
    row, k = np.nonzero(take)
    return row, ids[row, k]


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 0))
    return np.asarray(col.flatten()).reshape(len(col), -1).astype(np.float64)


def _cuts(batches, rows: int):
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def _post(index: Index):
    def run(batches):
        for b in _cuts(batches, 1024):
            row, lst = replicas(index, unit(_matrix(b.column("v"))))
            t = b.take(pa.array(row))
            yield pa.record_batch([pa.array(lst, pa.int64()), *t.columns], ["list", *t.schema.names])
    return run


def _ask(index: Index, least: int):
    def run(batches):
        for b in _cuts(batches, 512):
            row, lst = chosen_lists(index, unit(_matrix(b.column("v"))), least)
            t = b.take(pa.array(row))
            yield pa.record_batch([pa.array(lst, pa.int64()), *t.columns], ["list", *t.schema.names])
    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, one by one (equal pairs give equal results)."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _cell(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, posts: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and posts.num_rows:
            v, ids = _matrix(posts.column("v")), posts.column("ids").to_pylist()
            nv = unit(v)
            for a in range(0, queries.num_rows, 512):
                part = queries.slice(a, 512)
                q, own = _matrix(part.column("v")), part.column("query_id").to_pylist()
                sim = unit(q) @ nv.T
                m = min(k + 1, len(v))
                floor = np.partition(sim, len(v) - m, axis=1)[:, len(v) - m] - 1e-9
                i, j = np.nonzero(sim >= floor[:, None])
                score = cosine(q[i], v[j])
                best: dict[int, list] = {}
                for x, y, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True):
                    best.setdefault(x, []).extend((-s, n) for n in ids[y] if n != own[x])
                for x, found in best.items():
                    for s, n in sorted(found)[:k]:
                        out[0].append(own[x])
                        out[1].append(n)
                        out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})
    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: no null, zero or non-finite ones, of the most common length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and exists(v, x -> x <> 0) "
        "and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def nearest(vectors: DataFrame, queries: F.Column, k: int = K, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """For each row where ``queries`` (a condition on ``vec_id``) holds, its ``k`` nearest other rows.

    Columns ``query_id, rank, vec_id, score``; ties go to the smaller id. A row
    without an id, or whose vector is null, zero, holds null or non-finite
    components or has an unusual length takes no part. Of repeated rows of one id
    and vector one counts. Without such rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = write_table(usable(vectors, id_col, vec_col), "ann-vectors")
    # Of copies of a vector only the k + 1 smallest ids can be among the nearest k.
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = write_table(rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
                           .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-distinct")
    n = distinct.count()
    if n < 1:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, 0.9 * SAMPLE / n)
    sample = distinct.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("v")
    index = fit(_matrix(sample.toArrow().column("v")), n)
    kind = vectors.schema[vec_col].dataType.simpleString()
    posts = write_table(distinct.mapInArrow(_post(index), f"list long, v {kind}, ids array<long>"), "ann-posts")
    sizes = posts.groupBy("list").agg(F.count("*").alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
    index.sizes = np.zeros(len(index.centroids), np.int64)
    for r in sizes.collect():                      # one row per centroid
        index.sizes[r["list"]] = r["n"]
    asked = write_table(rows.where(queries).distinct().select(F.col("vec_id").alias("query_id"), "v")
                        .mapInArrow(_ask(index, 8 * (k + 1)), f"list long, query_id long, v {kind}"), "ann-asked")
    # Both sides of a list are dealt into blocks; a cell is one block of queries against one block of vectors.
    cells = sizes.join(asked.groupBy("list").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("query_blocks")), "list")
    asked = (asked.join(cells, "list").withColumn("query_block", F.expr("pmod(xxhash64(query_id), query_blocks)"))
             .withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))))
    dealt = (posts.join(cells, "list").withColumn("block", F.expr("pmod(xxhash64(v), blocks)"))
             .withColumn("query_block", F.explode(F.expr("sequence(0L, query_blocks - 1)"))))
    cell = ["list", "query_block", "block"]
    found = (asked.select(*cell, "query_id", "v").groupBy(*cell)
             .cogroup(dealt.select(*cell, "v", "ids").groupBy(*cell))
             .applyInArrow(_cell(k), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


@llm_query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose vec_id is divisible by 50."""
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
