"""Mean-pooled n-gram classifier with numeric features (M1..M13, M17) and the
impact studies E1..E6, as DataFrame jobs.

Layout. The embedding table is a DataFrame ``(bucket, e0 .. e{E-1})`` over the
buckets that occur in the data; the dense layer (``(E + F) x 2`` numbers), the
bias and the scaler live on the driver, because their size is fixed by the
model, not by the data. A document embedding is linear in the table:

    e_d = sum_b w_{d,b} * vocab[b],  w_{d,b} = sum over words j holding b of
          count_j(b) / (n_words_d * n_ids_j)

so a document's entries ``(bucket, w)`` are computed once and every step is a join +
grouped sum. Gradients are sums over documents: one aggregation per step returns
the dense gradient (a few hundred numbers) and a ``groupBy(bucket)`` gives the
embedding update, so results do not depend on row order or partitioning.
Random numbers come from md5 of (seed, position), so re-executed tasks and the
SQL oracle see the same values.
"""

from __future__ import annotations

import hashlib
import math
import sys
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import with_bucket
from ..session import shared_dir, write_shared
from .clean import epoch_batches

TWO32 = 4294967296.0


# --- deterministic random numbers (M9, M6) --------------------------------------

def _u01(key: Column) -> Column:
    """Uniform (0, 1) from the first 32 bits of md5(key)."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO32)


def std_normal(key: Column) -> Column:
    """N(0, 1) by Box-Muller from two md5 uniforms of ``key``."""
    u1 = _u01(F.concat(key, F.lit(":a")))
    u2 = _u01(F.concat(key, F.lit(":b")))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def np_std_normal(keys: list[str]) -> np.ndarray:
    """The same generator on the driver (for the small dense layer)."""
    out = []
    for k in keys:
        u1 = (int(hashlib.md5((k + ":a").encode()).hexdigest()[:8], 16) + 0.5) / TWO32
        u2 = (int(hashlib.md5((k + ":b").encode()).hexdigest()[:8], 16) + 0.5) / TWO32
        out.append(math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2))
    return np.array(out)


def init_vocab(buckets: DataFrame, emb_size: int, seed: int = 0, scale: float = 0.1) -> DataFrame:
    """M9: ``(bucket, e0..)`` with ``scale * N(0,1)`` per (seed, bucket, dim)."""
    b = buckets.select(F.col("bucket").cast("long").alias("bucket")).distinct()
    # few bytes, much work: a count of parts is given, so that they are not put together by their size
    b = b.repartition(buckets.sparkSession.sparkContext.defaultParallelism, "bucket")
    # one expression over the places, so that the code does not grow with the width
    v = F.transform(F.sequence(F.lit(0), F.lit(emb_size - 1)), lambda j: init_value(F.col("bucket"), j, seed, scale))
    return b.select("bucket", F.explode(F.array(v)).alias("v")).select(
        "bucket", *[F.col("v")[j].alias(f"e{j}") for j in range(emb_size)])


def init_value(bucket: Column, j: int | Column, seed: int = 0, scale: float = 0.1) -> Column:
    """M9: initial component ``j`` of a bucket's vector."""
    return F.lit(scale) * std_normal(F.concat_ws(":", F.lit(str(seed)), F.lit("v"), bucket.cast("string"),
                                                 F.lit(str(j)) if isinstance(j, int) else j.cast("string")))


def init_table(buckets: DataFrame, emb_size: int, seed: int = 0, scale: float = 0.1) -> DataFrame:
    """M9: the rows of :func:`init_vocab`, for wide tables: made in Arrow tasks, which take a third of the time."""
    b = buckets.select(F.col("bucket").cast("long").alias("bucket")).distinct()
    b = b.repartition(buckets.sparkSession.sparkContext.defaultParallelism, "bucket")

    def run(batches):
        for got in batches:
            for at in range(0, got.num_rows, 4096):
                keys = got.column(0).slice(at, 4096).to_pylist()
                digest = b"".join([hashlib.md5(b"%d:v:%d:%d:%c" % (seed, k, j, c)).digest()[:4]
                                   for k in keys for j in range(emb_size) for c in b"ab"])
                u = ((np.frombuffer(digest, ">u4") + 0.5) / TWO32).reshape(len(keys), emb_size, 2)
                v = scale * (np.sqrt(-2.0 * np.log(u[..., 0])) * np.cos(2.0 * math.pi * u[..., 1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c) for c in v.T.copy())],
                                                 ["bucket", *[f"e{j}" for j in range(emb_size)]])
    return b.where("bucket is not null").mapInArrow(run, ", ".join(["bucket long", *[f"e{j} double" for j in range(emb_size)]]))


def init_dense(n_in: int, n_class: int = 2, seed: int = 0, xavier: bool = True) -> np.ndarray:
    """M9: dense weights, Xavier-like scale (with features) or 0.1 (without)."""
    keys = [f"{seed}:W:{j}:{k}" for j in range(n_in) for k in range(n_class)]
    scale = math.sqrt(2.0 / (n_in + n_class)) if xavier else 0.1
    return np_std_normal(keys).reshape(n_in, n_class) * scale


def dropout_keep(key: Column, rate: float) -> Column:
    """M6: keep factor 0 or 1/(1-rate) from md5(key) (stable under task retry)."""
    if rate <= 0:
        return F.lit(1.0)
    return F.when(_u01(key) >= F.lit(rate), F.lit(1.0 / (1.0 - rate))).otherwise(F.lit(0.0))


# --- encoding -> document weights (M3) ----------------------------------------

def doc_bucket_weights(occ: DataFrame, enc: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, bucket, w, n_ids)``: M3 weights and the document's id count.

    ``occ`` holds every word occurrence ``(id, word_pos, word)`` (words with
    no ids still count); ``enc`` the kept ids ``(id, word_pos, bucket)``.
    """
    n_words = occ.groupBy(id_col).agg(F.count("*").alias("n_words"))
    per_word = enc.groupBy(id_col, "word_pos").agg(F.count("*").alias("n_ids_w"))
    e = enc.join(per_word, [id_col, "word_pos"]).join(n_words, id_col)
    w = e.groupBy(id_col, "bucket").agg(
        F.sum(F.lit(1.0) / (F.col("n_words") * F.col("n_ids_w"))).alias("w"),
        F.count("*").alias("occ"))
    n_ids = enc.groupBy(id_col).agg(F.count("*").alias("n_ids"))
    return w.join(n_ids, id_col)


def embed_docs(weights: DataFrame, vocab: DataFrame, emb_size: int, id_col: str = "doc_id") -> DataFrame:
    """M3: ``(id, x0..x{E-1})`` = sum_b w * vocab[b]."""
    j = weights.join(vocab, "bucket")
    return j.groupBy(id_col).agg(*[F.sum(F.col("w") * F.col(f"e{k}")).alias(f"x{k}") for k in range(emb_size)])


BROADCAST_TABLE = 256 << 20     # bytes of a bucket table that tasks may hold


def held_table(vocab: DataFrame, emb_size: int):
    """A bounded table for tasks: its buckets, ascending, their vectors, and a last one of zeros for unknown buckets."""
    rows = vocab.select("bucket", *[f"e{k}" for k in range(emb_size)]).toArrow()
    keys = rows.column(0).to_numpy()
    order = np.argsort(keys)
    vectors = np.zeros((len(keys) + 1, emb_size))
    for k in range(emb_size):
        vectors[:-1, k] = rows.column(k + 1).to_numpy()[order]
    return vocab.sparkSession.sparkContext.broadcast((keys[order], vectors))


def embed_examples(examples: DataFrame, vocab: DataFrame, emb_size: int, id_col: str = "doc_id") -> DataFrame:
    """M3 of examples with entries, as :func:`embed_docs`; ``vocab`` has a bucket once.

    The table is bounded by the bucket count and the width. Where that is small, tasks hold it and
    no entry is shuffled; a larger one is joined.
    """
    if vocab.count() * emb_size * 8 > BROADCAST_TABLE:
        return embed_docs(entries_of(with_structs(examples) if _held(examples) else examples, id_col), vocab, emb_size, id_col)
    table = held_table(vocab, emb_size)
    kind = examples.schema[id_col].dataType.simpleString()

    def run(batches):
        keys, vectors = table.value
        for got in batches:
            (bucket, many), (w, _) = _entry_numbers(got, "bucket"), _entry_numbers(got, "w")
            ends = np.r_[0, np.cumsum(many)].tolist()
            at = np.minimum(np.searchsorted(keys, bucket), max(len(keys) - 1, 0))
            known = keys[at] == bucket if len(keys) else np.zeros(len(at), bool)
            at[~known] = len(keys)
            x = np.zeros((got.num_rows, emb_size))
            for i, (a, e) in enumerate(zip(ends, ends[1:])):
                x[i] = w[a:e] @ vectors.take(at[a:e], 0)
            has = np.add.reduceat(np.r_[known, False], ends[:-1]) > 0 if got.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([got.column(0), *(pa.array(c) for c in x.T.copy())],
                                             [id_col, *[f"x{k}" for k in range(emb_size)]]).filter(pa.array(has))
    own = examples.select(id_col, *entry_arrays(examples, "bucket", "w"))
    own = own.where(n_entries(own) > 0)
    if not _held(own):
        own = own.select(id_col, F.col("bucket").cast("array<long>"), F.col("w").cast("array<double>"))
    x = own.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *[f"x{k} double" for k in range(emb_size)]]))
    return x.groupBy(id_col).agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(emb_size)])


# --- scaler (M1, M2) ---------------------------------------------------------------

def fit_scaler(feats: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M1: mean and population std (floored at 1e-6) per column, one aggregation."""
    r = feats.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                  *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (float(r[f"m_{c}"] or 0.0), max(float(r[f"s_{c}"] or 0.0), 1e-6)) for c in cols}


def scaler_frame(feats: DataFrame, cols: list[str]) -> DataFrame:
    """M1 as a relation ``(feature, mu, sigma)`` (no driver round trip)."""
    agg = feats.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                    *[F.greatest(F.coalesce(F.stddev_pop(c), F.lit(0.0)), F.lit(1e-6)).alias(f"s_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mu"), F.col(f"s_{c}").alias("sigma"))
                     for c in cols])
    return agg.select(F.inline(rows))


def standardize(feats: DataFrame, scaler: dict[str, tuple[float, float]], cols: list[str],
                id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """M2: ``(x - mu) / sigma`` with the scaler as literals (its size is the feature count)."""
    keep = keep or []
    return feats.select(id_col, *keep, *[((F.col(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias(f"z_{c}")
                                         for c in cols])


# --- forward, loss (M4, M5, M11, M12) ----------------------------------------------

@dataclass
class Dense:
    W: np.ndarray            # (E + F, 2)
    b: np.ndarray            # (2,)
    emb_size: int
    num_cols: list[str] = field(default_factory=list)

    def inputs(self) -> list[str]:
        return [f"x{k}" for k in range(self.emb_size)] + [f"z_{c}" for c in self.num_cols]


def logits(dense: Dense) -> list[Column]:
    cols = dense.inputs()
    out = []
    for k in range(dense.W.shape[1]):
        acc = F.lit(float(dense.b[k]))
        for j, c in enumerate(cols):
            acc = acc + F.col(c) * F.lit(float(dense.W[j, k]))
        out.append(acc)
    return out


def predict(x: DataFrame, dense: Dense) -> DataFrame:
    """Two-class softmax with max shift on the fused input rows."""
    z = logits(dense)
    return softmax(x.withColumn("z0", z[0]).withColumn("z1", z[1]))


def predict_examples(examples: DataFrame, table: DataFrame, dense: Dense, id_col: str = "doc_id") -> DataFrame:
    """M4/M12 of examples with entries: the columns but those, ``z0, z1, p0, p1``.

    A logit is linear in the table, so each bucket's vector is taken through the dense layer first (as M13
    does), and a document sums two numbers an entry, which its task does: no entry is shuffled.
    ``table`` may hold several rows of a bucket, whose sum is its vector.
    """
    E = dense.emb_size
    u = table.select("bucket", *[sum((F.col(f"e{k}") * F.lit(float(dense.W[k, c])) for k in range(E)), F.lit(0.0)).alias(f"e{c}")
                                 for c in (0, 1)]).groupBy("bucket").agg(F.sum("e0").alias("e0"), F.sum("e1").alias("e1"))
    u = u.persist()         # counted, then held by the tasks
    sums = embed_examples(examples, u, 2, id_col).select(id_col, F.col("x0").alias("_t0"), F.col("x1").alias("_t1"))
    u.unpersist()
    rest = Dense(dense.W[E:], dense.b, 0, dense.num_cols)
    x = examples.drop("entries", "n_ids", *ENTRY).join(sums, id_col, "left").na.fill(0.0, ["_t0", "_t1", *rest.inputs()])
    z = logits(rest)
    return softmax(x.withColumn("z0", F.col("_t0") + z[0]).withColumn("z1", F.col("_t1") + z[1]).drop("_t0", "_t1"))


def softmax(y: DataFrame) -> DataFrame:
    """``p0, p1`` of the logits ``z0, z1``."""
    m = F.greatest("z0", "z1")
    e0, e1 = F.exp(F.col("z0") - m), F.exp(F.col("z1") - m)
    return y.withColumn("p0", e0 / (e0 + e1)).withColumn("p1", e1 / (e0 + e1))


def loss_frame(pred: DataFrame, dense: Dense, reg_lambda: float, l1: bool = True,
               label: str = "label") -> DataFrame:
    """Mean clipped cross entropy plus the L1 (or L2/2) weight term."""
    eps = 1e-15
    p = F.when(F.col(label) == 1, F.col("p1")).otherwise(F.col("p0"))
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    reg = reg_lambda * (float(np.abs(dense.W).sum()) if l1 else 0.5 * float((dense.W ** 2).sum()))
    return pred.agg((F.avg(-F.log(p)) + F.lit(reg)).alias("loss"), F.count("*").alias("n"))


# --- training (M7, M8, M10) -----------------------------------------------------

@dataclass
class TrainConfig:
    emb_size: int = 50
    lr: float = 0.01
    reg_lambda: float = 1e-4
    max_grad_norm: float = 1.0
    dropout: float = 0.0
    epochs: int = 3
    batch_size: int | None = 32     # None: one batch per epoch
    seed: int = 0
    with_features: bool = True      # M7 (L1, clip, mean grad) vs M8 (L2, sum grad)
    per_distinct: bool = True       # D15: one update per distinct bucket vs per occurrence


MERGE_EVERY = 8               # steps after which the embedding table's deltas are merged
BROADCAST_ENTRIES = 1 << 20   # a batch's (document, bucket) entries that may be broadcast
BLOCK_ENTRIES = 1 << 24       # entries of consecutive batches that one task may hold (10 to 12 bytes each)
BLOCKS_A_TASK = 8             # so many it may step through before it writes the table
PART_ENTRIES = 1 << 20        # entries of one batch that a task packs together
NEAR_BATCHES = 16             # consecutive batches that a task deals, where there are enough for all tasks
ENTRY = {"bucket": np.int32, "w": np.float64, "occ": np.int32}      # what an entry holds, and its numbers as bytes
ENTRIES = "entries array<struct<bucket: long, w: double, occ: long>>"


def as_examples(weights: DataFrame, x_num: DataFrame, labels: DataFrame, num_cols: list[str],
                id_col: str = "doc_id") -> DataFrame:
    """One row per labelled document: ``id, label, n_ids, entries`` and its numeric inputs ``z_*``."""
    packed = weights.groupBy(id_col).agg(
        F.max("n_ids").alias("n_ids"),
        F.collect_list(F.struct(F.col("bucket").cast("long").alias("bucket"), "w",
                                F.col("occ").cast("long").alias("occ"))).alias("entries"))
    return (labels.select(id_col, "label").join(packed, id_col, "left")
            .join(x_num.select(id_col, *[f"z_{c}" for c in num_cols]), id_col, "left"))


def entries_of(examples: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_ids, bucket, w, occ)`` of every kept id of the examples."""
    return examples.select(id_col, "n_ids", F.inline("entries"))


def entry_arrays(examples: DataFrame, *names: str) -> list[Column]:
    """The entries as arrays or their bytes, one for each of ``names`` (all): less than structs in a shuffle or a task."""
    return [F.col(c if c in examples.columns else f"entries.{c}").alias(c) for c in names or ENTRY]


def _held(df: DataFrame, name: str = "bucket") -> bool:
    """Whether the entries are held as bytes."""
    return name in df.columns and df.schema[name].dataType.simpleString() == "binary"


def n_entries(df: DataFrame) -> Column:
    """How many entries a row of :func:`entry_arrays` has."""
    return F.coalesce((F.octet_length("bucket") / F.lit(ENTRY["bucket"]().itemsize)).cast("long") if _held(df)
                      else F.greatest(F.size("bucket"), F.lit(0)).cast("long"), F.lit(0).cast("long"))


def with_structs(examples: DataFrame) -> DataFrame:
    """Examples with :func:`entry_arrays`: with ``entries`` in their place, null where there are none."""
    own = [c for c in ENTRY if c in examples.columns]
    rest = [c for c in examples.columns if c not in own]
    if not _held(examples):
        return examples.select(*rest, F.arrays_zip(*own).alias("entries"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in examples.select(*rest).schema]

    def run(batches):
        for got in batches:
            flat = {c: _entry_numbers(got, c) for c in own}
            ends = np.cumsum(np.r_[0, flat["bucket"][1]])
            ends = pa.array(ends, pa.int32(), mask=np.r_[flat["bucket"][1] == 0, False])
            structs = pa.StructArray.from_arrays([pa.array(v.astype(np.float64 if c == "w" else np.int64)) for c, (v, _) in flat.items()], own)
            yield pa.record_batch([*(got.column(c) for c in rest), pa.ListArray.from_arrays(ends, structs)], [*rest, "entries"])
    kind = ENTRIES if len(own) == len(ENTRY) else ENTRIES.replace(", occ: long", "")
    return examples.select(*rest, *own).mapInArrow(run, ", ".join([*kinds, kind]))


def _entry_numbers(got: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of arrays or their bytes, and how many each row has."""
    col = got.column(name)
    if pa.types.is_list(col.type):
        return _flat(got, name), np.diff(col.offsets.to_numpy()).astype(np.int64)
    _, ends, data = col.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return data.view(ENTRY[name]), np.diff(ends).astype(np.int64) // ENTRY[name]().itemsize


def inputs(examples: DataFrame, table: DataFrame, dense: Dense, id_col: str = "doc_id",
           small: bool = False) -> DataFrame:
    """``id, label, x*, z_*``: the dense layer's inputs; documents without ids have a zero embedding.

    ``table`` may hold several rows of a bucket, whose sum is its vector.
    """
    ent = entries_of(examples, id_col).select(id_col, "bucket", "w")
    emb = embed_docs(F.broadcast(ent) if small else ent, table, dense.emb_size, id_col)
    return fused(examples.drop("entries", "n_ids", *ENTRY), emb, dense, id_col)


def fused(rows: DataFrame, emb: DataFrame, dense: Dense, id_col: str = "doc_id") -> DataFrame:
    """The rows ``id, label, z_*`` and their embeddings ``x*``, a zero one where there is none."""
    return rows.join(emb, id_col, "left").na.fill(0.0, dense.inputs())


def train(weights: DataFrame, x_num: DataFrame, labels: DataFrame, cfg: TrainConfig,
          num_cols: list[str], id_col: str = "doc_id", val: tuple[DataFrame, DataFrame, DataFrame] | None = None,
          buckets: DataFrame | None = None):
    """:func:`train_examples` on separate tables of weights, numeric inputs and labels."""
    return train_examples(as_examples(weights, x_num, labels, num_cols, id_col), cfg, num_cols, id_col,
                          None if val is None else as_examples(*val, num_cols, id_col), buckets)


def train_examples(examples: DataFrame, cfg: TrainConfig, num_cols: list[str], id_col: str = "doc_id",
                   val: DataFrame | None = None, buckets: DataFrame | None = None, block_entries: int = 0,
                   written: bool = False):
    """Epochs of mini-batch gradient steps. Returns (vocab, dense, history).

    ``examples`` is :func:`as_examples`; its rows are shuffled anew each epoch, cut
    into exact batches (C19) and written with one folder per batch, so a step
    reads its batch and nothing else of the examples. With ``written`` they are read from
    a stored table, so no copy is made before. ``buckets`` holds the
    embedding table's rows (the mask), by default those of the examples. The table is
    a base and the last steps' deltas: an embedding is linear in it, so a step
    joins its batch's entries to all of them at once, and writes a delta with the rows of
    its batch's buckets; every ``MERGE_EVERY`` steps they are summed into a new
    base. Documents' ids are unique and not null.

    Steps follow one another, and a small one is mostly the starting of jobs. So consecutive
    batches are a block, whose steps one task makes (:func:`_block`) with the table, which is bounded: it reads the batches in
    their order and holds at most ``block_entries`` entries, and ``BLOCKS_A_TASK`` times as many pass through it. A
    batch above ``block_entries`` is a step of its own, spread over the cluster. What a step needs of its batch's texts is
    laid out before, by the tasks that deal the batches (:func:`packed_parts`), so the one task only adds and multiplies.
    """
    spark = examples.sparkSession
    E = cfg.emb_size
    dense_cols = num_cols if cfg.with_features else []
    entry = ["bucket", "w"] if cfg.per_distinct else list(ENTRY)
    examples = examples.select(id_col, "label", "n_ids", *entry_arrays(examples, *entry), *[f"z_{c}" for c in dense_cols])
    if not written:
        examples = write_shared(examples, "train-examples")
    if buckets is None:
        buckets = entries_of(with_structs(examples), id_col)
    base, blobs, known = init_table(buckets.select("bucket"), E, cfg.seed), None, 0
    if block_entries:           # the table as blocks take and leave it, and how many vectors it has
        blobs = write_shared(vector_blobs(base, E), "train-base")
        known = blobs.agg(F.coalesce(F.sum(n_entries(blobs)), F.lit(0))).first()[0]
        base = vector_columns(blobs, E)
    else:
        base = write_shared(base, "train-base").persist()
    deltas: list[DataFrame] = []

    def table():
        out = base
        for d in deltas:
            out = out.unionByName(d)
        return out

    def merged():
        return base if not deltas else table().groupBy("bucket").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(E)])
    dense = Dense(init_dense(E + len(dense_cols), 2, cfg.seed, xavier=cfg.with_features), np.zeros(2), E, dense_cols)
    history = []
    n_rows, total = examples.agg(F.count("*"), F.sum(n_entries(examples))).first()
    size = cfg.batch_size or max(n_rows, 1)
    n_batches = -(-n_rows // size)
    near = min(NEAR_BATCHES, max(1, n_batches // (8 * spark.sparkContext.defaultParallelism))) if block_entries else 1
    per = max(1, block_entries * n_batches // (4 * max(total or 0, 1)))       # batches a folder: a block reads few others
    for epoch in range(cfg.epochs if n_rows else 0):
        dealt, wide = epoch_batches(examples, epoch, size, id_col, size * near, [id_col, "label", "n_ids"]), None
        folder = shared_dir(spark, f"train-epoch{epoch}-{uuid.uuid4().hex[:12]}")
        if block_entries:
            parts = pack(dealt, dense, cfg, epoch, id_col).withColumn("part", F.floor(F.col("batch_id") / per))
            parts.write.partitionBy("part").option("compression", "zstd").parquet(f"{folder}/packed")
            parts = spark.read.schema(parts.schema).parquet(f"{folder}/packed")
            laid = {r[0]: (r[1], r[2]) for r in parts.groupBy("batch_id").agg(F.sum("entries"), F.sum("docs")).collect()}
            sizes = {i: n for i, (n, _) in laid.items()}
            wide = [i for i, n in sizes.items() if n > block_entries]
        if wide is None or wide:
            rows = dealt if wide is None else dealt.where(F.col("batch_id").isin(wide))
            rows.write.partitionBy("batch_id").parquet(f"{folder}/rows")
        if wide is None:
            rows = spark.read.schema(dealt.schema).parquet(f"{folder}/rows")
            sizes = dict(rows.groupBy("batch_id").agg(F.sum(n_entries(rows))).collect())
        for bi, end in _blocks([sizes[i] for i in range(n_batches)], block_entries):
            if block_entries and sizes[bi] <= block_entries:
                if blobs is None:
                    blobs = write_shared(vector_blobs(merged(), E), "train-base")
                    known = blobs.agg(F.sum(n_entries(blobs))).first()[0]
                own = [spark.read.schema(parts.drop("part").schema).parquet(f"{folder}/packed/part={i}").where(
                    F.col("batch_id").between(bi, end - 1)) for i in range(bi // per, (end - 1) // per + 1)]
                blobs, known = _block(own, blobs, known, {i: laid[i] for i in range(bi, end)}, dense, cfg, epoch, history)
                base, deltas = vector_columns(blobs, E), []
                continue
            batch = with_structs(spark.read.schema(dealt.drop("batch_id").schema).parquet(f"{folder}/rows/batch_id={bi}"))
            x = inputs(batch, table(), dense, id_col, max(sizes.values()) <= BROADCAST_ENTRIES)
            delta, loss = _step(x, batch, dense, cfg, f"{cfg.seed}:{epoch}:{bi}", id_col)
            history.append((epoch, bi, "train", loss))
            deltas.append(delta)
            blobs = None
            if len(deltas) >= MERGE_EVERY:
                old, base = base, write_shared(merged(), "train-base").persist()
                deltas = []
                old.unpersist()
        if val is not None:
            lv = loss_frame(predict_examples(val, table(), dense, id_col), dense, cfg.reg_lambda, cfg.with_features).first()
            if lv["n"]:
                history.append((epoch, -1, "validation", float(lv["loss"])))
    vocab = write_shared(merged(), "train-vocab") if deltas else base
    base.unpersist()
    return vocab, dense, spark.createDataFrame(history, "epoch int, batch int, split string, loss double")


def _step(x: DataFrame, batch: DataFrame, dense: Dense, cfg: TrainConfig, key: str, id_col: str) -> tuple[DataFrame, float]:
    """One gradient step: changes ``dense``, returns the embedding table's delta and the batch's loss."""
    cols, E = dense.inputs(), dense.emb_size
    if cfg.dropout > 0:
        x = x.select(id_col, "label", *[(F.col(c) * dropout_keep(
            F.concat_ws(":", F.lit(key), F.col(id_col).cast("string"), F.lit(c)), cfg.dropout)).alias(c) for c in cols])
    pr = predict(x, dense).withColumns({
        f"g{k}": F.col(f"p{k}") - F.when(F.col("label") == k, 1.0).otherwise(0.0) for k in (0, 1)})
    pr = pr.select(id_col, "label", "p0", "p1", "g0", "g1", *cols).persist()
    eps = 1e-15
    p = F.least(F.greatest(F.when(F.col("label") == 1, F.col("p1")).otherwise(F.col("p0")), F.lit(eps)), F.lit(1 - eps))
    aggs = [F.sum(F.col(c) * F.col(f"g{k}")).alias(f"d_{j}_{k}") for j, c in enumerate(cols) for k in (0, 1)]
    r = pr.agg(*aggs, F.sum("g0").alias("db0"), F.sum("g1").alias("db1"), F.avg(-F.log(p)).alias("ce"),
               F.count("*").alias("n")).first()
    scale = 1.0 / r["n"] if cfg.with_features else 1.0
    reg = cfg.reg_lambda * (np.abs(dense.W).sum() if cfg.with_features else 0.5 * (dense.W ** 2).sum())
    dW = scale * np.array([[r[f"d_{j}_{k}"] for k in (0, 1)] for j in range(len(cols))], dtype=float)
    dense.W, dense.b = updated(dense.W, dense.b, dW, scale * np.array([r["db0"], r["db1"]]), cfg)
    # embedding step with the updated weights: dx = g @ W_new^T (embedding rows)
    # Once per distinct bucket of a document, or once per occurrence
    mult = F.lit(-cfg.lr * scale) * (F.lit(1.0) if cfg.per_distinct else F.col("occ")) / F.col("n_ids")
    both = entries_of(batch, id_col).join(pr.select(id_col, "g0", "g1"), id_col)
    sums = both.groupBy("bucket").agg(F.sum(F.col("g0") * mult).alias("s0"), F.sum(F.col("g1") * mult).alias("s1"))
    delta = sums.select("bucket", *[(F.col("s0") * F.lit(float(dense.W[k, 0])) + F.col("s1") * F.lit(float(dense.W[k, 1])))
                                    .alias(f"e{k}") for k in range(E)])
    delta = write_shared(delta, "train-delta")
    pr.unpersist()
    return delta, float(r["ce"]) + float(reg)


def _blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive batches ``[first, end)`` of at most ``BLOCKS_A_TASK * most`` entries together; one above ``most`` is alone."""
    out, total = [], 0
    for i, n in enumerate(sizes):
        if out and max(n, sizes[i - 1]) <= most and 0 < total + n <= BLOCKS_A_TASK * most:
            out[-1] = (out[-1][0], i + 1)
            total += n
        else:
            out.append((i, i + 1))
            total = n
    return out


PACKED = {"batch_id": "long", "entries": "long", "docs": "long", "id": "array<string>", "label": "binary", "n_ids": "binary", "size": "binary",
          "z": "binary", "keep": "binary", "bucket": "binary", "col": "binary", "w": "binary", "occ": "binary"}


def pack(dealt: DataFrame, dense: Dense, cfg: TrainConfig, epoch: int, id_col: str) -> DataFrame:
    """The documents of each batch together, as :func:`packed_parts` lays them out."""
    E, cols = dense.emb_size, dense.inputs()
    keep = [dropout_keep(F.concat_ws(":", F.lit(f"{cfg.seed}:{epoch}"), F.col("batch_id").cast("string"),
                                     F.col(id_col).cast("string"), F.lit(c)), cfg.dropout) for c in cols]

    def held(c, t):
        return F.coalesce(F.col(c), F.lit(b"")).alias(c) if _held(dealt) else F.coalesce(
            F.col(c).cast(f"array<{t}>"), F.array().cast(f"array<{t}>")).alias(c)
    docs = dealt.na.fill(0.0, cols[E:]).select(
        "batch_id", F.col(id_col).cast("string").alias("id"),
        F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(-1).cast("int").alias("label"),
        F.col("n_ids").cast("double").alias("n_ids"), F.array(*cols[E:]).cast("array<double>").alias("z"),
        (F.array(*keep) if cfg.dropout > 0 else F.array().cast("array<double>")).alias("keep"),
        held("bucket", "int"), held("w", "double"),
        F.array().cast("array<int>").alias("occ") if cfg.per_distinct else held("occ", "int"))
    return docs.mapInArrow(packed_parts, ", ".join(f"{c} {t}" for c, t in PACKED.items()))


def packed_parts(batches):
    """For documents of batches: a row per run of one batch's, at most ``PART_ENTRIES`` entries or a document.

    ``bucket`` has the run's distinct buckets, ascending; ``col`` the place of each entry's among them.
    """
    for got in batches:
        if not got.num_rows:
            continue
        batch, many = got.column("batch_id").to_numpy(), _entry_numbers(got, "bucket")[1]
        ends = np.cumsum(many) // PART_ENTRIES
        cuts = np.r_[0, np.flatnonzero((batch[1:] != batch[:-1]) | (ends[1:] != ends[:-1])) + 1, got.num_rows].tolist()
        for a, z in zip(cuts, cuts[1:]):
            part = got.slice(a, z - a)
            bucket = _entry_numbers(part, "bucket")[0]
            seen = np.zeros(int(bucket.max(initial=-1)) + 1, bool)
            seen[bucket] = True
            own = np.flatnonzero(seen).astype(np.int32)      # bounded by the bucket count
            place = np.zeros(len(seen), np.uint16 if len(own) <= 1 << 16 else np.int32)
            place[own] = np.arange(len(own))
            row = {"batch_id": int(batch[a]), "entries": len(bucket), "docs": z - a, "id": part.column("id").to_pylist(),
                   "label": part.column("label").to_numpy().astype(np.int8), "n_ids": part.column("n_ids").to_numpy(zero_copy_only=False),
                   "size": many[a:z], "bucket": own, "col": place[bucket], "w": _entry_numbers(part, "w")[0],
                   "occ": _entry_numbers(part, "occ")[0], **{c: _flat(part, c) for c in ("z", "keep")}}
            yield _row(PACKED, row)


def _row(kinds: dict[str, str], row: dict) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.record_batch([pa.array([v.tobytes() if isinstance(v := row[c], np.ndarray) else v], types[t]) for c, t in kinds.items()],
                           [*kinds])


def _numbers(got: pa.RecordBatch, name: str, i: int, kind=np.float64) -> np.ndarray:
    """The numbers in a row's bytes, which are not copied."""
    return np.frombuffer(got.column(name)[i].as_buffer(), kind)


VECTORS = {"kind": "int", "at": "long", "bucket": "binary", "w": "binary"}
VECTORS_AT_ONCE = 4096


def vector_blobs(table: DataFrame, emb_size: int) -> DataFrame:
    """The rows ``(bucket, e0..)`` as :data:`VECTORS`: many vectors a row, of ``kind`` 0."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, VECTORS_AT_ONCE):
                got = whole.slice(at, VECTORS_AT_ONCE)
                yield _row(VECTORS, {"kind": 0, "at": 0, "bucket": got.column(0).to_numpy().astype(np.int32),
                                     "w": np.stack([c.to_numpy(zero_copy_only=False) for c in got.columns[1:]], 1)})
    return table.select(F.col("bucket").cast("long"), *[f"e{k}" for k in range(emb_size)]).mapInArrow(
        run, ", ".join(f"{c} {t}" for c, t in VECTORS.items()))


def vector_columns(blobs: DataFrame, emb_size: int) -> DataFrame:
    """The vectors of :data:`VECTORS` as rows ``(bucket, e0..)``."""
    names = [f"e{k}" for k in range(emb_size)]

    def run(batches):
        for got in batches:
            for i in range(got.num_rows):
                v = _numbers(got, "w", i).reshape(-1, emb_size)
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(got, "bucket", i, np.int32).astype(np.int64)),
                                                  *(pa.array(c) for c in v.T.copy())], ["bucket", *names])
    return blobs.where("kind = 0").mapInArrow(run, ", ".join(["bucket long", *[f"{c} double" for c in names]]))


def _block(parts: list[DataFrame], blobs: DataFrame, known: int, want: dict[int, tuple[int, int]], dense: Dense,
           cfg: TrainConfig, epoch: int, history: list) -> tuple[DataFrame, int]:
    """The steps of a block of packed batches, in one task: changes ``dense``, adds the losses to ``history``, returns
    the table as :data:`VECTORS` and how many vectors it has.

    ``parts`` are read one after another, the table before them; ``want`` has each batch's entries and documents.
    """
    rows = blobs.where("kind = 0").select(F.lit(-1).cast("long").alias("batch_id"), *[
        F.col(c) if c in ("bucket", "w") else F.lit(None).cast(t).alias(c) for c, t in PACKED.items() if c != "batch_id"])
    for part in parts:
        rows = rows.unionByName(part)
    steps = BlockSteps(dense.W, dense.b, dense.emb_size, cfg, known, want)
    out = write_shared(rows.coalesce(1).mapInArrow(steps, ", ".join(f"{c} {t}" for c, t in VECTORS.items())), "train-base")
    told = {(r["kind"], r["at"]): np.frombuffer(r["w"]) for r in out.where("kind > 0").select("kind", "at", "w").collect()}
    dense.W, dense.b = told[1, 0].reshape(-1, 2).copy(), told[1, 1].copy()
    history.extend((epoch, bi, "train", float(told[2, bi][0])) for kind, bi in sorted(told) if kind == 2)
    return out, int(told[3, 0][0])


cloudpickle.register_pickle_by_value(sys.modules[__name__])     # a block's task needs no copy of this package


class BlockSteps:
    """What the task of a block does; sent to it with the dense layer's weights."""

    def __init__(self, W: np.ndarray, b: np.ndarray, emb_size: int, cfg: TrainConfig, known: int, want: dict[int, tuple[int, int]]):
        self.W, self.b, self.emb_size, self.cfg, self.known, self.want = W, b, emb_size, cfg, known, want

    def __call__(self, batches):
        E = self.emb_size
        self.ids, self.vectors, self.taken = np.zeros(0, np.int64), np.zeros((self.known, E)), np.zeros((0, E))
        self.place = np.zeros(0, np.int64)          # of each bucket's vector, -1 without one; bounded by the bucket count
        tables, waiting, losses, left = [], {}, {}, sorted(self.want, reverse=True)
        for got in batches:
            for i, bi in enumerate(got.column("batch_id").to_pylist()):
                if bi < 0:
                    k, at = _numbers(got, "bucket", i, np.int32), sum(map(len, tables))
                    self.vectors[at:at + len(k)] = _numbers(got, "w", i).reshape(-1, E)
                    tables.append(k.astype(np.int64))
                    if at + len(k) == self.known:
                        self.add(np.concatenate(tables))
                    continue
                part = {"id": got.column("id")[i].as_py(), "label": _numbers(got, "label", i, np.int8),
                        "size": _numbers(got, "size", i, np.int64), "bucket": _numbers(got, "bucket", i, np.int32),
                        "occ": _numbers(got, "occ", i, np.int32), **{c: _numbers(got, c, i) for c in ("n_ids", "z", "keep", "w")}}
                part["col"] = _numbers(got, "col", i, np.uint16 if len(part["bucket"]) <= 1 << 16 else np.int32)
                waiting.setdefault(bi, []).append(part)
            # a batch's step is made when the table and all its parts are here, in whatever order they came
            while left and len(self.ids) >= self.known and left[-1] in waiting and self.want[left[-1]] == (
                    sum(len(p["w"]) for p in waiting[left[-1]]), sum(len(p["label"]) for p in waiting[left[-1]])):
                parts = waiting.pop(bi := left.pop())
                for p in parts:
                    self.add(p["bucket"][p["bucket"] >= len(self.place)])
                    self.add(p["bucket"][self.place[p["bucket"]] < 0])
                    p["at"] = self.place[p["bucket"]]
                losses[bi] = self.step(sorted(parts, key=lambda p: str(p["id"][:1])), self.vectors)
        if left:
            raise ValueError(f"batches {left[::-1][:5]} are not whole")
        for at, w in ((0, self.W), (1, self.b)):
            yield _row(VECTORS, {"kind": 1, "at": at, "bucket": None, "w": w.ravel()})
        for bi, x in losses.items():
            yield _row(VECTORS, {"kind": 2, "at": bi, "bucket": None, "w": np.array([x])})
        yield _row(VECTORS, {"kind": 3, "at": 0, "bucket": None, "w": np.array([float(len(self.ids))])})
        for at in range(0, len(self.ids), VECTORS_AT_ONCE):
            yield _row(VECTORS, {"kind": 0, "at": 0, "bucket": self.ids[at:at + VECTORS_AT_ONCE].astype(np.int32),
                                 "w": self.vectors[at:at + VECTORS_AT_ONCE]})

    def add(self, buckets: np.ndarray):
        """New buckets; a vector that is not there yet is zero."""
        if not len(buckets):
            return
        more = np.full(max(int(buckets.max()) + 1 - len(self.place), 0), -1)
        self.place = np.r_[self.place, more]
        self.place[buckets] = np.arange(len(self.ids), len(self.ids) + len(buckets))
        self.ids = np.r_[self.ids, buckets]
        if len(self.ids) > len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros((len(self.ids) - len(self.vectors), self.emb_size))])

    def step(self, parts: list[dict], vectors: np.ndarray) -> float:
        """The step of a batch; documents of one id share its entries.

        The batch's sums over entries are numbers, not vectors: logits and the dense layer's gradient are linear in the
        table, so vectors are read and changed once a distinct bucket. Dropout makes the inputs of each document its own, so
        then they are summed as vectors.
        """
        cfg, E = self.cfg, self.emb_size
        label, n_ids = (np.concatenate([p[c] for p in parts]) for c in ("label", "n_ids"))
        n = len(label)
        z, keep = (np.concatenate([p[c] for p in parts]).reshape(n, -1) for c in ("z", "keep"))
        own, doc = np.unique(np.array([i for p in parts for i in p["id"]], object).astype(str), return_inverse=True)
        ends = np.cumsum([len(p["label"]) for p in parts]).tolist()
        rows = list(zip(parts, map(slice, [0, *ends], ends)))

        def shared(v):          # of the rows of an id, their sum
            return v if len(own) == n else np.stack([np.bincount(doc, c, len(own)) for c in v.T], 1)[doc]

        def of(part):           # the vectors of its buckets
            if len(self.taken) < len(part["at"]):
                self.taken = np.zeros((len(part["at"]), E))
            v = self.taken[:len(part["at"])]
            if self.holds is not part:
                np.take(vectors, part["at"], 0, out=v, mode="clip")
                self.holds = part
            return v
        self.holds = None
        x = np.zeros((n, E if cfg.dropout > 0 else 1))
        to_diff = self.W[:E, 1:] - self.W[:E, :1]
        for p, at in rows:
            if cfg.dropout > 0:
                v, cuts = of(p), np.r_[0, np.cumsum(p["size"])].tolist()
                for i, (a, e) in enumerate(zip(cuts, cuts[1:]), at.start):
                    x[i] = p["w"][a:e] @ v.take(p["col"][a:e], 0)
            else:
                x[at, 0] = _row_sums(p["w"] * (of(p) @ to_diff)[:, 0][p["col"]], p["size"])
        x = shared(x)
        if cfg.dropout > 0:
            x = np.hstack([x, z]) * keep
            diff = x @ (self.W[:, 1] - self.W[:, 0])
        else:
            diff = x[:, 0] + z @ (self.W[E:, 1] - self.W[E:, 0])
        p = np.exp(np.outer(diff + self.b[1] - self.b[0], [0, 1]) - np.maximum(diff + self.b[1] - self.b[0], 0)[:, None])
        p /= p.sum(1, keepdims=True)
        g = p - (label[:, None] == np.arange(2))
        loss = -np.log(np.clip(np.where(label == 1, p[:, 1], p[:, 0]), 1e-15, 1 - 1e-15)).mean()
        scale = 1.0 / n if cfg.with_features else 1.0
        reg = cfg.reg_lambda * (np.abs(self.W).sum() if cfg.with_features else 0.5 * (self.W ** 2).sum())
        mirrored = bool((label >= 0).all())         # then a row of ``g`` sums to zero, and one class tells the other
        told = shared(g[:, 1:] if mirrored else g)

        def both(d):
            return np.hstack([-d, d]) if mirrored else d
        if cfg.dropout > 0:
            dW = x.T @ g
        else:
            dW = np.zeros((E, told.shape[1]))
            for part, at in reversed(rows):         # the last one's vectors are still there
                dW += of(part).T @ np.stack([np.bincount(part["col"], np.repeat(c, part["size"]) * part["w"], len(part["at"]))
                                             for c in told[at].T], 1)
            dW = np.vstack([both(dW), z.T @ g])
        self.W, self.b = updated(self.W, self.b, scale * dW, scale * g.sum(0), cfg)
        moves = (self.W[:E, 1:] - self.W[:E, :1] if mirrored else self.W[:E]).T
        told = told * (-cfg.lr * scale / np.where(n_ids > 0, n_ids, 1.0))[:, None]
        for part, at in rows:                       # the first one's vectors are still there
            v, many = of(part), 1 if cfg.per_distinct else part["occ"]
            sums = np.stack([np.bincount(part["col"], np.repeat(c, part["size"]) * many, len(v)) for c in told[at].T], 1)
            for a in range(0, len(v), 1024):
                some = sums[a:a + 1024]
                vectors[part["at"][a:a + 1024]] = v[a:a + 1024] + (some * moves if mirrored else some @ moves)
            self.holds = None
        return float(loss + reg)


def _row_sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sums of consecutive values, ``size`` of each row."""
    out, has = np.zeros(len(size)), size > 0
    if has.any():
        out[has] = np.add.reduceat(values, (np.cumsum(size) - size)[has])
    return out


def _flat(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).flatten().to_numpy(zero_copy_only=False)


def updated(W: np.ndarray, b: np.ndarray, dW: np.ndarray, db: np.ndarray, cfg: TrainConfig) -> tuple[np.ndarray, np.ndarray]:
    """The dense layer after a step: L1 and clipping with features (M7), L2 without (M8)."""
    if cfg.with_features:
        dW = dW + cfg.reg_lambda * np.sign(W)
        gn = float(np.linalg.norm(dW))
        if gn > cfg.max_grad_norm:
            dW = dW * (cfg.max_grad_norm / gn)
    else:
        dW = dW + cfg.reg_lambda * W
    return W - cfg.lr * dW, b - cfg.lr * db


# --- collapse and impact (M13, E1..E6) ----------------------------------------------

def collapse(vocab: DataFrame, dense: Dense, grams: DataFrame) -> DataFrame:
    """U[g] = vocab[bucket(g)] @ W[:E] for the kept grams ``(ngram, bucket)``."""
    E = dense.emb_size
    j = grams.join(vocab, "bucket")
    u = [sum((F.col(f"e{k}") * F.lit(float(dense.W[k, c])) for k in range(E)), F.lit(0.0)) for c in (0, 1)]
    return j.select("ngram", u[0].alias("u0"), u[1].alias("u1"))


def word_gram_diffs(words: DataFrame, grams: Column, diff: Column | DataFrame, buckets: int) -> DataFrame:
    """``(word, ngram, diff, n_occ)`` of distinct words and their distinct n-grams.

    ``words`` is ``(word, n_occ)``; ``diff`` is an expression over ``bucket``, or a
    table ``(bucket, diff)`` outside of which n-grams have none. A gram's diff
    depends only on its bucket, so every occurrence of a word carries the same
    diffs, and each distinct n-gram is hashed and valued once.
    """
    wg = words.select("word", "n_occ", F.explode(F.array_distinct(grams)).alias("ngram"))
    hashed = with_bucket(wg.select("ngram").distinct(), "ngram", "bucket", buckets).where("bucket <> 0")
    valued = hashed.withColumn("diff", diff) if isinstance(diff, Column) else hashed.join(diff, "bucket")
    return wg.join(valued.select("ngram", "diff"), "ngram")


def trained_diff(vocab: DataFrame, dense: Dense) -> DataFrame:
    """``(bucket, diff)``: vocab[bucket] . (w1 - w0)[:E] of a trained table."""
    wd = dense.W[:dense.emb_size, 1] - dense.W[:dense.emb_size, 0]
    return vocab.select("bucket", sum((F.col(f"e{k}") * F.lit(float(wd[k])) for k in range(dense.emb_size)),
                                      F.lit(0.0)).alias("diff"))


def initial_diff(dense: Dense, seed: int = 0) -> Column:
    """vocab[bucket] . (w1 - w0)[:E] for the initial table, as an expression over ``bucket``."""
    wd = dense.W[:dense.emb_size, 1] - dense.W[:dense.emb_size, 0]
    return sum((init_value(F.col("bucket"), k, seed) * F.lit(float(wd[k])) for k in range(dense.emb_size)), F.lit(0.0))


def gram_word_impact_weighted(wdiffs: DataFrame) -> DataFrame:
    """E1 from per-word rows: the mean over occurrences is the gram's diff."""
    return wdiffs.select("ngram", "word", F.col("diff").alias("impact"), F.col("n_occ").alias("n"))


def gram_table_weighted(wdiffs: DataFrame, k: int = 50) -> DataFrame:
    """E4 from per-word rows: weighted count, mean and sample std (0 for one value)."""
    g = wdiffs.groupBy("ngram").agg(F.sum("n_occ").alias("count"),
                                    F.sum(F.col("n_occ") * F.col("diff")).alias("s1"),
                                    F.sum(F.col("n_occ") * F.col("diff") * F.col("diff")).alias("s2"))
    mean = F.col("s1") / F.col("count")
    var = (F.col("s2") - F.col("count") * mean * mean) / (F.col("count") - 1)
    g = g.select("ngram", mean.alias("mean"),
                 F.when(F.col("count") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0).alias("std"),
                 "count")
    return g.withColumn("abs_mean", F.abs("mean")).orderBy(F.desc(F.round("abs_mean", 12)), "ngram").limit(k)


def word_strength_weighted(wdiffs: DataFrame, words: DataFrame, k: int = 50) -> DataFrame:
    """E5 from per-word rows: every occurrence of a word has the same summed diff."""
    per_word = wdiffs.groupBy("word").agg(F.sum("diff").alias("avg_strength"))
    w = words.select("word", F.col("n_occ").alias("count")).join(per_word, "word", "left").na.fill(0.0, ["avg_strength"])
    return w.withColumn("abs_strength", F.abs("avg_strength")).orderBy(
        F.desc(F.round("abs_strength", 12)), "word").limit(k).select("word", "avg_strength", "count", "abs_strength")


def best_word_per_gram(impact: DataFrame) -> DataFrame:
    """The word with the largest |mean| per gram (ties, to 12 places: smaller word)."""
    key = F.struct((-F.round(F.abs(F.col("impact")), 12)).alias("k"), F.col("word"))
    return impact.groupBy("ngram").agg(F.min_by(F.struct("word", "impact"), key).alias("b")) \
        .select("ngram", F.col("b.word").alias("word"), F.col("b.impact").alias("impact"))


def top_impacts(best: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` largest |impact| (a top-k report; ties by gram)."""
    return best.orderBy(F.desc(F.round(F.abs("impact"), 12)), "ngram").limit(k)


