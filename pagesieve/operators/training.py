"""Prepared training inputs and stored models (M3..M13, E1..E6 read them, S9 exports one).

Documents are tokenized and encoded once: the word counts per document, the mask
of the training split and one row of entries and features per document are tables
in the shared folder, under a name made of the data's fingerprint and the
settings. A trained model is stored in the same way: the bucket vectors, the
dense layer, the scaler, the mask and the loss history. A table that was written
to its end is used again by every study; a run that died leaves a table without
its success mark, which is written anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import grams
from ..functions import hashing as H
from ..session import is_written, shared_dir
from . import clean as CL
from . import features as FE
from . import model as MD
from . import ngrams as NG

TEST_SHARE = 0.2
SPLIT_SEED = 42


@dataclass(frozen=True)
class Inputs:
    """How documents are encoded. ``masked``: only ids of the training split's frequent n-grams."""
    masked: bool = True
    min_n: int = 3
    max_n: int = 4
    min_freq: int = 3
    buckets: int = H.DEFAULT_BUCKETS


@dataclass
class Prepared:
    """``rows``: doc_id, label, split, z_*; ``texts``: doc_id and the counted words of each text."""
    version: str
    rows: DataFrame
    texts: DataFrame
    how: Inputs
    mask: DataFrame | None
    scaler: dict[str, tuple[float, float]]
    word_ids_at: str
    examples_at: str

    @property
    def words(self) -> DataFrame:
        """``doc_id, n_words, word, n`` of each text's distinct words."""
        return self.texts.select("doc_id", "counted.n_words", F.inline("counted.words"))

    @property
    def word_ids(self) -> DataFrame:
        """``word, n_ids_w, ids``, written when they are first asked for."""
        return stored(self.rows.sparkSession, self.word_ids_at, lambda: ids_of_words(self.words, self.how, self.mask))

    @property
    def examples(self) -> DataFrame:
        """``rows`` with each document's n_ids and entries."""
        return MD.with_structs(self.packed)

    @property
    def packed(self) -> DataFrame:
        """The examples with the bytes of their entries (:data:`model.ENTRY`), written when they are first asked for."""
        return stored(self.rows.sparkSession, self.examples_at,
                      lambda: with_entries(self.rows, self.texts, self.how, self.mask, apart=True))


@dataclass
class StoredModel:
    prepared: Prepared
    vocab: DataFrame
    dense: MD.Dense
    history: DataFrame


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; written by ``build`` unless it is there whole."""
    if not is_written(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def version_of(docs: DataFrame, *settings) -> str:
    """A name for the rows of ``docs``, in any order, and the settings."""
    row = F.xxhash64(*docs.columns)
    got = docs.agg(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    return hashlib.sha256(repr((*got, *settings)).encode()).hexdigest()[:20]


def counted_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, counted)``: each text's ``n_words`` and its distinct ``words`` with their counts ``n``; none without tokens.

    A text is taken apart once, and its words stay in its row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, NG.split_tokens(F.col(text_col)).alias("_toks")).mapInArrow(
        grams.counted_tokens, f"`{id_col}` {kind}, counted struct<n_words: long, words: array<struct<word: string, n: long>>>")


def ids_of_words(words: DataFrame, how: Inputs, mask: DataFrame | None = None) -> DataFrame:
    """``(word, n_ids_w, ids)``: each distinct word's buckets with their counts; only distinct words are shuffled."""
    return words.select("word").distinct().mapInArrow(
        grams.ids_of_words(how.min_n, how.max_n, how.buckets, NG.mask_flags(mask, how.buckets)),
        "word string, n_ids_w long, ids array<struct<bucket: long, c: long>>")


def with_entries(rows: DataFrame, texts: DataFrame, how: Inputs, mask: DataFrame | None = None,
                 id_col: str = "doc_id", apart: bool = False) -> DataFrame:
    """The rows with ``n_ids, entries`` of the texts of their id, summed over these; nulls where there are no ids.

    With ``apart`` the entries are the bytes of three arrays, :data:`model.ENTRY`: they are stored and dealt, not read
    one by one. ``texts`` is :func:`counted_texts`, or holds each ``text`` itself. Texts meet their rows before n-grams are
    taken, so no entry is shuffled.
    """
    if "counted" in texts.columns:
        both = rows.join(texts.groupBy(id_col).agg(F.collect_list("counted").alias("_texts")), id_col, "left")
    else:
        texts = texts.where(F.col("text").isNotNull()).groupBy(id_col).agg(F.collect_list("text").alias("_texts"))
        both = rows.join(texts, id_col, "left").withColumn("_texts", F.transform(
            F.coalesce("_texts", F.array().cast("array<string>")), lambda t: NG.split_tokens(t)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    parts = ", ".join(f"{c} binary" for c in MD.ENTRY) if apart else MD.ENTRIES
    return both.mapInArrow(grams.text_entries(how.min_n, how.max_n, how.buckets, NG.mask_flags(mask, how.buckets), apart),
                           f"{kinds}, n_ids long, {parts}")


def word_entries(prep: Prepared) -> DataFrame:
    """``(word, bucket, w)``: the share of each bucket in each distinct word's vector."""
    return prep.word_ids.select("word", "n_ids_w", F.inline("ids")).select(
        "word", "bucket", (F.col("c") / F.col("n_ids_w")).alias("w"))


def embed_by_word(prep: Prepared, table: DataFrame, emb_size: int) -> DataFrame:
    """M3 of all documents in two sums, as it is linear: a vector per distinct word, then those of a document's words.

    No n-gram meets a document. Documents of one id have the sum over them. ``table`` has a bucket once; it is bounded
    by the bucket count, and where it is small, tasks hold it and only documents' vectors are shuffled.
    """
    how, names = prep.how, [f"x{k}" for k in range(emb_size)]
    many = prep.rows.groupBy("doc_id").agg(F.count("*").alias("rows_of_id"))
    if how.buckets * emb_size * 8 <= MD.BROADCAST_TABLE:
        kind = prep.texts.schema["doc_id"].dataType.simpleString()
        x = prep.texts.select("doc_id", "counted").mapInArrow(
            grams.text_vectors(how.min_n, how.max_n, how.buckets, MD.held_table(table, emb_size), ["doc_id", *names],
                               NG.mask_flags(prep.mask, how.buckets)), ", ".join([f"doc_id {kind}", *[f"{c} double" for c in names]]))
        return x.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in names]).join(many, "doc_id").select(
            "doc_id", *[(F.col(c) * F.col("rows_of_id")).alias(c) for c in names])
    vectors = MD.embed_docs(word_entries(prep), table, emb_size, "word").select(
        F.col("word").alias("bucket"), *[F.col(f"x{k}").alias(f"e{k}") for k in range(emb_size)])
    share = prep.words.select("doc_id", F.col("word").alias("bucket"), (F.col("n") / F.col("n_words")).alias("w"))
    return MD.embed_docs(share, vectors, emb_size).join(many, "doc_id").select(
        "doc_id", *[(F.col(f"x{k}") * F.col("rows_of_id")).alias(f"x{k}") for k in range(emb_size)])


def prepared(spark: SparkSession, docs: DataFrame, how: Inputs = Inputs()) -> Prepared:
    """Encode the labelled documents ``(doc_id, text, label)``, split them, scale their features.

    ``doc_id`` is unique and not null; a null or empty text has no ids. Without a
    mask the scaler is that of all documents, else that of the training split.
    """
    num = list(K.NUM_COLUMNS)
    docs = docs.select("doc_id", "text", "label")
    version = version_of(docs, "inputs")
    at = shared_dir(spark, f"inputs-{version}")
    texts = stored(spark, f"{at}/texts", lambda: counted_texts(docs))

    def split_and_features():
        split = CL.split_train_test(docs.select("doc_id", "label"), TEST_SHARE, SPLIT_SEED)
        feats = FE.page_features(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")))
        return split.join(feats.withColumnRenamed("page_id", "doc_id"), "doc_id")
    rows = stored(spark, f"{at}/rows", split_and_features)
    own = hashlib.sha256(repr(how).encode()).hexdigest()[:12]
    mask = None
    if how.masked:
        found = NG.frequent_of_counts(split_word_counts(texts, rows).withColumnRenamed("n_occ", "n"),
                                      how.min_n, how.max_n, how.min_freq)
        mask = stored(spark, f"{at}/mask-{own}", lambda: H.with_bucket(found, "ngram", "bucket", how.buckets).select(
            F.col("bucket").cast("long")).where("bucket <> 0").distinct())
    scaler = MD.fit_scaler(rows.where("split = 'train'") if how.masked else rows, num)

    return Prepared(f"{version}-{own}", MD.standardize(rows, scaler, num, keep=["label", "split"]), texts, how, mask, scaler,
                    f"{at}/word-ids-{own}", f"{at}/entries-{own}")


def trained(spark: SparkSession, docs: DataFrame, cfg: MD.TrainConfig, how: Inputs = Inputs()) -> StoredModel:
    """The model of these documents, inputs and settings; trained and stored at the first call."""
    num = list(K.NUM_COLUMNS)
    prep = prepared(spark, docs, replace(how, masked=True))
    at = shared_dir(spark, f"model-{prep.version}-{hashlib.sha256(repr(cfg).encode()).hexdigest()[:12]}")
    if not is_written(spark, f"{at}/history"):          # the last table: the others are whole if it is
        examples = prep.packed
        part = {x: examples.where(F.col("split") == x) for x in ("train", "test")}
        vocab, dense, history = MD.train_examples(part["train"], cfg, num, val=part["test"], buckets=prep.mask,
                                                  block_entries=MD.BLOCK_ENTRIES, written=True)
        vocab.write.mode("overwrite").parquet(f"{at}/vocab")
        rows = [(j, c, float(dense.W[j, 0]), float(dense.W[j, 1])) for j, c in enumerate(dense.inputs())]
        rows.append((len(rows), "bias", float(dense.b[0]), float(dense.b[1])))
        spark.createDataFrame(rows, "j int, input string, w0 double, w1 double").write.mode("overwrite").parquet(f"{at}/dense")
        spark.createDataFrame([(c, *prep.scaler[c]) for c in num], "feature string, mu double, sigma double").write.mode(
            "overwrite").parquet(f"{at}/scaler")
        history.coalesce(1).write.mode("overwrite").parquet(f"{at}/history")
    rows = spark.read.parquet(f"{at}/dense").orderBy("j").collect()
    W = np.array([[r.w0, r.w1] for r in rows])
    dense = MD.Dense(W[:-1], W[-1], cfg.emb_size, num if cfg.with_features else [])
    return StoredModel(prep, spark.read.parquet(f"{at}/vocab"), dense, spark.read.parquet(f"{at}/history"))


def split_word_counts(texts: DataFrame, rows: DataFrame, split: str = "train") -> DataFrame:
    """``(word, n_occ)`` of a split; words meet their counts after the texts met the split."""
    own = texts.join(rows.where(F.col("split") == split).select("doc_id"), "doc_id", "left_semi")
    return own.select(F.inline("counted.words")).groupBy("word").agg(F.sum("n").alias("n_occ"))


def train_word_counts(prep: Prepared) -> DataFrame:
    """``(word, n_occ)`` of the training split."""
    return split_word_counts(prep.texts, prep.rows)
