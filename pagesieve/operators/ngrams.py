"""N-gram tokenizer operators (T4..T9) as DataFrame jobs.

Work is done once per *distinct* word (grams and hashes), then joined back to
the word occurrences: a corpus has far fewer distinct words than tokens, and
the occurrence side never needs grams materialized. Counting (T6) aggregates
words first (partial aggregation absorbs hot words), then grams weighted by
word counts. The bucket mask is bounded by the bucket count, so it may be
broadcast; every other join is left to the optimizer's size estimates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams
from ..functions import hashing as H
from ..functions import patterns as P
from ..functions import text as T


def split_tokens(text: Column, preprocess: Callable[[Column], Column] | None = None) -> Column:
    """Model tokens of ``preprocess(lower(text))`` (word runs or symbol runs)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pre = preprocess(low) if preprocess else low
    return T.extract_all(pre, P.MODEL_TOKEN)


def capped_tokens(tokens: Column, key: Column, cap: int) -> Column:
    """At most ``cap`` tokens: all when fewer, else the ``cap`` of lowest md5 rank."""
    ranked = F.transform(tokens, lambda t, i: F.struct(
        F.md5(F.concat(key.cast("string"), F.lit(":"), i.cast("string"))).alias("k"), t.alias("t")))
    picked = F.transform(F.slice(F.array_sort(ranked), 1, cap), lambda s: s["t"])
    return F.when(F.size(tokens) <= cap, tokens).otherwise(picked)


def word_occurrences(docs: DataFrame, id_col: str, text_col: str, max_token: int | None = None,
                     preprocess=None) -> DataFrame:
    """``(id, word_pos, word)`` of every text, or of its first ``max_token`` words if that is set."""
    toks = split_tokens(F.col(text_col), preprocess)
    if max_token is not None:
        toks = F.slice(toks, 1, max_token)
    return docs.select(id_col, F.posexplode(toks).alias("word_pos", "word"))


def word_grams(words: DataFrame, min_n: int, max_n: int, buckets: int = H.DEFAULT_BUCKETS) -> DataFrame:
    """Per distinct word: ``(word, gram_pos, ngram, bucket)``, hash 0 dropped.

    Words share n-grams, so the distinct n-grams are hashed once each and the
    buckets joined back.
    """
    dw = words.select("word").distinct()
    grams = dw.select("word", F.posexplode(H.word_ngrams(F.col("word"), min_n, max_n)).alias("gram_pos", "ngram"))
    hashed = H.with_bucket(grams.select("ngram").distinct(), "ngram", "bucket", buckets).where("bucket <> 0")
    return grams.join(hashed, "ngram").select("word", "gram_pos", "ngram", "bucket")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_n: int = 3,
           max_n: int = 3, buckets: int = H.DEFAULT_BUCKETS, max_token: int | None = None,
           mask: DataFrame | None = None, preprocess=None) -> DataFrame:
    """T4/T5: long form ``(id, word_pos, gram_pos, ngram, bucket)`` of every kept id.

    Words whose ids are all dropped simply have no rows here; the per-text
    word count comes from ``word_occurrences``.
    """
    occ = word_occurrences(docs, id_col, text_col, max_token, preprocess)
    wg = word_grams(occ, min_n, max_n, buckets)
    if mask is not None:
        # the mask holds at most ``buckets`` rows: a bounded broadcast
        wg = wg.join(F.broadcast(mask.select("bucket").distinct()), "bucket", "left_semi")
    return occ.join(wg, "word").select(id_col, "word_pos", "gram_pos", "ngram", "bucket")


def mask_flags(mask: DataFrame | None, buckets: int):
    """A broadcast flag per bucket (bounded by the bucket count); none without a mask."""
    if mask is None:
        return None
    flags = np.zeros(buckets, bool)
    flags[mask.select("bucket").dropna().distinct().toArrow().column(0).to_numpy()] = True
    return mask.sparkSession.sparkContext.broadcast(flags)


def encode_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_n: int = 3,
                   max_n: int = 3, buckets: int = H.DEFAULT_BUCKETS, max_token: int | None = None,
                   mask: DataFrame | None = None, preprocess=None) -> DataFrame:
    """Per text: kept id count, bucket sum and words holding ids.

    Same numbers as aggregating ``encode``, but each task sums its own texts: a
    batch's distinct words are hashed once, so neither words nor ids are
    shuffled, only one row per text (rows of one id are summed).
    """
    if min_n > max_n:
        raise ValueError("min_n must not exceed max_n")
    toks = split_tokens(F.col(text_col), preprocess)
    if max_token is not None:
        toks = F.slice(toks, 1, max_token)
    flags = mask_flags(mask, buckets)
    kind = docs.schema[id_col].dataType.simpleString()
    sums = docs.select(F.col(id_col).alias("id"), toks.alias("toks")).mapInArrow(
        grams.text_sums(min_n, max_n, buckets, flags), f"id {kind}, n_ids long, bucket_sum long, n_words long")
    return sums.groupBy(F.col("id").alias(id_col)).agg(
        F.sum("n_ids").alias("n_ids"), F.sum("bucket_sum").alias("bucket_sum"), F.sum("n_words").alias("n_words_with_ids"))


def raw_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_n: int = 3,
               max_n: int = 3, max_token: int | None = None, preprocess=None) -> DataFrame:
    """``(id, word_pos, word, ngrams)`` without hashing (per-row expression)."""
    occ = word_occurrences(docs, id_col, text_col, max_token, preprocess)
    return occ.withColumn("ngrams", H.word_ngrams(F.col("word"), min_n, max_n))


def subword_mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_n: int = 3,
                 max_n: int = 3, min_freq: int = 2, buckets: int = H.DEFAULT_BUCKETS,
                 max_tok: int | None = None, preprocess=None) -> DataFrame:
    """Buckets holding an n-gram seen at least ``min_freq`` times over the corpus.

    All tokens count; with ``max_tok`` at most that many of each text, by a
    reproducible md5 choice. Words are counted first, so a hot word is one
    partial aggregate per task, not one row per occurrence.
    """
    # tokens as their own column: a cap reads them up to three times
    staged = docs.select(id_col, split_tokens(F.col(text_col), preprocess).alias("_toks"))
    toks = F.col("_toks") if max_tok is None else capped_tokens(F.col("_toks"), F.col(id_col), max_tok)
    kept = _frequent(staged.select(F.explode(toks).alias("word")), min_n, max_n, min_freq)
    return H.with_bucket(kept, "ngram", "bucket", buckets).select("bucket").distinct()


def _frequent(words: DataFrame, min_n: int, max_n: int, min_freq: int) -> DataFrame:
    return frequent_of_counts(words.groupBy("word").agg(F.count("*").alias("n")), min_n, max_n, min_freq)


def frequent_of_counts(wc: DataFrame, min_n: int, max_n: int, min_freq: int) -> DataFrame:
    """The n-grams that words with counts ``(word, n)`` hold at least ``min_freq`` times."""
    gc = wc.select(F.explode(H.word_ngrams(F.col("word"), min_n, max_n)).alias("ngram"), "n") \
        .groupBy("ngram").agg(F.sum("n").alias("count"))
    return gc.where(F.col("count") >= min_freq).select("ngram")


def frequent_grams(docs: DataFrame, text_col: str = "text", min_n: int = 3, max_n: int = 3, min_freq: int = 2,
                   preprocess=None) -> DataFrame:
    """The n-grams seen at least ``min_freq`` times over the corpus (one column, ``ngram``)."""
    words = docs.select(F.explode(split_tokens(F.col(text_col), preprocess)).alias("word"))
    return _frequent(words, min_n, max_n, min_freq)


def allow_list_grams(docs: DataFrame, grams: DataFrame, id_col: str = "page_id",
                     text_col: str = "html", lengths: list[int] | None = None) -> DataFrame:
    """Every substring of an allowed length that is in the allow list; repeats kept.

    ``(id, word_pos, ngram)``. Substrings are taken once per distinct word and
    joined to the allow list by equality; only the hits meet the occurrences.
    """
    if lengths is None:
        lengths = [r[0] for r in grams.select(F.length("ngram")).distinct().collect()]
    occ = word_occurrences(docs, id_col, text_col, None)
    occ = occ.where(F.length("word") >= min(lengths))
    subs = occ.select("word").distinct().select("word", F.explode(F.flatten(F.array(*[
        F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1),
                                                  H._sub_of(F.col("word"), n)))
        .otherwise(F.array().cast("array<string>")) for n in sorted(lengths)]))).alias("ngram"))
    hits = subs.join(grams.select("ngram").distinct(), "ngram")
    return occ.join(hits, "word").select(id_col, "word_pos", "ngram")


def prune_vocabulary(encoded: DataFrame, chosen: DataFrame, key: str = "ngram") -> DataFrame:
    """Keep only the chosen n-grams."""
    return encoded.join(chosen.select(key).distinct(), key, "left_semi")
