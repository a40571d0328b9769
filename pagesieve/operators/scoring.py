"""Collapsed-model page scoring (M2, M4, M14, M15) and score bands.

Plan shape: map-only. The kept n-grams of the collapsed model are few (a fixed
part of the model, not of the data), so they are inlined as one literal map;
every page is scored inside its own row with higher-order functions: tokenize,
keep the tokens that contain any kept gram (one cached literal regex), expand
those tokens to substrings of the kept lengths, look them up, average per word
and then over the page. No shuffle, no join, no Python in the row path.
Vocabularies too large for that go through ``score_text_by_join`` (explode,
join of the gram table, two aggregations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns as P
from ..functions import text as T
from ..sources.model_io import CollapsedModel
from .features import feature_columns, with_visible_text

ALL_TOKENS = "all_tokens"      # divide the text score by every token (Python scorer)
MATCHED_ONLY = "matched_only"  # divide by words holding a kept gram (browser scorer)


def _gram_map(model: CollapsedModel) -> Column:
    kv = []
    for g, v in sorted(model.u.items()):
        kv += [F.lit(g), F.array(F.lit(float(v[0])), F.lit(float(v[1])))]
    return F.create_map(*kv)


def word_matches(word: Column, model: CollapsedModel) -> Column:
    """All kept grams found in ``word`` (every position and length, repeats kept)."""
    gmap = _gram_map(model)
    per_len = []
    for n in model.gram_lengths:
        subs = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), _substr_of(word, n))
        per_len.append(F.when(F.length(word) >= n,
                              F.filter(subs, lambda s: F.map_contains_key(gmap, s)))
                       .otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*per_len))


def _substr_of(word: Column, n: int):
    """A one-argument lambda (PySpark reads the arity) taking position -> substring."""
    return lambda i: F.substring(word, i, n)


def hit_words(tokens: Column, model: CollapsedModel) -> Column:
    """Per token holding a kept gram: the list of its matches (repeats kept).

    Tokens are first screened by one literal alternation (cached pattern), so
    only candidate words are expanded into substrings.
    """
    alt = P.literal_alternation(model.u.keys())
    shortest = min(model.gram_lengths)
    cand = F.filter(tokens, lambda t: (F.length(t) >= shortest) & t.rlike(alt))
    return F.filter(F.transform(cand, lambda t: word_matches(t, model)), lambda m: F.size(m) > 0)


def text_part_from_hits(hits: Column, n_words: Column, model: CollapsedModel,
                        denominator: str = ALL_TOKENS) -> Column:
    """struct(t0, t1, n_words, n_hit_words, grams) from a materialized ``hit_words`` column."""
    gmap = _gram_map(model)

    def word_mean(m, k):
        return F.aggregate(m, F.lit(0.0), lambda a, g: a + F.element_at(gmap, g)[k]) / F.size(m)

    s0 = F.aggregate(hits, F.lit(0.0), lambda a, m: a + word_mean(m, 0))
    s1 = F.aggregate(hits, F.lit(0.0), lambda a, m: a + word_mean(m, 1))
    n_hit = F.size(hits)
    den = n_words if denominator == ALL_TOKENS else n_hit
    grams = F.array_sort(F.array_distinct(F.flatten(hits)))
    return F.struct(
        F.when(den > 0, s0 / den).otherwise(0.0).alias("t0"),
        F.when(den > 0, s1 / den).otherwise(0.0).alias("t1"),
        n_words.alias("n_words"), n_hit.alias("n_hit_words"), grams.alias("grams"))


def text_part(tokens: Column, model: CollapsedModel, denominator: str = ALL_TOKENS) -> Column:
    """The text half of the logits in one expression (prefer the staged form in plans)."""
    return text_part_from_hits(hit_words(tokens, model), F.size(tokens), model, denominator)


def as_float32(c: Column) -> Column:
    """The reference feeds features as float32: round to float, then widen."""
    return c.cast("float").cast("double")


def standardized(feat: Column, i: int, model: CollapsedModel) -> Column:
    return (as_float32(feat) - F.lit(float(model.mu[i]))) / F.lit(float(model.sigma[i]))


def numeric_part(feats: dict[str, Column], model: CollapsedModel, k: int) -> Column:
    """sum_j z_j * W_num[j][k] in the model's column order (M2 + linear layer)."""
    acc = None
    for i, c in enumerate(model.num_columns):
        term = standardized(feats[c], i, model) * F.lit(float(model.w_num[i][k]))
        acc = term if acc is None else acc + term
    return acc


def softmax2(z0: Column, z1: Column) -> tuple[Column, Column]:
    """M4: two-class softmax with max shift."""
    m = F.greatest(z0, z1)
    e0, e1 = F.exp(z0 - m), F.exp(z1 - m)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def score_pages(pages: DataFrame, model: CollapsedModel, id_col: str = "page_id",
                html_col: str = "html", keep: list[str] | None = None,
                denominator: str = ALL_TOKENS) -> DataFrame:
    """M14 + M15: one row per page with features, logits, probabilities and verdict."""
    keep = keep or []
    base = with_visible_text(pages.select(id_col, html_col, *keep), html_col)
    # stage 2: tokenize once; stage 3: per-word gram hits once (each is reused)
    base = base.select(id_col, *keep, "_html", "_text",
                       T.word_tokens("_text").alias("_tokens"),
                       T.model_tokens("_html").alias("_mtokens"),
                       T.paragraphs("_text").alias("_paras"))
    base = base.select(id_col, *keep, "_html", "_text", "_tokens", "_paras",
                       hit_words(F.col("_mtokens"), model).alias("_hits"),
                       F.size("_mtokens").alias("_nw"))
    fcols = feature_columns(F.col("_html"), F.col("_text"), F.col("_tokens"), F.col("_paras"))
    stage = base.select(id_col, *keep, *[fcols[c].alias(c) for c in model.num_columns],
                        text_part_from_hits(F.col("_hits"), F.col("_nw"), model, denominator).alias("_tp"))
    feats = {c: F.col(c) for c in model.num_columns}
    z0 = F.col("_tp.t0") + numeric_part(feats, model, 0) + F.lit(float(model.bias[0]))
    z1 = F.col("_tp.t1") + numeric_part(feats, model, 1) + F.lit(float(model.bias[1]))
    out = stage.select(id_col, *keep, *model.num_columns,
                       F.col("_tp.t0").alias("text0"), F.col("_tp.t1").alias("text1"),
                       F.col("_tp.n_words").alias("n_words"),
                       F.col("_tp.n_hit_words").alias("n_hit_words"),
                       F.col("_tp.grams").alias("grams"),
                       z0.alias("z0"), z1.alias("z1"))
    p0, p1 = softmax2(F.col("z0"), F.col("z1"))
    return out.withColumn("p_not_slop", p0).withColumn("p_slop", p1).withColumn(
        "verdict", F.when(F.col("p_slop") > F.col("p_not_slop"), F.lit("slop"))
        .otherwise(F.lit("not slop")))


def score_text_by_join(pages: DataFrame, grams: DataFrame, id_col: str = "page_id",
                       html_col: str = "html", gram_lengths: list[int] | None = None,
                       denominator: str = ALL_TOKENS) -> DataFrame:
    """M14 text half with the grams as a table: explode tokens, join grams, aggregate.

    For vocabularies too large for a literal map; the optimizer picks the join
    (AQE splits skewed grams).
    """
    lengths = gram_lengths or K.ALLOWED_GRAM_LENGTHS
    toks = pages.select(id_col, F.posexplode_outer(T.model_tokens(F.coalesce(F.col(html_col), F.lit(""))))
                        .alias("pos", "word"))
    n_words = toks.groupBy(id_col).agg(F.count("word").alias("n_words"))
    subs = toks.where(F.length("word") >= min(lengths)).select(
        id_col, "pos", F.explode(F.flatten(F.array(*[
            F.when(F.length("word") >= n,
                   F.transform(F.sequence(F.lit(1), F.length("word") - n + 1),
                               _substr_of(F.col("word"), n)))
            .otherwise(F.array().cast("array<string>")) for n in lengths]))).alias("ngram"))
    per_word = subs.join(grams, "ngram").groupBy(id_col, "pos").agg(
        F.avg("u0").alias("w0"), F.avg("u1").alias("w1"))
    per_page = per_word.groupBy(id_col).agg(F.sum("w0").alias("s0"), F.sum("w1").alias("s1"),
                                            F.count("*").alias("n_hit_words"))
    res = n_words.join(per_page, id_col, "left").na.fill(0, ["s0", "s1", "n_hit_words"])
    den = F.col("n_words") if denominator == ALL_TOKENS else F.col("n_hit_words")
    return res.select(id_col, F.when(den > 0, F.col("s0") / den).otherwise(0.0).alias("text0"),
                      F.when(den > 0, F.col("s1") / den).otherwise(0.0).alias("text1"),
                      "n_words", "n_hit_words")


def band(score: Column) -> Column:
    """Score bands on the "ok" score; null stays null."""
    out = None
    for upper, label in K.SCORE_BANDS:
        out = F.when(score < upper, F.lit(label)) if out is None else out.when(score < upper, F.lit(label))
    return F.when(score.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(K.TOP_BAND)))


def with_band(scored: DataFrame, score: str) -> DataFrame:
    """Rows with a score, and its band; rows without a score are dropped."""
    return scored.where(F.col(score).isNotNull()).withColumn("band", band(F.col(score)))
