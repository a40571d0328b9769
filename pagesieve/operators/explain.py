"""Explanations of page scores (E7..E12) and of the n-gram model (E1..E6).

Per-page explanations are built inside each scored row (arrays of 12 structs,
sorted and sliced), then exploded: map-only, no window shuffle. Model-level
studies (E1..E6) are aggregations over exploded grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns as P
from ..functions import text as T
from ..sources.model_io import CollapsedModel
from .scoring import standardized


def _feature_structs(model: CollapsedModel) -> Column:
    """array<struct(pos, feature, value, z, cval)> over the 12 model features."""
    items = []
    for i, c in enumerate(model.num_columns):
        z = standardized(F.col(c), i, model)
        delta = float(model.w_num[i][1]) - float(model.w_num[i][0])
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"),
                              F.col(c).alias("value"), z.alias("z"),
                              (z * F.lit(delta)).alias("cval")))
    return F.array(*items)


def plain_contributions(scored: DataFrame, model: CollapsedModel, id_col: str = "page_id",
                        top: int = 5) -> DataFrame:
    """|z*(w1-w0)|, top ``top`` by size (ties in column order), then only raw value != 0."""
    arr = F.transform(_feature_structs(model), lambda s: F.struct(
        (-F.abs(s["cval"])).alias("k1"), s["pos"].alias("k2"), s["feature"].alias("feature"),
        s["value"].alias("value"), F.abs(s["cval"]).alias("contribution")))
    top_arr = F.slice(F.array_sort(arr), 1, top)
    shown = F.filter(F.transform(top_arr, lambda s, i: F.struct(
        (i + 1).alias("rank"), s["feature"].alias("feature"), s["value"].alias("value"),
        s["contribution"].alias("contribution"))), lambda s: s["value"] != 0)
    return scored.select(id_col, F.explode(shown).alias("c")).select(
        id_col, F.col("c.rank").alias("rank"), F.col("c.feature").alias("feature"),
        F.col("c.contribution").alias("contribution"))


def signed_contributions(scored: DataFrame, model: CollapsedModel, id_col: str = "page_id",
                         top: int = 5) -> DataFrame:
    """Contributions signed towards the verdict, top 5, share of the five, hidden if it shows 0.00."""
    is_slop = F.col("verdict") == F.lit("slop")
    arr = F.transform(_feature_structs(model), lambda s: F.struct(
        (-F.when((s["cval"] > 0) == is_slop, F.abs(s["cval"])).otherwise(-F.abs(s["cval"]))).alias("k1"),
        s["pos"].alias("k2"), s["feature"].alias("feature"),
        F.when((s["cval"] > 0) == is_slop, F.abs(s["cval"])).otherwise(-F.abs(s["cval"])).alias("signed"),
        F.abs(s["cval"]).alias("abs_c")))
    top_arr = F.slice(F.array_sort(arr), 1, top)
    tot = F.aggregate(top_arr, F.lit(0.0), lambda a, s: a + s["abs_c"])
    tot = F.when(tot == 0, F.lit(1.0)).otherwise(tot)
    rows = F.transform(top_arr, lambda s, i: F.struct(
        (i + 1).alias("rank"), s["feature"].alias("feature"), s["signed"].alias("signed"),
        (s["abs_c"] / tot).alias("share")))
    out = scored.select(id_col, F.explode(rows).alias("c")).select(
        id_col, "c.rank", "c.feature", "c.signed", "c.share")
    # shown when the two-decimal text of the share is not 0.00
    return out.withColumn("shown", F.format_number(F.col("share"), 2) != F.lit("0.00"))


def ranked_grams(scored: DataFrame, model: CollapsedModel, id_col: str = "page_id",
                 top: int = 5) -> DataFrame:
    """Matched grams, top 5 by |u1-u0| (ties in gram order), then signed towards the verdict."""
    deltas = {g: float(v[1]) - float(v[0]) for g, v in model.u.items()}
    kv = []
    for g, d in sorted(deltas.items()):
        kv += [F.lit(g), F.lit(d)]
    dmap = F.create_map(*kv)
    is_slop = F.col("verdict") == F.lit("slop")
    arr = F.transform(F.col("grams"), lambda g: F.struct(
        (-F.abs(F.element_at(dmap, g))).alias("k1"), g.alias("ngram"),
        F.element_at(dmap, g).alias("delta")))
    top_arr = F.slice(F.array_sort(arr), 1, top)
    signed = F.transform(top_arr, lambda s, i: F.struct(
        (-F.when((s["delta"] > 0) == is_slop, F.abs(s["delta"])).otherwise(-F.abs(s["delta"]))).alias("k1"),
        i.alias("k2"), s["ngram"].alias("ngram"), s["delta"].alias("delta"),
        F.when((s["delta"] > 0) == is_slop, F.abs(s["delta"])).otherwise(-F.abs(s["delta"])).alias("signed")))
    ordered = F.transform(F.array_sort(signed), lambda s, i: F.struct(
        (i + 1).alias("rank"), s["ngram"].alias("ngram"), s["delta"].alias("delta"),
        s["signed"].alias("signed")))
    return scored.select(id_col, F.explode(ordered).alias("c")).select(
        id_col, "c.rank", "c.ngram", "c.delta", "c.signed")


def phrase_examples(html: Column, java_pattern: str, n: int = 3) -> Column:
    """The first ``n`` matches of a phrase rule in the visible text."""
    return F.slice(T.extract_all(T.visible_text(html), java_pattern), 1, n)


def _quoted(arr: Column) -> Column:
    return F.concat(F.lit("('"), F.array_join(arr, "', '"), F.lit("')"))


def report(scored_with_html: DataFrame, model: CollapsedModel, id_col: str = "page_id",
           html_col: str = "html") -> DataFrame:
    """One text report per page (verdict, probabilities, reasons, grams)."""
    s = scored_with_html
    labels = {c: F.lit(K.FEATURE_LABELS[c]) for c in model.num_columns}
    extras = {
        "as_i_x_i_will_y": _quoted(phrase_examples(F.col(html_col), P.PHRASE_AS_I_WILL_JAVA)),
        "i_x_that_is_not_y_but_z": _quoted(phrase_examples(F.col(html_col), P.PHRASE_I_NOT_BUT_JAVA)),
    }
    arr = F.transform(_feature_structs(model), lambda x: F.struct(
        (-F.abs(x["cval"])).alias("k1"), x["pos"].alias("k2"), x["feature"].alias("feature"),
        x["value"].alias("value")))
    top5 = F.filter(F.slice(F.array_sort(arr), 1, 5), lambda x: x["value"] != 0)
    label_map = F.create_map(*[v for c in model.num_columns
                               for v in (F.lit(c), F.concat(labels[c], extras.get(c, F.lit(""))))])
    reasons = F.transform(top5, lambda x: F.concat(F.lit("\n- "), F.element_at(label_map, x["feature"])))
    head = F.concat(F.lit("I think this is more likely "), F.col("verdict"),
                    F.lit(" (P(not-slop)="), F.format_number(F.col("p_not_slop"), 2),
                    F.lit(", P(slop)="), F.format_number(F.col("p_slop"), 2), F.lit(").\n"))
    reason_txt = F.when(F.size(reasons) > 0,
                        F.concat(F.lit("\nReasoning: "), F.array_join(reasons, ""))).otherwise(F.lit(""))
    gram_txt = F.when(F.size("grams") > 0, F.concat(
        F.lit("\n- Contains n-grams like "),
        F.array_join(F.transform("grams", lambda g: F.concat(F.lit("'"), g, F.lit("'"))), ", "))
    ).otherwise(F.lit(""))
    return s.select(id_col, "verdict", "p_not_slop", "p_slop",
                    F.concat(head, reason_txt, gram_txt).alias("report"))
