"""Per-page numeric features (one projection per stage, no shuffle).

``page_features`` computes the twelve model inputs; ``wide_page_features`` the
wider research set. Both are map-only: each page is one row, every feature is a
built-in expression over that row, so the job scales with the number of files
and never moves data between executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns as P
from ..functions import text as T


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (ANSI-safe)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def with_visible_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Stage 1: visible text and lengths, computed once per page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.withColumn("_html", html).withColumn("_text", T.visible_text("_html"))


def feature_columns(html: Column, text: Column, tokens: Column,
                    paras: Column | None = None) -> dict[str, Column]:
    """The twelve model features as expressions over precomputed columns."""
    n_tok = F.size(tokens)
    html_len = F.length(html)
    text_len = F.length(text)
    n_tags = F.greatest(T.count_matches(html, P.TAG_OPEN), F.lit(1))
    paras = T.paragraphs(text) if paras is None else paras
    n_paras = F.size(paras)
    piece_sum = F.aggregate(paras, F.lit(0).cast("long"),
                            lambda acc, p: acc + T.sentence_piece_count(p))
    links = T.count_matches(html, P.HREF)
    return {
        "as_i_x_i_will_y": T.count_matches(text, P.PHRASE_AS_I_WILL_JAVA).cast("double"),
        "i_x_that_is_not_y_but_z": T.count_matches(text, P.PHRASE_I_NOT_BUT_JAVA).cast("double"),
        "iframe_count": T.count_matches(html, P.IFRAME_JAVA).cast("double"),
        "inline_css_ratio": T.count_literal(F.lower(html), "style=").cast("double") / n_tags,
        "links_per_kb": F.when(html_len > 0, links.cast("double") / (html_len / F.lit(1024.0)))
                         .otherwise(F.lit(0.0)),
        "markup_to_text_ratio": _ratio(html_len - text_len, html_len),
        "prp_ratio": _ratio(F.size(F.filter(tokens, lambda t: t.isin(K.PRONOUNS))), n_tok),
        "sentences_per_paragraph": _ratio(piece_sum, n_paras),
        "stopword_ratio": _ratio(F.size(F.filter(tokens, lambda t: t.isin(K.STOPWORDS))), n_tok),
        "straight_apostrophe": T.count_literal(text, "'").cast("double"),
        "type_token_ratio": _ratio(F.size(F.array_distinct(tokens)), n_tok),
        "vbg": T.count_matches(text, P.VBG_JAVA).cast("double"),
    }


def page_features(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  keep: list[str] | None = None) -> DataFrame:
    """F1..F13: ``(id, *12 features)`` in ``NUM_COLUMNS`` order.

    Stage 1 strips blocks and tags; stage 2 tokenizes once; stage 3 computes
    all features from those columns. Each stage is a Project inside one
    whole-stage-codegen span; regexes are not repeated by projection collapse
    because the shared columns are consumed more than once.
    """
    keep = keep or []
    base = with_visible_text(pages.select(id_col, html_col, *keep), html_col)
    base = base.withColumn("_tokens", T.word_tokens("_text")).withColumn("_paras", T.paragraphs("_text"))
    cols = feature_columns(F.col("_html"), F.col("_text"), F.col("_tokens"), F.col("_paras"))
    return base.select(id_col, *keep, *[cols[c].alias(c) for c in K.NUM_COLUMNS])


# ---------------------------------------------------------------------------
# Wider feature set (G1..G12)
# ---------------------------------------------------------------------------

_EMPTY_TAG_JAVA = rf"<({P.W}+)(?:{P.S}+[^>]*)?>{P.S}*</\1>"
_REL_VALUES = r"""(?i)<a[^>]+rel=["']([^"']+)["']"""
_ANCHOR_TEXT = r"(?s)<a[^>]*>(.*?)</a>"
_IMG = rf"(?i)<{P.S}*img{P.B_AFTER}"
_ALT_VALUES = r"""(?i)<img[^>]+alt=["']([^"']*)"""
_SYLLABLE = r"(?i)[aeiouy]+"
_URL_IN_TEXT = rf"https?://{P.NOT_S}+"
_REPEAT_PHRASE_JAVA = rf"(?iu){P.B_BEFORE}({P.W}+){P.B_AFTER}(?:{P.S}+\1{P.B_AFTER}){{2,}}"
_RB_WORD = r"^(?:.+ly|here|there|now|then)$"


def wide_page_features(pages: DataFrame, id_col: str = "page_id",
                       html_col: str = "html") -> DataFrame:
    """G1..G12: the wider feature set, ratios built from counts."""
    base = with_visible_text(pages.select(id_col, html_col), html_col)
    base = base.select(
        id_col, "_html", "_text",
        T.word_tokens("_text").alias("_tokens"),
        T.extract_all(F.lower(F.col("_html")), f"<{P.S}*({P.W}+)", 1).alias("_tags"),
        T.extract_all("_html", P.HREF_VALUE, 1).alias("_hrefs"),
        F.filter(F.split(F.col("_text"), P.SENTENCE_MARKS, -1),
                 lambda s: s.rlike(P.NOT_S)).alias("_sentences"),
        T.extract_all("_html", _ANCHOR_TEXT, 1).alias("_anchors"),
        T.extract_all("_html", _ALT_VALUES, 1).alias("_alts"),
        T.extract_all("_html", _REL_VALUES, 1).alias("_rels"),
    )
    html, text, tokens = F.col("_html"), F.col("_text"), F.col("_tokens")
    tags, hrefs = F.col("_tags"), F.col("_hrefs")
    n_tok = F.size(tokens)
    n_tags_raw = F.size(tags)
    n_tags = F.greatest(n_tags_raw, F.lit(1))
    total_links = F.size(hrefs)
    ext_links = F.size(F.filter(hrefs, lambda h: h.startswith("http://") | h.startswith("https://")))
    int_links = total_links - ext_links
    anchors = F.transform(F.filter(F.col("_anchors"), lambda a: a.rlike(P.NOT_S)),
                          lambda a: F.length(T.py_strip(F.regexp_replace(a, P.TAG, ""))))
    alts = F.transform(F.col("_alts"), lambda a: F.length(a))
    syl = F.transform(tokens, lambda t: F.greatest(T.count_matches(t, _SYLLABLE), F.lit(1)))
    wps = F.transform(F.col("_sentences"), lambda s: F.size(T.extract_all(s, P.WORD)))
    paras = T.paragraphs(text)
    spp = F.transform(paras, lambda p: T.sentence_piece_count(p))
    vbg = T.count_matches(text, P.VBG_JAVA)
    prp = F.size(F.filter(tokens, lambda t: t.isin(K.PRONOUNS)))
    rb = F.size(F.filter(tokens, lambda t: t.rlike(_RB_WORD)))

    def mean(arr):
        return F.when(F.size(arr) > 0,
                      F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)).otherwise(0.0)

    out = {
        "total_bytes": F.length(html).cast("double"),
        "text_bytes": F.length(text).cast("double"),
        "markup_to_text_ratio": _ratio(F.length(html) - F.length(text), F.length(html)),
        "percent_empty_tags": T.count_matches(html, _EMPTY_TAG_JAVA).cast("double") / n_tags,
        "inline_css_ratio": T.count_literal(F.lower(html), "style=").cast("double") / n_tags,
        "deprecated_tag_ratio": F.size(F.filter(tags, lambda t: t.isin(K.DEPRECATED_TAGS))).cast("double") / n_tags,
        "iframe_count": T.count_matches(html, P.IFRAME_JAVA).cast("double"),
        "total_links": total_links.cast("double"),
        "external_internal_ratio": _ratio(ext_links, int_links),
        "nofollow_ratio": _ratio(F.size(F.filter(F.col("_rels"), lambda r: F.lower(r).contains("nofollow"))),
                                 total_links),
        "links_per_kb": F.when(F.length(html) > 0, total_links / (F.length(html) / F.lit(1024.0))).otherwise(0.0),
        "avg_anchor_text_length": mean(anchors),
        "image_count": T.count_matches(html, _IMG).cast("double"),
        "avg_alt_length": F.when(html.contains('alt="'), mean(alts)).otherwise(0.0),
        "stopword_ratio": _ratio(F.size(F.filter(tokens, lambda t: t.isin(K.STOPWORDS))), n_tok),
        "syllables_per_word": mean(syl),
        "words_per_sentence": mean(wps),
        "sentences_per_paragraph": mean(spp),
        "vbg": vbg.cast("double"),
        "prp": prp.cast("double"),
        "straight_apostrophe": T.count_literal(text, "'").cast("double"),
        "i_x_that_is_not_y_but_z": T.count_matches(text, P.PHRASE_I_NOT_BUT_JAVA).cast("double"),
        "as_i_x_i_will_y": T.count_matches(text, P.PHRASE_AS_I_WILL_JAVA).cast("double"),
        "x_is_not_about_y_its_about_z": T.count_matches(text, P.PHRASE_NOT_ABOUT_JAVA).cast("double"),
        "type_token_ratio": _ratio(F.size(F.array_distinct(tokens)), n_tok),
        "vbg_ratio": _ratio(vbg, n_tok),
        "prp_ratio": _ratio(prp, n_tok),
        "rb_ratio": _ratio(rb, n_tok),
        "repeat_phrase_count": T.count_matches(text, _REPEAT_PHRASE_JAVA).cast("double"),
        "url_count": T.count_matches(text, _URL_IN_TEXT).cast("double"),
    }
    return base.select(id_col, *[v.alias(k) for k, v in out.items()])
