"""Feature queries: F1..F13 (model inputs) and G1..G12 (wider set)."""

from __future__ import annotations

from .. import constants as K
from ..operators import features as FE
from ..sources import tables
from . import sqlparts as Q
from .common import round_doubles
from .registry import query

_FEATURE_IDS = {
    "stopword_ratio": "f01", "links_per_kb": "f02", "type_token_ratio": "f03",
    "i_x_that_is_not_y_but_z": "f04", "prp_ratio": "f05", "sentences_per_paragraph": "f06",
    "markup_to_text_ratio": "f07", "inline_css_ratio": "f08", "iframe_count": "f09",
    "as_i_x_i_will_y": "f10", "vbg": "f11", "straight_apostrophe": "f12",
}


def _one_feature_sql(name: str) -> str:
    e = Q.feature_exprs()[name]
    return f"WITH {Q.page_base_cte()} SELECT page_id, {Q.r6(e)} AS {name} FROM pk"


def _register_feature(name: str, qid: str) -> None:
    def fn(spark, sf_dir, name=name):
        return round_doubles(FE.page_features(tables.pages(spark, sf_dir)).select("page_id", name))
    query(f"{qid}_{name}", _one_feature_sql(name))(fn)


for _name, _qid in _FEATURE_IDS.items():
    _register_feature(_name, _qid)


def _feature_table_sql() -> str:
    ex = Q.feature_exprs()
    cols = ", ".join(f"{Q.r6(ex[c])} AS {c}" for c in K.NUM_COLUMNS)
    return f"WITH {Q.page_base_cte()} SELECT page_id, {cols} FROM pk"


@query("f13_feature_table", _feature_table_sql())
def f13_feature_table(spark, sf_dir):
    return round_doubles(FE.page_features(tables.pages(spark, sf_dir)))


@query("f13_document_feature_table",
       _feature_table_sql().replace("FROM pages", "FROM (SELECT doc_id AS page_id, text AS html FROM documents)"))
def f13_document_feature_table(spark, sf_dir):
    """The same twelve features over the documents table (text as markup-free html)."""
    docs = tables.documents(spark, sf_dir).withColumnRenamed("doc_id", "page_id")
    return round_doubles(FE.page_features(docs, html_col="text"))


# Wider set: the Java-only rules (empty-tag and repeated-word back-references)
# are checked without an oracle in g02_percent_empty_tags / g12_repeat_phrase.
_WIDE_ORACLE = [
    "total_bytes", "text_bytes", "deprecated_tag_ratio", "total_links", "external_internal_ratio",
    "nofollow_ratio", "avg_anchor_text_length", "image_count", "avg_alt_length",
    "syllables_per_word", "words_per_sentence", "vbg_ratio", "prp_ratio", "rb_ratio",
    "x_is_not_about_y_its_about_z", "url_count",
]


def _wide_sql() -> str:
    from ..functions import patterns as P
    S, W, NOT_S = P.S, P.W, P.NOT_S
    tags = f"regexp_extract_all(lower(html), {Q.lit('<' + S + '*(' + W + '+)')}, 1)"
    hrefs = f"regexp_extract_all(html, {Q.lit(P.HREF_VALUE)}, 1)"
    n_tags = f"greatest(len({tags}), 1)"
    ext = f"len(list_filter({hrefs}, lambda h: starts_with(h, 'http://') OR starts_with(h, 'https://')))"
    rels = f"regexp_extract_all(html, {Q.lit(FE._REL_VALUES)}, 1)"
    anchors = (f"list_transform(list_filter(regexp_extract_all(html, {Q.lit(FE._ANCHOR_TEXT)}, 1), "
               f"lambda a: regexp_matches(a, {Q.lit(NOT_S)})), lambda a: length(regexp_replace("
               f"regexp_replace(a, {Q.lit(P.TAG)}, '', 'g'), {Q.lit('^' + S + '+|' + S + '+$')}, '', 'g')))")
    alts = f"list_transform(regexp_extract_all(html, {Q.lit(FE._ALT_VALUES)}, 1), lambda a: length(a))"
    syl = f"list_transform(toks, lambda t: greatest({Q.count_re('t', FE._SYLLABLE)}, 1))"
    sents = (f"list_filter(string_split_regex(text, {Q.lit(P.SENTENCE_MARKS)}), "
             f"lambda s: regexp_matches(s, {Q.lit(NOT_S)}))")
    wps = f"list_transform({sents}, lambda s: {Q.count_re('s', P.WORD)})"
    vbg = (f"len(list_filter(regexp_extract_all(text, {Q.lit(P.WORD)}), "
           f"lambda x: length(x) >= 4 AND suffix(x, 'ing')))")
    prp = f"len(list_filter(toks, lambda t: t IN {Q.in_list(K.PRONOUNS)}))"
    rb = f"len(list_filter(toks, lambda t: regexp_matches(t, {Q.lit(FE._RB_WORD)})))"

    def mean(arr):
        return f"(CASE WHEN len({arr}) > 0 THEN list_sum({arr})::DOUBLE / len({arr}) ELSE 0.0 END)"

    ex = {
        "total_bytes": "length(html)::DOUBLE",
        "text_bytes": "length(text)::DOUBLE",
        "deprecated_tag_ratio": f"len(list_filter({tags}, lambda t: t IN {Q.in_list(K.DEPRECATED_TAGS)}))::DOUBLE / {n_tags}",
        "total_links": f"len({hrefs})::DOUBLE",
        "external_internal_ratio": Q.ratio(ext, f"len({hrefs}) - {ext}"),
        "nofollow_ratio": Q.ratio(f"len(list_filter({rels}, lambda r: contains(lower(r), 'nofollow')))", f"len({hrefs})"),
        "avg_anchor_text_length": mean(anchors),
        "image_count": f"len(list_filter(regexp_extract_all(html, {Q.lit('(?i)<' + S + '*img(' + W + '*)')}, 1), lambda x: x = ''))::DOUBLE",
        "avg_alt_length": f"(CASE WHEN contains(html, 'alt=\"') THEN {mean(alts)} ELSE 0.0 END)",
        "syllables_per_word": mean(syl),
        "words_per_sentence": mean(wps),
        "vbg_ratio": Q.ratio(vbg, "len(toks)"),
        "prp_ratio": Q.ratio(prp, "len(toks)"),
        "rb_ratio": Q.ratio(rb, "len(toks)"),
        "x_is_not_about_y_its_about_z": f"{Q.count_re('text', P.PHRASE_NOT_ABOUT_RE2, 1)}::DOUBLE",
        "url_count": f"{Q.count_re('text', FE._URL_IN_TEXT)}::DOUBLE",
    }
    cols = ", ".join(f"{Q.r6(ex[c])} AS {c}" for c in _WIDE_ORACLE)
    return f"WITH {Q.page_base_cte()} SELECT page_id, {cols} FROM pk"


@query("g01_wide_feature_table", _wide_sql())
def g01_wide_feature_table(spark, sf_dir):
    return round_doubles(FE.wide_page_features(tables.pages(spark, sf_dir)).select("page_id", *_WIDE_ORACLE))


@query("g02_percent_empty_tags")
def g02_percent_empty_tags(spark, sf_dir):
    return round_doubles(FE.wide_page_features(tables.pages(spark, sf_dir))
                         .select("page_id", "percent_empty_tags"))


@query("g12_repeat_phrase_count")
def g12_repeat_phrase_count(spark, sf_dir):
    return round_doubles(FE.wide_page_features(tables.pages(spark, sf_dir))
                         .select("page_id", "repeat_phrase_count"))
