"""Text normalization queries N1..N18 (each step on its own, over whole tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import preprocess as PP
from ..functions import text as T
from ..sources import tables
from . import sqlparts as Q
from .registry import query

PARA_P = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
_STRIP = Q.lit(f"^{P.S}+|{P.S}+$")


def _pages(spark, sf_dir):
    return tables.pages(spark, sf_dir)


def _docs(spark, sf_dir):
    return tables.documents(spark, sf_dir)


@query("n01_strip_script_style", f"""SELECT page_id,
  length(regexp_replace(coalesce(html, ''), {Q.lit(P.SCRIPT_STYLE)}, '', 'g')) AS n_chars FROM pages""")
def n01_strip_script_style(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", F.length(T.strip_script_style(F.coalesce("html", F.lit("")))).cast("long").alias("n_chars"))


@query("n02_visible_text", f"""SELECT page_id, md5({Q.visible_text('html')}) AS text_md5 FROM pages""")
def n02_visible_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(T.visible_text("html")).alias("text_md5"))


@query("n03_paragraph_text", f"""SELECT page_id, array_to_string(list_transform(
  regexp_extract_all(coalesce(html, ''), {Q.lit(PARA_P)}, 1),
  lambda s: regexp_replace(regexp_replace(s, {Q.lit(P.TAG)}, '', 'g'), {_STRIP}, '', 'g')), chr(10)) AS text FROM pages""")
def n03_paragraph_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.paragraph_text("html").alias("text"))


@query("n04_word_tokens", f"""SELECT tok, count(*) AS n FROM (SELECT unnest({Q.word_tokens(Q.visible_text('html'))}) AS tok FROM pages) GROUP BY tok""")
def n04_word_tokens(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select(F.explode(T.word_tokens(T.visible_text("html"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query("n05_model_tokens", f"""SELECT tok, count(*) AS n FROM (SELECT unnest({Q.model_tokens("coalesce(html, '')")}) AS tok FROM pages) GROUP BY tok""")
def n05_model_tokens(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select(F.explode(T.model_tokens(F.coalesce("html", F.lit("")))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query("n06_paragraph_split", f"""SELECT doc_id, len({Q.paragraphs("coalesce(text, '')")}) AS n_paragraphs FROM documents""")
def n06_paragraph_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.paragraphs(F.coalesce("text", F.lit("")))).cast("long").alias("n_paragraphs"))


@query("n07_sentence_pieces", f"""SELECT doc_id, list_sum(list_transform({Q.paragraphs("coalesce(text, '')")},
  lambda p: {Q.count_re('p', P.SENTENCE_MARKS)} + 1))::BIGINT AS n_pieces FROM documents""")
def n07_sentence_pieces(spark, sf_dir):
    paras = T.paragraphs(F.coalesce("text", F.lit("")))
    n = F.aggregate(paras, F.lit(0).cast("long"), lambda a, p: a + T.sentence_piece_count(p))
    return _docs(spark, sf_dir).select("doc_id", F.when(F.size(paras) > 0, n).cast("long").alias("n_pieces"))


def _basic_unescape_sql(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {Q.lit(ent)}, {Q.lit(ch)})"
    return x


@query("n08_basic_unescape", f"""SELECT page_id, md5({_basic_unescape_sql("coalesce(html, '')")}) AS html_md5 FROM pages""")
def n08_basic_unescape(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(T.basic_unescape(F.coalesce("html", F.lit("")))).alias("html_md5"))


@query("n08_html_unescape")
def n08_html_unescape(spark, sf_dir):
    """All named and numeric entities decoded in the JVM (SQL has no such table; tested against the stdlib)."""
    return _pages(spark, sf_dir).select("page_id", F.length(T.html_unescape(F.col("html"))).cast("long").alias("n_chars"))


# The block rule without a back-reference: one alternative per name.
_BLOCK_RE2 = "(?is)" + "|".join(rf"<({n})[{P.WS_BODY}>][^>]*>.*?</{n}{P.S}*>"
                                for n in ("script", "style", "template", "noscript"))


@query("n09_block_placeholders", f"""SELECT page_id,
  md5(regexp_replace(lower(html), {Q.lit(_BLOCK_RE2)}, ' __tag_\\1\\2\\3\\4__ ', 'g')) AS html_md5 FROM pages""")
def n09_block_placeholders(spark, sf_dir):
    """Script/style/template/noscript blocks -> placeholders."""
    return _pages(spark, sf_dir).select("page_id", F.md5(PP.blocks_to_placeholders(F.lower("html"))).alias("html_md5"))


_TAG_RE2 = rf"(?s)</?([A-Za-z][{P.W_BODY}:-]*)[^>]*?>"


@query("n10_tag_placeholders", f"""SELECT page_id, md5(regexp_replace(lower(html), {Q.lit(_TAG_RE2)}, ' __tag_\\1__ ', 'g')) AS html_md5 FROM pages""")
def n10_tag_placeholders(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(PP.tags_to_placeholders(F.lower("html"))).alias("html_md5"))


@query("n11_url_placeholder", f"""SELECT doc_id, md5(regexp_replace(lower(text), {Q.lit(PP.URL)}, ' __url__ ', 'g')) AS text_md5 FROM documents""")
def n11_url_placeholder(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(F.lower("text"), PP.URL, " __url__ ")).alias("text_md5"))


@query("n11_placeholders")
def n11_placeholders(spark, sf_dir):
    """The ten placeholder rules in order (look-around boundaries: Java only)."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(PP.placeholders(F.lower("text"))).alias("text_md5"))


def _whole_words(text: str, rule: str, by: str) -> str:
    """Replace the words (maximal runs of word characters) that a rule matches as a whole."""
    return (f"array_to_string(list_transform(regexp_extract_all({text}, {Q.lit(f'{P.W}+|{P.NOT_W}+')}), "
            f"lambda x: CASE WHEN regexp_full_match(x, {Q.lit(rule)}) THEN {Q.lit(by)} ELSE x END), '')")


@query("n12_drop_short_long_words", f"""SELECT doc_id, md5({_whole_words('lower(text)', '(?i)[a-z]{1,3}|[a-z]{11,}', ' ')}) AS text_md5
FROM documents""")
def n12_drop_short_long_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(PP.drop_short_long_words(F.lower("text"))).alias("text_md5"))


@query("n13_drop_suffix_words", f"""SELECT doc_id, md5({_whole_words('lower(text)', '(?i)[a-z]*(?:ing|ers?)', '')}) AS text_md5
FROM documents""")
def n13_drop_suffix_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(PP.drop_suffix_words(F.lower("text"))).alias("text_md5"))


_ALT_RE2 = rf'(?i)(^|{P.NOT_W})(?:alt|title){P.S}*={P.S}*"[^"]*"'


@query("n14_drop_comments_attrs_trigrams", f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(lower(html),
  '(?s)<!--.*?-->', ' ', 'g'), {Q.lit(_ALT_RE2)}, '\\1 ', 'g') AS t FROM pages)
SELECT page_id, md5({_whole_words('t', '(?i)[a-z]*(?:hat|tha|nth|tth|sth)[a-z]*', ' ')}) AS html_md5 FROM c""")
def n14_drop_comments_attrs_trigrams(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(PP.drop_comments_attrs_trigrams(F.lower("html"))).alias("html_md5"))


@query("n15_squeeze_whitespace", f"""SELECT doc_id, md5(regexp_replace(lower(regexp_replace(text, {Q.lit(P.S + '+')}, ' ', 'g')), '^ +| +$', '', 'g')) AS text_md5 FROM documents""")
def n15_squeeze_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.squeeze_ws("text")).alias("text_md5"))


@query("n16_html_model_preprocess")
def n16_html_model_preprocess(spark, sf_dir):
    """The whole HTML text-model pipeline on lower-cased pages (full entity decoding)."""
    return _pages(spark, sf_dir).select("page_id", PP.html_model_preprocess(F.lower("html")).alias("text"))


def _first_pre_sql(x: str, min_len: int = 4, max_len: int = 10) -> str:
    toks = f"regexp_extract_all(lower({x}), {Q.lit(PP.FIRST_TOKEN)})"
    rep = "t"
    for c in "abcdefghijklmnopqrstuvwxyz":
        rep = f"regexp_replace({rep}, '{c}{{3,}}', '{c}{c}', 'g')"
    cut = (f"CASE WHEN suffix(t, 'ing') AND length(t) - 3 >= {min_len} THEN length(t) - 3 "
           f"WHEN suffix(t, 'ers') AND length(t) - 3 >= {min_len} THEN length(t) - 3 "
           f"WHEN suffix(t, 'er') AND length(t) - 2 >= {min_len} THEN length(t) - 2 ELSE length(t) END")
    one = (f"CASE WHEN regexp_matches(t, '^\\p{{Nd}}+$') THEN '__num__' "
           f"WHEN length(t) BETWEEN {min_len} AND {max_len} THEN substr(t, 1, {cut}) END")
    return (f"array_to_string(list_filter(list_transform(list_transform({toks}, lambda t: {rep}), "
            f"lambda t: {one}), lambda x: x IS NOT NULL), ' ')")


@query("n17_first_model_preprocess", f"""SELECT doc_id, md5({_first_pre_sql('text')}) AS text_md5 FROM documents""")
def n17_first_model_preprocess(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(PP.first_model_preprocess(F.col("text"))).alias("text_md5"))


@query("n18_legacy_tokenizers", f"""SELECT doc_id,
  len(regexp_extract_all(text, {Q.lit('(.*?[.!?])(?:' + P.S + '+|$)')}, 1)) AS n_sentences,
  len(regexp_extract_all(text, {Q.lit(P.WORD)})) AS n_words,
  len(regexp_extract_all(text, '(?i)[aeiouy]+')) AS n_syllable_runs FROM documents""")
def n18_legacy_tokenizers(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.size(PP.legacy_sentences(F.col("text"))).cast("long").alias("n_sentences"),
                    F.size(PP.legacy_words(F.col("text"))).cast("long").alias("n_words"),
                    PP.syllable_count(F.col("text")).alias("n_syllable_runs"))


@query("n18_legacy_paragraphs", f"""SELECT doc_id,
  len(regexp_extract_all(text, {Q.lit('(?:.*?)(?:' + chr(10) + '+|$)')})) AS n_paragraphs FROM documents""")
def n18_legacy_paragraphs(spark, sf_dir):
    """Legacy paragraph pieces (empty matches included, Java find() semantics)."""
    return _docs(spark, sf_dir).select("doc_id", F.size(PP.legacy_paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))
