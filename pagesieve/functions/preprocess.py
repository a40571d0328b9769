"""Text normalization pipelines (N9..N18) as chains of built-in regex expressions.

Python regex features are mapped onto Java regex: ``\\w`` -> ``[\\p{L}\\p{N}_]``,
``\\d`` -> ``\\p{Nd}``, ``\\s`` -> the explicit whitespace class, and ``\\b`` ->
a look-around boundary (Java supports look-behind; RE2 does not, which is why
some of these steps are only checked against brute force, not DuckDB).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T

W, S, NS = P.W, P.S, P.NOT_S
D = r"\p{Nd}"
# Python's \b: a word char on exactly one side.
B = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# FIXED VALUES: the placeholder rules of the HTML text model, in their order.
BLOCK = rf"(?is)<(script|style|template|noscript)[\s>][^>]*>.*?</\1{S}*>"
TAG = rf"(?s)</?([A-Za-z][{P.W_BODY}:-]*)[^>]*?>"
URL = rf"https?://{NS}+|www\.{NS}+"
MAIL = rf"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{B}"
ISO = rf"{B}{D}{{4}}-{D}{{2}}-{D}{{2}}[tT]{D}{{2}}:{D}{{2}}:{D}{{2}}(?:\.{D}+)?Z{B}"
NUM = rf"{B}{D}+(?:[\.,]{D}+)*{B}"
UUID = (rf"{B}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-"
        rf"[0-9a-fA-F]{{12}}{B}")
HEX = rf"{B}0x[0-9A-Fa-f]+{B}|{B}[0-9A-Fa-f]{{6,}}{B}"
SKU = rf"{B}[A-Z]{{2,5}}[-_]{D}{{3,6}}{B}"
INVOICE = rf"{B}(?:INV|ORD|TXN){D}{{4,8}}{B}"
SLUG = rf"{B}(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*{D})[A-Za-z0-9]{{8,}}{B}"
ID = rf"{B}(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*{D})[A-Za-z0-9]{{4,}}{B}"
LEN = rf"(?i){B}(?:[a-z]{{1,3}}|[a-z]{{11,}}){B}"
SUFFIX = rf"(?i){B}[a-z]*(?:ing|ers?){B}"
COMMENT = r"(?s)<!--.*?-->"
ALT_TITLE = rf'(?i){B}(?:alt|title){S}*={S}*"([^"]*)"'
STOP_TRIGRAM = rf"(?i){B}[a-z]*(?:hat|tha|nth|tth|sth)[a-z]*{B}"

PLACEHOLDERS = [
    (URL, " __url__ "), (MAIL, " __email__ "), (ISO, " __iso_date__ "), (NUM, " __num__ "),
    (UUID, " __uuid__ "), (HEX, " __hex__ "), (SKU, " __sku__ "), (INVOICE, " __invoice__ "),
    (SLUG, " __slug__ "), (ID, " __id__ "),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blocks_to_placeholders(s) -> Column:
    """script/style/template/noscript blocks -> `` __tag_<name>__ ``."""
    return F.regexp_replace(_c(s), BLOCK, " __tag_$1__ ")


def tags_to_placeholders(s) -> Column:
    """Any tag -> `` __tag_<name>__ `` (lower-cased by the final step)."""
    return F.regexp_replace(_c(s), TAG, " __tag_$1__ ")


def placeholders(s) -> Column:
    """Url, email, ISO time, number, UUID, hex, SKU, invoice, slug, id, in that order."""
    c = _c(s)
    for pat, rep in PLACEHOLDERS:
        c = F.regexp_replace(c, pat, rep)
    return c


def drop_short_long_words(s) -> Column:
    """Words of 1-3 or 11+ ASCII letters -> space."""
    return F.regexp_replace(_c(s), LEN, " ")


def drop_suffix_words(s) -> Column:
    """Whole words ending in ing/er/ers are deleted."""
    return F.regexp_replace(_c(s), SUFFIX, "")


def drop_comments_attrs_trigrams(s) -> Column:
    """Comments, alt=/title= pairs, words holding hat/tha/nth/tth/sth."""
    c = F.regexp_replace(_c(s), COMMENT, " ")
    c = F.regexp_replace(c, ALT_TITLE, " ")
    return F.regexp_replace(c, STOP_TRIGRAM, " ")


def html_model_preprocess(s, unescape: str = "full") -> Column:
    """The whole HTML text-model pipeline N9..N15.

    ``unescape='full'`` decodes all entities, ``'basic'`` the five basic ones.
    """
    c = tags_to_placeholders(blocks_to_placeholders(s))
    c = T.html_unescape(c) if unescape == "full" else T.basic_unescape(c)
    c = placeholders(c)
    c = drop_short_long_words(c)
    c = drop_suffix_words(c)
    c = drop_comments_attrs_trigrams(c)
    return T.squeeze_ws(c)


# The first text-model pipeline.
FIRST_TOKEN = rf"[a-z]+|{D}+|[^{P.W_BODY}{P.WS_BODY}]"


def first_model_preprocess(s, min_len: int = 4, max_len: int = 10) -> Column:
    """letters/digits/symbols; runs of 3+ equal chars -> 2; digit tokens ->
    ``__num__``; keep length ``min_len..max_len``; cut ing/ers/er if ``min_len``
    letters stay; join by blank."""
    toks = T.extract_all(F.lower(_c(s)), FIRST_TOKEN)
    toks = F.transform(toks, lambda t: F.regexp_replace(t, r"(.)\1{2,}", "$1$1"))

    def one(t):
        n = F.length(t)
        cut = (F.when(t.endswith("ing") & (n - 3 >= min_len), n - 3)
               .when(t.endswith("ers") & (n - 3 >= min_len), n - 3)
               .when(t.endswith("er") & (n - 2 >= min_len), n - 2)
               .otherwise(n))
        return (F.when(t.rlike(rf"^{D}+$"), F.lit("__num__"))
                .when((n >= min_len) & (n <= max_len), F.substring(t, F.lit(1), cut)))

    return F.array_join(F.filter(F.transform(toks, one), lambda x: x.isNotNull()), " ")


# Legacy tokenizers.
def legacy_paragraphs(s) -> Column:
    """Paragraph pieces ``(?:.*?)(?:\\n+|$)``: newline tail kept, a final empty piece."""
    return T.extract_all(_c(s), r"(?d)(?:.*?)(?:\n+|$)")


SENTENCE_RULE = rf"(?d)(.*?[.!?])(?:{S}+|$)"


def legacy_sentences_regex(s) -> Column:
    """Sentences by the rule as one regex (quadratic on lines without a valid end)."""
    return T.extract_all(_c(s), SENTENCE_RULE, 1)


def legacy_sentences(s) -> Column:
    """Sentences need a closing mark followed by whitespace or the end.

    Same result as ``legacy_sentences_regex`` in linear time. A sentence never
    crosses a newline, so each line is cut after its last valid end (one
    anchored greedy match) before the rule runs, leaving no tail where every
    start position would scan to the line end. The rule's trailing whitespace
    run can cross lines: a line's first sentence loses its leading whitespace
    exactly when the last non-blank character before the line is a mark.
    """
    lines = F.split(F.coalesce(_c(s), F.lit("")), "\n", -1)
    last = F.transform(lines, lambda l: F.regexp_extract(l, rf"(?d)({NS}){S}*$", 1))
    # carry[i]: last non-blank character before line i (lambdas only see their own element)
    carry = F.aggregate(
        last, F.struct(F.array().cast("array<string>").alias("c"), F.lit("").alias("p")),
        lambda acc, x: F.struct(F.array_append(acc["c"], acc["p"]).alias("c"),
                                F.when(x != "", x).otherwise(acc["p"]).alias("p")))["c"]
    zipped = F.arrays_zip(lines.alias("l"), carry.alias("c"))
    cut = F.transform(zipped, lambda z: F.struct(
        F.regexp_extract(z["l"], rf"(?d)^(.*[.!?])(?={S}|$)", 1).alias("pre"),
        z["c"].isin(".", "!", "?").alias("strip")))
    per_line = F.transform(cut, lambda y: T.extract_all(
        F.when(y["strip"], F.regexp_replace(y["pre"], rf"^{S}+", "")).otherwise(y["pre"]), SENTENCE_RULE, 1))
    return F.flatten(per_line)


def line_sentences(s) -> Column:
    """``legacy_sentences`` of a text without newlines."""
    return T.extract_all(F.regexp_extract(_c(s), rf"(?d)^(.*[.!?])(?={S}|$)", 1), SENTENCE_RULE, 1)


def legacy_words(s) -> Column:
    return T.extract_all(_c(s), rf"{W}+")


def syllable_count(w) -> Column:
    return T.count_matches(w, r"(?i)[aeiouy]+")
