"""Column -> Column text functions (HTML and text normalization).

All of them are built-in Spark expressions (JVM side, no Python in the row
path). Patterns are literals so the compiled Java pattern is cached per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import entities
from . import patterns as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_matches(col, pattern: str) -> Column:
    """Number of non-overlapping matches of ``pattern`` (as ``re.findall``)."""
    return F.regexp_count(_c(col), F.lit(pattern)).cast("long")


def extract_all(col, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(group))


def count_literal(col, needle: str) -> Column:
    """Occurrences of a literal (as ``str.count``), without a regex."""
    c = _c(col)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) /
            F.lit(len(needle))).cast("long")


# N1
def strip_script_style(html) -> Column:
    return F.regexp_replace(_c(html), P.SCRIPT_STYLE, "")


# N2
def tags_to_space(s) -> Column:
    return F.regexp_replace(_c(s), P.TAG, " ")


def visible_text(html) -> Column:
    """N1 then N2: the text the page features read."""
    return tags_to_space(strip_script_style(F.coalesce(_c(html), F.lit(""))))


# N4
def word_tokens(text) -> Column:
    """``\\w+`` over lower-cased text."""
    return extract_all(F.lower(_c(text)), P.WORD)


# N5
def model_tokens(text) -> Column:
    """Word runs or symbol runs over lower-cased text (the model tokenizer)."""
    return extract_all(F.lower(_c(text)), P.MODEL_TOKEN)


# N6
def paragraphs(text) -> Column:
    """Split on 2+ newlines, blank pieces dropped."""
    return F.filter(F.split(_c(text), P.PARAGRAPH_SPLIT, -1), lambda p: p.rlike(P.NOT_S))


# N7
def sentence_piece_count(p) -> Column:
    """Pieces of ``re.split('[.!?]+', p)`` (empty pieces count)."""
    return count_matches(p, P.SENTENCE_MARKS) + F.lit(1)


# N3
def paragraph_text(html, sep: str = "\n") -> Column:
    """Text of the ``<p>`` elements, tag-stripped and trimmed, joined by ``sep``."""
    inner = extract_all(F.coalesce(_c(html), F.lit("")), r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", 1)
    cleaned = F.transform(inner, lambda s: py_strip(F.regexp_replace(s, P.TAG, "")))
    return F.array_join(cleaned, sep)


# N8 (the five basic entities; full decoding is in entities.py)
def basic_unescape(s) -> Column:
    c = _c(s)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def html_unescape(s) -> Column:
    """Full HTML entity decoding with the rules of ``html.unescape``."""
    return entities.html_unescape(_c(s))


def py_strip(s) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(s), f"^{P.S}+|{P.S}+$", "")


# N15
def squeeze_ws(s) -> Column:
    return F.trim(F.lower(F.regexp_replace(_c(s), f"{P.S}+", " ")), F.lit(" "))
