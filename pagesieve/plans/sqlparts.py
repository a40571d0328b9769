"""SQL building blocks for the DuckDB oracle (RE2 dialect, DuckDB 2 lambdas)."""

from __future__ import annotations

from .. import constants as K
from ..functions import patterns as P


def lit(s: str) -> str:
    """A SQL string literal (backslashes are kept as is by DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def count_re(expr: str, pattern: str, group: int = 0) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}, {group}))"


def count_lit(expr: str, needle: str) -> str:
    return f"((length({expr}) - length(replace({expr}, {lit(needle)}, ''))) // {len(needle)})"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN ({num})::DOUBLE / ({den}) ELSE 0.0 END)"


def r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6)"


VISIBLE_TEXT = (f"regexp_replace(regexp_replace(coalesce({{h}}, ''), {lit(P.SCRIPT_STYLE)}, '', 'g'), "
                f"{lit(P.TAG)}, ' ', 'g')")


def visible_text(html_expr: str) -> str:
    return VISIBLE_TEXT.format(h=html_expr)


def word_tokens(text_expr: str) -> str:
    return f"regexp_extract_all(lower({text_expr}), {lit(P.WORD)})"


def model_tokens(text_expr: str) -> str:
    return f"regexp_extract_all(lower({text_expr}), {lit(P.MODEL_TOKEN)})"


def paragraphs(text_expr: str) -> str:
    return (f"list_filter(string_split_regex({text_expr}, {lit(P.PARAGRAPH_SPLIT)}), "
            f"lambda p: regexp_matches(p, {lit(P.NOT_S)}))")


def page_base_cte(table: str = "pages", id_col: str = "page_id", html_col: str = "html") -> str:
    """CTEs ``pb`` (id, html, text) and ``pk`` (+ tokens) for page features."""
    return (f"pb AS (SELECT {id_col}, coalesce({html_col}, '') AS html, "
            f"{visible_text(html_col)} AS text FROM {table}), "
            f"pk AS (SELECT *, {word_tokens('text')} AS toks FROM pb)")


def feature_exprs(html: str = "html", text: str = "text", toks: str = "toks") -> dict[str, str]:
    """The twelve features in SQL over columns of ``pk``."""
    n_tok = f"len({toks})"
    n_tags = f"greatest({count_re(html, P.TAG_OPEN)}, 1)"
    paras = paragraphs(text)
    pieces = f"list_transform({paras}, lambda p: {count_re('p', P.SENTENCE_MARKS)} + 1)"
    spp = (f"(CASE WHEN len({paras}) > 0 THEN list_sum({pieces})::DOUBLE / len({paras}) "
           f"ELSE 0.0 END)")
    iframes = (f"len(list_filter(regexp_extract_all({html}, "
               f"{lit('(?i)<' + P.S + '*iframe(' + P.W + '*)')}, 1), lambda x: x = ''))")
    vbg = (f"len(list_filter(regexp_extract_all({text}, {lit(P.WORD)}), "
           f"lambda x: length(x) >= 4 AND suffix(x, 'ing')))")
    return {
        "as_i_x_i_will_y": f"{count_re(text, P.PHRASE_AS_I_WILL_RE2, 1)}::DOUBLE",
        "i_x_that_is_not_y_but_z": f"{count_re(text, P.PHRASE_I_NOT_BUT_RE2, 1)}::DOUBLE",
        "iframe_count": f"{iframes}::DOUBLE",
        "inline_css_ratio": f"({count_lit(f'lower({html})', 'style=')})::DOUBLE / {n_tags}",
        "links_per_kb": (f"(CASE WHEN length({html}) > 0 THEN {count_re(html, P.HREF)}::DOUBLE / "
                         f"(length({html})::DOUBLE / 1024.0::DOUBLE) ELSE 0.0 END)"),
        "markup_to_text_ratio": ratio(f"length({html}) - length({text})", f"length({html})"),
        "prp_ratio": ratio(f"len(list_filter({toks}, lambda t: t IN {in_list(K.PRONOUNS)}))", n_tok),
        "sentences_per_paragraph": spp,
        "stopword_ratio": ratio(f"len(list_filter({toks}, lambda t: t IN {in_list(K.STOPWORDS)}))", n_tok),
        "straight_apostrophe": f"{count_lit(text, chr(39))}::DOUBLE",
        "type_token_ratio": ratio(f"len(list_distinct({toks}))", n_tok),
        "vbg": f"{vbg}::DOUBLE",
    }
