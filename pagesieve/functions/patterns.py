"""Regex building blocks.

Spark runs Java regex; the DuckDB oracle runs RE2. Both accept the class
strings below. Python's ``\\w`` (Unicode) equals ``[\\p{L}\\p{N}_]`` and
Python's ``\\s`` (and ``str.strip``) is the explicit whitespace class
``WS_BODY``; neither engine's own ``\\w``/``\\s`` is used, because Java's are
ASCII and RE2's ``\\s`` lacks the vertical tab.
"""

from __future__ import annotations

import re

W_BODY = r"\p{L}\p{N}_"
W = f"[{W_BODY}]"
NOT_W = f"[^{W_BODY}]"
WS_BODY = (r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
S = f"[{WS_BODY}]"
NOT_S = f"[^{WS_BODY}]"

# Java: boundary helpers by look-around (RE2 lacks them; the oracle counts tokens).
B_BEFORE = f"(?<!{W})"
B_AFTER = f"(?!{W})"

# Block and tag removal (same text in Java and RE2).
SCRIPT_STYLE = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>"
TAG = r"<[^>]+>"
WORD = f"{W}+"
MODEL_TOKEN = f"{W}+|[^{W_BODY}{WS_BODY}]+"
PARAGRAPH_SPLIT = r"\n{2,}"
SENTENCE_MARKS = r"[.!?]+"
TAG_OPEN = f"<{S}*{W}"
HREF = r"""(?i)href=["'][^"']+["']"""
HREF_VALUE = r"""(?i)href=["']([^"']+)["']"""
IFRAME_JAVA = f"(?i)<{S}*iframe{B_AFTER}"
VBG_JAVA = f"{B_BEFORE}{W}+ing{B_AFTER}"

# Phrase features (Java form; case-insensitive with Unicode case).
PHRASE_I_NOT_BUT_JAVA = (f"(?iu){B_BEFORE}I{S}+{W}+{S}+that{S}+is{S}+not{S}+"
                         f"{W}+,{S}*but{S}+{W}+")
PHRASE_AS_I_WILL_JAVA = f"(?iu){B_BEFORE}As{S}+I{S}+{W}+,{S}*I{S}+will{S}+{W}+"
PHRASE_NOT_ABOUT_JAVA = (f"(?iu){B_BEFORE}{W}+{S}+is{S}+not{S}+about{S}+{W}+,"
                         f"{S}*it's{S}+about{S}+{W}+")

# RE2 form of the phrases: a consumed non-word char (or start) stands in for \b.
PHRASE_I_NOT_BUT_RE2 = (f"(?i)(?:^|{NOT_W})(I{S}+{W}+{S}+that{S}+is{S}+not{S}+"
                        f"{W}+,{S}*but{S}+{W}+)")
PHRASE_AS_I_WILL_RE2 = f"(?i)(?:^|{NOT_W})(As{S}+I{S}+{W}+,{S}*I{S}+will{S}+{W}+)"
PHRASE_NOT_ABOUT_RE2 = (f"(?i)(?:^|{NOT_W})({W}+{S}+is{S}+not{S}+about{S}+{W}+,"
                        f"{S}*it's{S}+about{S}+{W}+)")


def literal_alternation(words) -> str:
    """A regex matching any of the literal words (Java and RE2 safe)."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda s: (-len(s), s))) + ")"
