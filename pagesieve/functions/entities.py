"""HTML character references decoded with built-in expressions.

The text is split at ``&``. Of each piece the longest possible reference is cut
off; a number goes through the replacement rules, a name is looked up in a map by
its first letter, and where the whole name is unknown, its longest known
beginning among the names that need no semicolon counts. The names and the
replaced numbers are those of the Python standard library's tables.
"""

from __future__ import annotations

import html
import json
import re
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LAST = 0x10FFFF
_BARE = [n for n in html5 if not n.endswith(";")]


@lru_cache(maxsize=1)
def _numbers() -> tuple[dict[int, str], list[int]]:
    """Code points that a number does not stand for itself: with another text, and with none."""
    low = {n: html.unescape(f"&#{n};") for n in range(256)}
    other = {n: t for n, t in low.items() if t and t != chr(n)}
    high = [p * 0x10000 + x for p in range(17) for x in (0xFFFE, 0xFFFF)]
    none = [n for n in [*range(256), *range(0xFDD0, 0xFDF0), *high] if html.unescape(f"&#{n};") == ""]
    return other, none


def _map(value: dict, kind: str) -> Column:
    """A constant map: the optimizer folds it, once a plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _by_letter() -> Column:
    letters: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        letters.setdefault(name[0], {})[name] = text
    return _map(letters, "map<string,map<string,string>>")


def _named(name: Column) -> Column:
    """Text of a whole name, null if there is none."""
    return F.try_element_at(F.try_element_at(_by_letter(), F.substring(name, 1, 1)), name)


def _character(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _code(ref: Column) -> Column:
    """Number of ``#...`` (decimal or hexadecimal, with or without the semicolon)."""
    digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    return F.when(F.length(digits) > 7, F.lit(LAST + 1)).when(digits == "", F.lit(0)).otherwise(
        F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("int"))


def _number(n: Column) -> Column:
    other, none = _numbers()
    return (F.when(n.isin(none), F.lit(""))
            .when(n.isin(list(other)), F.try_element_at(_map(other, "map<string,string>"), n.cast("string")))
            .when((n > LAST) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .otherwise(_character(n)))


def _name(ref: Column) -> Column:
    beginnings = "|".join(sorted(map(re.escape, _BARE), key=len, reverse=True))
    head = F.regexp_extract(ref, f"^({beginnings})", 1)
    return F.coalesce(_named(ref), F.concat(_named(head), F.substr(ref, F.length(head) + 1)),
                      F.concat(F.lit("&"), ref))


def _reference(piece: Column) -> Column:
    ref = F.regexp_extract(piece, REFERENCE, 1)
    return F.struct(piece.alias("piece"), ref.alias("ref"))


def _parsed(x: Column) -> Column:
    return F.struct(x["ref"].alias("ref"), F.substr(x["piece"], F.length(x["ref"]) + 1).alias("rest"),
                    F.when(x["ref"].startswith("#"), _code(x["ref"])).alias("code"))


def _decoded(x: Column) -> Column:
    text = F.when(x["ref"] == "", F.lit("&")).when(x["code"].isNotNull(), _number(x["code"])).otherwise(_name(x["ref"]))
    return F.concat(text, x["rest"])


def html_unescape(text: Column) -> Column:
    """All named and numeric character references decoded; a null stays null."""
    pieces = F.split(text, "&", -1)
    return F.when(~text.contains("&"), text).otherwise(F.concat(
        pieces[0], F.array_join(F.transform(F.transform(F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces)), _reference), _parsed), _decoded), "")))
