"""Entity decoding against the standard library."""
import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from pagesieve.functions import text as TX

NUMBERS = [*range(300), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10 ** 30]
ODD = ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg;", "&amp;amp;", "&notit;", "&" + "a" * 40 + ";", "&\n&lt", "x&ampé", "&#38;lt;"]


def _mixed(n):
    r = random.Random(3)
    parts = ["&", "#", "x", "amp", "lt", "not", "in", ";", "12", "a", " ", "é", "😀", "&amp", "&#x4"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 8))) for _ in range(n)]


def test_all_references_equal_the_standard_library(spark):
    named = [f"{a}&{n}{z}" for n in {x.rstrip(";") for x in html5} for a, z in (("", ""), ("x", ";"), ("", "zz;"))]
    numbered = [f"&#{x}{z}" for n in NUMBERS for x in (str(n), f"x{n:x}", f"X000{n:X}") for z in (";", "g")]
    cases = named + numbered + ODD + _mixed(500)
    df = spark.createDataFrame([*enumerate(cases), (-1, None)], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", TX.html_unescape("t").alias("u")).collect()}
    assert got.pop(-1) is None
    assert [c for i, c in enumerate(cases) if got[i] != html.unescape(c)] == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a",)], "t string").select(TX.html_unescape(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
