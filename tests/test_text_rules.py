import re

from pyspark.sql import functions as F

from pagesieve.functions import preprocess as PP
from pagesieve.operators import lexical as LX

TEXTS = ["a. b", "  lead. \n  next line. tail without", "x.y. z!\n\n  after blank? yes",
         "no end here\n  but. here", "ends with mark.\n", "trail\n", "", "...", "a.\r\nb.", " . ",
         "é! ü? ok.", "one, two and three items. I say, I will go, fine", "x is not about y, it's about z"]


def test_sentence_rule_linear_form_equals_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    rx = re.compile(r"(.*?[.!?])(?:\s+|$)")
    for r in df.select("t", PP.legacy_sentences(F.col("t")).alias("s"),
                       PP.legacy_sentences_regex(F.col("t")).alias("r")).collect():
        assert list(r.s) == rx.findall(r.t) == list(r.r), r.t


def test_phrase_segment_form_equals_regex(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = sorted((r.doc_id, r.phrase, r.before, r.after) for r in LX.phrase_matches(df).collect()
                 if r.phrase != "that_is_not")
    assert got == sorted((i, k, a, b) for i, t in enumerate(TEXTS) for k in LX.SEGMENT_LITERALS
                         for a, b in re.findall(LX.PHRASES[k], t))
