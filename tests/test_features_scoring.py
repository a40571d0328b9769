import math

import brute
import pytest
from pyspark.sql import functions as F

from pagesieve import constants as K
from pagesieve.operators import explain as EX
from pagesieve.operators import features as FE
from pagesieve.operators import scoring as SC

# Pages written for these tests with the value of each feature worked out by hand
# (features that are not named are not checked for that page).
PAGES = {
    "plain": ("<p>Cats sleep. Dogs bark!</p>",
              {"stopword_ratio": 0, "type_token_ratio": 1, "links_per_kb": 0, "vbg": 0, "straight_apostrophe": 0,
               "prp_ratio": 0, "iframe_count": 0, "sentences_per_paragraph": 3, "markup_to_text_ratio": 5 / 29}),
    "repeat": ("go go go stop", {"type_token_ratio": 0.5, "sentences_per_paragraph": 1, "markup_to_text_ratio": 0}),
    "negation": ("<b>I found that is not cheap, but useful</b> and I saw that is not red,but blue",
                 {"i_x_that_is_not_y_but_z": 2}),
    "promise": ("As I age, I will rest. as i cook , i will eat. As I run, I will win.", {"as_i_x_i_will_y": 2}),
    "links": ("<a href='/one'>a</a><a HREF=\"two\">b</a><a href=three>c</a>" + "x" * 966, {"links_per_kb": 2}),
    "styles": ("<div style='a'><p style=\"b\"><i>t</i></div>", {"inline_css_ratio": 2 / 3}),
    "frames": ("<iframe src=a></iframe>< IFRAME ><iframes>", {"iframe_count": 2}),
    "verbs": ("sing king ing running Walking swimming's", {"vbg": 5, "straight_apostrophe": 1}),
    "pronouns": ("We told them that it hurt him", {"prp_ratio": 4 / 7}),
    "paragraphs": ("One. Two.\n\n\nThree\n\n  \n\nFour? Five! Six", {"sentences_per_paragraph": (3 + 1 + 3) / 3}),
    "stopwords": (" ".join(K.STOPWORDS), {"stopword_ratio": 1, "type_token_ratio": 1}),
    "script": ("<script>going '</script>left<style>'</STYLE>right", {"vbg": 0, "straight_apostrophe": 0}),
    "open": ("<script>var a = '<p>'; running", {"vbg": 1, "straight_apostrophe": 2}),
    "empty": ("", dict.fromkeys(K.NUM_COLUMNS, 0)),
    "unicode": ("Ærlig talt’s çok 日本語 ‘x’ it's", {"straight_apostrophe": 1, "type_token_ratio": 7 / 8}),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, k, PAGES[k][0]) for i, k in enumerate(sorted(PAGES))]
    rows.append((len(rows), "grams", "The Researchers' research re-searched: initiative_initiative, xyz!"))
    rows.append((len(rows), "none", None))
    small = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        (F.col("page_id") + 1000).alias("page_id"), F.lit("real").alias("case"), "html")
    return spark.createDataFrame(rows, "page_id long, case string, html string").unionByName(small)


def test_features_have_the_worked_out_values(pages):
    got = {r.case: r for r in FE.page_features(pages.where("case <> 'real'"), keep=["case"]).collect()}
    for case, (_, want) in PAGES.items():
        for column, value in want.items():
            assert math.isclose(got[case][column], value, abs_tol=1e-12), (case, column, got[case][column], value)


def test_word_features_of_texts_without_markup(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("page_id"), F.regexp_replace("text", "[<>]", " ").alias("html"))
    for r in FE.page_features(texts, id_col="page_id", keep=["html"]).collect():
        for column, value in brute.simple_features(r.html).items():
            assert math.isclose(r[column], value, abs_tol=1e-12), (r.page_id, column)


@pytest.mark.parametrize("denominator", ["all", "matched"])
def test_text_score_equals_search_for_each_gram(pages, model, denominator):
    only = denominator == "matched"
    kw = {"denominator": SC.MATCHED_ONLY} if only else {}
    rows = SC.score_pages(pages, model, keep=["html"], **kw).collect()
    assert len(rows) > len(PAGES)
    for r in rows:
        (t0, t1), grams, _ = brute.gram_score(r.html or "", model.u, only)
        assert math.isclose(r.text0, t0, abs_tol=1e-12) and math.isclose(r.text1, t1, abs_tol=1e-12)
        assert list(r.grams) == grams
        assert math.isclose(r.p_slop + r.p_not_slop, 1.0, abs_tol=1e-12)


def test_scoring_is_deterministic_and_joined_form_agrees(spark, pages, model):
    from pagesieve.sources import model_io
    cols = ["page_id", "z0", "z1"]
    first, second = (sorted(tuple(r) for r in SC.score_pages(pages, model).select(*cols).collect()) for _ in range(2))
    assert first == second
    inrow = {r.page_id: r.text0 for r in SC.score_pages(pages, model).collect()}
    for r in SC.score_text_by_join(pages, model_io.gram_table(spark, model)).collect():
        assert math.isclose(r.text0, inrow[r.page_id], abs_tol=1e-12)


def test_report_names_its_reasons(pages, model):
    rep = EX.report(SC.score_pages(pages.where("case = 'negation'"), model, keep=["html"]), model).first().report
    assert rep.startswith("I think this is more likely")
    assert "I found that is not cheap, but useful" in rep


def test_bands(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.15,), (0.29,), (0.3,), (0.6,), (1.0,)], "s double")
    got = [r.b for r in df.select(SC.band(F.col("s")).alias("b")).collect()]
    assert got == [None, "Slop!", "Risk", "Risk", "Hmm", "No Slop", "No Slop"]
