import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "n", "h", "size", "key", "sig", "cid", "tok", "g", "row", "bucket", "extra", "score", "kept", "shard_id",
         "component_id", "lang_pred", "spans", "ids", "perplexity", "_id"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text, lang) rows, with further columns whose names operators use inside."""
    def make(rows, clash=True):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, t, lang, "src", len(t) if t is not None else None) for i, t, lang in rows],
                                   COLUMNS)
        return df.withColumns({c: F.lit(c) for c in CLASH}) if clash else df
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and blank texts, one very long text, ties, repeated rows."""
    prose = "the quick brown fox jumps over the lazy dog and then it sleeps near the old mill by the river"
    return [(1, prose, "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (5, "12 34 !!", None),
            (6, prose, "en"), (6, prose, "en"), (7, "ein Text über schöne alte Mühlen am Fluss", "de"),
            (8, "word " * 40_000, "en"), (9, "x", None), (10, prose.upper(), None), (11, "α β γ", None),
            (12, "one two three four", "en"), (13, "One Two three four", "en"), (14, "x" * 50_000, None)]
