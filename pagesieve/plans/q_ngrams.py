"""N-gram queries T1..T9 (hash, expansion, encode, mask, allow list, pruning)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import patterns as P
from ..operators import ngrams as NG
from ..sources import model_io, tables
from . import sqlparts as Q
from .q_clean import TRAIN_CTE
from .q_model import _M, scored_sql_ctes
from .registry import query

B = H.DEFAULT_BUCKETS


def sql_fnv_state(s: str) -> str:
    byt = (f"list_transform(range(0, octet_length(encode({s}))), "
           f"lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT)")
    return (f"list_reduce({byt}, lambda acc, b: {{'hi': (acc.hi * {H.FNV_PRIME_LOW} + ((xor(acc.lo, b) * "
            f"{H.FNV_PRIME_LOW}) >> 32) + (xor(acc.lo, b) << 8)) & {H.MASK32}, 'lo': (xor(acc.lo, b) * "
            f"{H.FNV_PRIME_LOW}) & {H.MASK32}}}, {{'hi': {H.FNV_OFFSET_HI}::BIGINT, 'lo': {H.FNV_OFFSET_LO}::BIGINT}})")


def sql_bucket(s: str, buckets: int = B) -> str:
    st = sql_fnv_state(s)
    return f"((({st}).hi % {buckets}) * {(1 << 32) % buckets} + ({st}).lo) % {buckets}"


def sql_word_ngrams(w: str, min_n: int, max_n: int) -> str:
    parts = []
    for n in range(min_n, max_n + 1):
        parts.append(f"(CASE WHEN length({w}) > {n} THEN list_transform(range(1, length({w}) - {n} + 2), "
                     f"lambda i: substr({w}, i, {n})) ELSE []::VARCHAR[] END)")
        parts.append(f"(CASE WHEN length({w}) <> {n + 1} THEN [{w}] ELSE []::VARCHAR[] END)")
    cat = "flatten([" + ", ".join(parts) + "])"
    dist = f"list_filter({cat}, lambda x, i: NOT list_contains(({cat})[1:i - 1], x))"
    return f"(CASE WHEN regexp_matches({w}, {Q.lit(H.FULL_TOKEN)}) THEN [{w}] ELSE {dist} END)"


def _tokens_sql(text: str, cap: int | None = None) -> str:
    t = f"regexp_extract_all(lower(coalesce({text}, '')), {Q.lit(P.MODEL_TOKEN)})"
    return f"({t})[1:{cap}]" if cap else t


def _bench_words(spark, sf_dir):
    b = tables.load(spark, sf_dir, "benchmark")
    return b.select(F.explode(NG.split_tokens(F.col("text"))).alias("word")).distinct()


_BENCH_WORDS_SQL = f"bw AS (SELECT DISTINCT unnest({_tokens_sql('text', None)}) AS word FROM benchmark)"


@query("t01_bucket_hash", f"""WITH {_BENCH_WORDS_SQL}
SELECT word, {sql_bucket('word')} AS bucket FROM bw""")
def t01_bucket_hash(spark, sf_dir):
    w = _bench_words(spark, sf_dir)
    return H.with_bucket(w, "word", "bucket", B)


@query("t02_word_ngrams", f"""WITH {_BENCH_WORDS_SQL}
SELECT word, array_to_string({sql_word_ngrams('word', 3, 4)}, '|') AS ngrams FROM bw""")
def t02_word_ngrams(spark, sf_dir):
    w = _bench_words(spark, sf_dir)
    return w.select("word", F.array_join(H.word_ngrams(F.col("word"), 3, 4), "|").alias("ngrams"))


def _mask_sql(src: str, text: str, min_n: int, max_n: int, min_freq: int) -> str:
    return f"""mtok AS (SELECT unnest({_tokens_sql(text, None)}) AS w FROM {src}),
mwc AS (SELECT w, count(*) AS n FROM mtok GROUP BY w),
mgc AS (SELECT unnest({sql_word_ngrams('w', min_n, max_n)}) AS g, n FROM mwc),
mkept AS (SELECT g FROM mgc GROUP BY g HAVING sum(n) >= {min_freq}),
mask AS (SELECT DISTINCT {sql_bucket('g')} AS bucket FROM mkept)"""


@query("t06_subword_mask", f"""WITH {_mask_sql('documents', 'text', 3, 4, 3)}
SELECT bucket FROM mask""")
def t06_subword_mask(spark, sf_dir):
    return NG.subword_mask(tables.documents(spark, sf_dir), "doc_id", "text", 3, 4, 3, B)


def _encode_sql(src: str, id_col: str, text: str, min_n: int, max_n: int, masked: bool) -> str:
    mask_join = "JOIN mask USING (bucket)" if masked else ""
    return f"""occ AS (SELECT {id_col}, unnest(tk) AS word, unnest(range(len(tk))) AS word_pos
   FROM (SELECT {id_col}, {_tokens_sql(text)} AS tk FROM {src})),
dw AS (SELECT DISTINCT word FROM occ),
wg AS (SELECT word, unnest(gl) AS ngram, unnest(range(len(gl))) AS gram_pos
   FROM (SELECT word, {sql_word_ngrams('word', min_n, max_n)} AS gl FROM dw)),
wb AS (SELECT word, gram_pos, ngram, {sql_bucket('ngram')} AS bucket FROM wg),
wk AS (SELECT wb.* FROM wb {mask_join} WHERE bucket <> 0),
enc AS (SELECT occ.{id_col}, occ.word_pos, wk.gram_pos, wk.ngram, wk.bucket FROM occ JOIN wk USING (word))"""


@query("t04_encode", f"""WITH {_encode_sql('documents', 'doc_id', 'text', 3, 4, False)}
SELECT doc_id, count(*) AS n_ids, sum(bucket)::BIGINT AS bucket_sum, count(DISTINCT word_pos) AS n_words_with_ids
FROM enc GROUP BY doc_id""")
def t04_encode(spark, sf_dir):
    return NG.encode_summary(tables.documents(spark, sf_dir), "doc_id", "text", 3, 4, B)


@query("t05_batch_encode_masked", f"""WITH {TRAIN_CTE}, {_mask_sql('tr', 'text', 4, 5, 10)},
{_encode_sql('tr', 'doc_id', 'text', 4, 5, True)}
SELECT doc_id, count(*) AS n_ids, sum(bucket)::BIGINT AS bucket_sum FROM enc GROUP BY doc_id""")
def t05_batch_encode_masked(spark, sf_dir):
    """Mask built on the labelled texts (n-grams 4-5, min freq 10), then every text encoded."""
    tr = tables.train_table(spark, sf_dir)
    mask = NG.subword_mask(tr, "doc_id", "text", 4, 5, 10, B)
    e = NG.encode_summary(tr, "doc_id", "text", 4, 5, B, mask=mask)
    return e.select("doc_id", "n_ids", "bucket_sum")


@query("t07_raw_ngrams", f"""WITH occ AS (SELECT doc_id, unnest(tk) AS word, unnest(range(len(tk))) AS word_pos
   FROM (SELECT doc_id, {_tokens_sql('text')} AS tk FROM documents)),
g AS (SELECT doc_id, {sql_word_ngrams('word', 3, 4)} AS gl FROM occ)
SELECT doc_id, sum(len(gl))::BIGINT AS n_grams, count(*) AS n_words FROM g GROUP BY doc_id""")
def t07_raw_ngrams(spark, sf_dir):
    r = NG.raw_ngrams(tables.documents(spark, sf_dir), "doc_id", "text", 3, 4)
    return r.groupBy("doc_id").agg(F.sum(F.size("ngrams")).cast("long").alias("n_grams"),
                                   F.count("*").alias("n_words"))


@query("t08_allow_list_grams", f"""WITH {scored_sql_ctes(_M)}
SELECT page_id, ngram, count(*) AS n FROM subs JOIN u USING (ngram) GROUP BY page_id, ngram""")
def t08_allow_list_grams(spark, sf_dir):
    grams = model_io.gram_table(spark, model_io.load_model(spark))
    out = NG.allow_list_grams(tables.pages(spark, sf_dir), grams, "page_id", "html")
    return out.groupBy("page_id", "ngram").agg(F.count("*").alias("n"))


@query("t09_prune_vocabulary", f"""WITH u(ngram) AS (VALUES {', '.join(f'({Q.lit(g)})' for g in sorted(_M.u))}),
occ AS (SELECT unnest({_tokens_sql('text')}) AS word FROM documents),
g AS (SELECT unnest({sql_word_ngrams('word', 4, 10)}) AS ngram FROM occ)
SELECT ngram, count(*) AS n FROM g WHERE ngram IN (SELECT ngram FROM u) GROUP BY ngram""")
def t09_prune_vocabulary(spark, sf_dir):
    grams = model_io.gram_table(spark, model_io.load_model(spark))
    words = tables.documents(spark, sf_dir).select(F.explode(NG.split_tokens(F.col("text"))).alias("word"))
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    e = words.select("n", F.explode(NG.H.word_ngrams(F.col("word"), 4, 10)).alias("ngram"))
    return NG.prune_vocabulary(e, grams).groupBy("ngram").agg(F.sum("n").alias("n"))
