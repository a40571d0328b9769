"""Corpus-comparison queries X1..X12, R6 and the legacy model M16, M18, M19."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import clean as CL
from ..operators import lexical as LX
from ..operators import reports as RP
from ..sources import tables
from . import sqlparts as Q
from .common import round_doubles
from .registry import query

CDOCS = """cdocs AS (SELECT d.doc_id, d.text, CASE WHEN l.quality = 0 THEN 'slop' ELSE 'human' END AS cls
  FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1))"""
SENT = f"(.*?[.!?])(?:{P.S}+|$)"
def _words(x: str) -> str:
    return f"regexp_extract_all({x}, {Q.lit(P.WORD)})"


def _cdocs(spark, sf_dir):
    t = tables.train_table(spark, sf_dir)
    return t.select("doc_id", "text", LX.class_col(F.col("label")).alias("cls"))


def _sents(x: str) -> str:
    return f"regexp_extract_all({x}, {Q.lit(SENT)}, 1)"


@query("x01_word_count_diff", f"""WITH {CDOCS},
w AS (SELECT cls, unnest(list_filter(string_split_regex(regexp_replace(text, {Q.lit(f'^{P.S}+|{P.S}+$')}, '', 'g'),
      {Q.lit(P.S + '+')}), lambda x: x <> '')) AS word FROM cdocs),
c AS (SELECT word, count(*) FILTER (WHERE cls = 'slop') AS n_slop, count(*) FILTER (WHERE cls = 'human') AS n_human
      FROM w GROUP BY word)
SELECT word, n_slop, n_human, greatest(n_slop - n_human, 0) AS diff FROM c WHERE n_slop > 0""")
def x01_word_count_diff(spark, sf_dir):
    return LX.word_count_diff(_cdocs(spark, sf_dir))


@query("x02_vocab_compare", f"""WITH {CDOCS},
w AS (SELECT cls, unnest(flatten(list_transform({_sents('lower(text)')}, lambda s: {_words('s')}))) AS word FROM cdocs),
c AS (SELECT word, count(*) FILTER (WHERE cls = 'slop') AS n_slop, count(*) FILTER (WHERE cls = 'human') AS n_human
      FROM w GROUP BY word)
SELECT word, n_slop, n_human, n_slop - n_human AS diff,
  CAST(n_slop AS VARCHAR) || ' - ' || CAST(n_human AS VARCHAR) || ' = ' || CAST(n_slop - n_human AS VARCHAR) AS text
FROM c WHERE n_slop - n_human <> 0 AND length(word) > 3""")
def x02_vocab_compare(spark, sf_dir):
    return LX.vocab_compare(_cdocs(spark, sf_dir))


_PIECES = f"regexp_extract_all(text, {Q.lit(LX.PIECE)})"
_WORDLIST_SQL = f"""wl AS (SELECT DISTINCT unnest(list_concat({_words('text')}, regexp_extract_all(text, {Q.lit(f'{P.W}+ {P.W}+')}))) AS word
  FROM benchmark),
pc AS (SELECT cls, doc_id, unnest(p) AS x, unnest(range(len(p))) AS pos FROM (SELECT cls, doc_id, {_PIECES} AS p FROM cdocs)),
win AS (SELECT cls, doc_id, pos, x AS word, 1 AS size FROM pc UNION ALL
  SELECT cls, doc_id, pos, x || lead(x, 1) OVER w || lead(x, 2) OVER w, 3 FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
oc AS (SELECT word, cls, doc_id, any_value(size) AS size, list(pos ORDER BY pos) AS poss FROM win JOIN wl USING (word)
  GROUP BY word, cls, doc_id),
hits AS (SELECT word, cls, CAST(sum(list_reduce(poss, lambda acc, x: CASE WHEN x >= acc.next
    THEN {{'next': x + size, 'n': acc.n + 1}} ELSE acc END, {{'next': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}}).n) AS BIGINT) AS n
  FROM oc GROUP BY word, cls)"""


def _hits(spark, sf_dir):
    wl = LX.word_list_from(tables.load(spark, sf_dir, "benchmark"), "text")
    return LX.word_list_hits(_cdocs(spark, sf_dir), wl)


@query("x03_word_list_hits", f"""WITH {CDOCS}, {_WORDLIST_SQL}
SELECT word, cls, n FROM hits""")
def x03_word_list_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("x04_word_list_diff", f"""WITH {CDOCS}, {_WORDLIST_SQL}
SELECT word, diff FROM (SELECT word, sum(CASE WHEN cls = 'slop' THEN n ELSE 0 END) - sum(CASE WHEN cls = 'human' THEN n ELSE 0 END) AS diff
  FROM hits GROUP BY word) WHERE diff > 0""")
def x04_word_list_diff(spark, sf_dir):
    return LX.word_list_diff(_hits(spark, sf_dir)).select("word", F.col("diff").cast("long").alias("diff"))


# The classes' texts joined by newlines, cut as one text each.
_PARA_SQL = f"""joined AS (SELECT cls, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM cdocs GROUP BY cls),
pp AS (SELECT cls, unnest(regexp_extract_all(t, {Q.lit('(?:.*?)(?:' + chr(10) + '+|$)')})) AS paragraph FROM joined)"""


@query("x05_distributions", f"""WITH {CDOCS}, {_PARA_SQL},
ps AS (SELECT cls, {_sents('paragraph')} AS sl FROM pp),
ss AS (SELECT cls, unnest(sl) AS s FROM ps),
ww AS (SELECT cls, {_words('s')} AS w FROM ss),
series AS (SELECT cls, 'sentences_per_paragraph' AS series, len(sl) AS value FROM ps
  UNION ALL SELECT cls, 'words_per_sentence', len(w) FROM ww
  UNION ALL SELECT cls, 'syllables_per_word', unnest(list_transform(w, lambda x: len(regexp_extract_all(x, '(?i)[aeiouy]+')))) FROM ww)
SELECT cls, series, value, count(*) AS n FROM series GROUP BY ALL""")
def x05_distributions(spark, sf_dir):
    d = LX.distributions(_cdocs(spark, sf_dir))
    return d.groupBy("cls", "series", F.col("value").cast("long").alias("value")).agg(F.count("*").alias("n"))


@query("x05_distribution_stats", f"""WITH {CDOCS}, {_PARA_SQL},
ps AS (SELECT cls, {_sents('paragraph')} AS sl FROM pp),
ss AS (SELECT cls, unnest(sl) AS s FROM ps),
ww AS (SELECT cls, {_words('s')} AS w FROM ss),
series AS (SELECT cls, 'sentences_per_paragraph' AS series, len(sl) AS value FROM ps
  UNION ALL SELECT cls, 'words_per_sentence', len(w) FROM ww
  UNION ALL SELECT cls, 'syllables_per_word', unnest(list_transform(w, lambda x: len(regexp_extract_all(x, '(?i)[aeiouy]+')))) FROM ww)
SELECT cls, series, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var, count(value) AS n FROM series GROUP BY ALL""")
def x05_distribution_stats(spark, sf_dir):
    d = LX.distributions(_cdocs(spark, sf_dir))
    return round_doubles(d.groupBy("cls", "series").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
                                                        F.count("value").alias("n")))


@query("x06_outlier_paragraphs", f"""WITH {CDOCS}, {_PARA_SQL}
SELECT cls, regexp_replace(paragraph, '\\n+$', '') AS paragraph, len({_sents('paragraph')}) AS n_sentences, count(*) AS n FROM pp
WHERE len({_sents('paragraph')}) < 20 OR len({_sents('paragraph')}) > 160 GROUP BY ALL""")
def x06_outlier_paragraphs(spark, sf_dir):
    out = LX.outlier_paragraphs(_cdocs(spark, sf_dir))
    return out.groupBy("cls", "paragraph", F.col("n_sentences").cast("long").alias("n_sentences")).agg(
        F.count("*").alias("n"))


def _tag_case(w: str) -> str:
    return (f"CASE WHEN regexp_matches({w}, '^\\p{{Nd}}+$') THEN 'NUM' WHEN {w} IN {Q.in_list(LX.LEGACY_PRONOUNS)} THEN 'PRP' "
            f"WHEN suffix({w}, 'ing') AND length({w}) >= 4 THEN 'VBG' WHEN regexp_matches({w}, {Q.lit(LX.RB_RULE)}) THEN 'RB' "
            f"ELSE 'X' END")


_TAGS_SQL = f"""st AS (SELECT doc_id, cls, unnest(sl) AS sentence, unnest(range(len(sl))) AS sent_pos
  FROM (SELECT doc_id, cls, {_sents('text')} AS sl FROM cdocs)),
tg AS (SELECT doc_id, cls, sent_pos, unnest(wl) AS w, unnest(range(len(wl))) AS pos
  FROM (SELECT doc_id, cls, sent_pos, {_words('sentence')} AS wl FROM st)),
tt AS (SELECT *, {_tag_case('w')} AS tag FROM tg)"""

_PPL_SQL = f"""{_TAGS_SQL},
lg AS (SELECT *, lag(tag, 1) OVER (PARTITION BY doc_id, sent_pos ORDER BY pos) AS t1,
                 lag(tag, 2) OVER (PARTITION BY doc_id, sent_pos ORDER BY pos) AS t2 FROM tt),
v AS (SELECT st.doc_id, st.sent_pos, st.cls, count(tt.tag) AS n_tags, count(DISTINCT tt.tag) AS V
      FROM st LEFT JOIN tt USING (doc_id, sent_pos) GROUP BY st.doc_id, st.sent_pos, st.cls),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_pos, t2, t1, tag) AS tri_n,
                count(*) OVER (PARTITION BY doc_id, sent_pos, t2, t1) AS bi_n FROM lg WHERE t2 IS NOT NULL),
lp AS (SELECT g.doc_id, g.sent_pos, avg(log2((tri_n + 1.0) / (bi_n + 1.0 * v.V))) AS mlp
       FROM g JOIN v USING (doc_id, sent_pos) GROUP BY g.doc_id, g.sent_pos),
ppl AS (SELECT v.doc_id, v.sent_pos, v.cls, v.n_tags,
        CASE WHEN n_tags < 3 THEN 0.0 ELSE pow(2.0, -mlp) END AS perplexity FROM v LEFT JOIN lp USING (doc_id, sent_pos))"""


def _ppl(spark, sf_dir):
    return LX.trigram_perplexity(LX.tagged_sentences(_cdocs(spark, sf_dir), keep=["cls"]), keep=["cls"])


@query("x07_tag_trigram_perplexity", f"""WITH {CDOCS}, {_PPL_SQL}
SELECT doc_id, sent_pos, n_tags, round(perplexity, 6) AS perplexity FROM ppl""")
def x07_tag_trigram_perplexity(spark, sf_dir):
    p = _ppl(spark, sf_dir)
    return round_doubles(p.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"),
                                  F.col("n_tags").cast("long").alias("n_tags"), "perplexity"))


@query("r06_perplexity_histogram", f"""WITH {CDOCS}, {_PPL_SQL}
SELECT cls, floor(perplexity + 0.5)::BIGINT AS bin, count(*) AS n FROM ppl GROUP BY ALL""")
def r06_perplexity_histogram(spark, sf_dir):
    return RP.rounded_histogram(_ppl(spark, sf_dir), F.col("perplexity"), ["cls"])


@query("x08_tag_shares", f"""WITH {CDOCS}, {_TAGS_SQL},
c AS (SELECT tag, count(*) FILTER (WHERE cls = 'slop') AS n_slop, count(*) FILTER (WHERE cls = 'human') AS n_human FROM tt GROUP BY tag),
t AS (SELECT count(*) FILTER (WHERE cls = 'slop') AS ts, count(*) FILTER (WHERE cls = 'human') AS th FROM tt)
SELECT tag, round(n_slop::DOUBLE / ts, 6) AS share_slop, round(n_human::DOUBLE / th, 6) AS share_human,
  round(n_slop::DOUBLE / ts - n_human::DOUBLE / th, 6) AS diff FROM c, t""")
def x08_tag_shares(spark, sf_dir):
    tags = LX.sentence_tags(_cdocs(spark, sf_dir), keep=["cls"]).where(F.col("tag").isNotNull())
    return round_doubles(LX.tag_shares(tags))


@query("x09_apostrophe_sentence_rate", f"""WITH {CDOCS}
SELECT cls, sum(len(list_filter({_sents('text')}, lambda x: contains(x, '''') AND contains(x, '’'))))::BIGINT AS n_both,
  (sum(length(text)) + count(*) - 1)::BIGINT AS n_chars,
  round(sum(len(list_filter({_sents('text')}, lambda x: contains(x, '''') AND contains(x, '’'))))::DOUBLE
        / (sum(length(text)) + count(*) - 1), 6) AS rate FROM cdocs GROUP BY cls""")
def x09_apostrophe_sentence_rate(spark, sf_dir):
    out = LX.apostrophe_sentence_rate(_cdocs(spark, sf_dir))
    return round_doubles(out.select("cls", F.col("n_both").cast("long").alias("n_both"),
                                    F.col("n_chars").cast("long").alias("n_chars"), "rate"))


@query("x10_symbol_counts", f"""WITH {CDOCS}
{' UNION ALL '.join(f"SELECT cls, {Q.lit(s)} AS symbol, sum({Q.count_lit('text', s)})::BIGINT AS n FROM cdocs GROUP BY cls" for s in LX.SYMBOLS)}""")
def x10_symbol_counts(spark, sf_dir):
    out = LX.symbol_counts(_cdocs(spark, sf_dir))
    return out.select("cls", "symbol", F.col("n").cast("long").alias("n"))


def _strip_len(x: str) -> str:
    return f"length(regexp_replace({x}, {Q.lit(f'^{P.S}+|{P.S}+$')}, '', 'g'))"


@query("x11_ascending_tricolons", f"""WITH {CDOCS},
ss AS (SELECT doc_id, unnest(sl) AS s, unnest(range(len(sl))) AS sent_pos FROM (SELECT doc_id, {_sents('text')} AS sl FROM cdocs)),
m AS (SELECT doc_id, sent_pos, unnest(regexp_extract_all(s, {Q.lit(LX.TRICOLON)}, 1)) AS x,
      unnest(regexp_extract_all(s, {Q.lit(LX.TRICOLON)}, 2)) AS y, unnest(regexp_extract_all(s, {Q.lit(LX.TRICOLON)}, 3)) AS z FROM ss)
SELECT doc_id, sent_pos, x, y, z FROM m WHERE {_strip_len('y')} >= {_strip_len('x')} AND {_strip_len('z')} > {_strip_len('y')}
  AND {_strip_len('x')} < 60 AND {_strip_len('y')} < 60 AND {_strip_len('z')} < 60""")
def x11_ascending_tricolons(spark, sf_dir):
    out = LX.ascending_tricolons(_cdocs(spark, sf_dir))
    return out.select("doc_id", F.col("sent_pos").cast("long").alias("sent_pos"), "x", "y", "z")


_SEG_SQL = " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS phrase, unnest(range(len(l))) AS match_no, unnest(list_transform(l, lambda x: regexp_extract(x, {rx}, 1))) AS before,
  unnest(list_transform(l, lambda x: regexp_extract(x, {rx}, 2))) AS after
FROM (SELECT doc_id, list_filter(string_split(text, ','), lambda x: regexp_matches(x, {rx})) AS l FROM cdocs)"""
    for k, rx in ((k, Q.lit(f"(?s)^(.+){x}(.+)$")) for k, x in LX.SEGMENT_LITERALS.items()))


@query("x12_phrase_finders", f"""WITH {CDOCS}
SELECT doc_id, 'that_is_not' AS phrase, unnest(range(len(regexp_extract_all(text, 'that is not')))) AS match_no,
  '' AS before, '' AS after FROM cdocs
UNION ALL {_SEG_SQL}""")
def x12_phrase_finders(spark, sf_dir):
    return LX.phrase_matches(_cdocs(spark, sf_dir)).withColumn("match_no", F.col("match_no").cast("long"))


# --- legacy model over 5 equal chunks of every labelled article ------------------

def _legacy_sql_feats(t: str) -> dict[str, str]:
    toks = _words(t)
    f = {
        "contains_dash": Q.count_lit(t, "-"),
        "contains_em_dash": Q.count_lit(t, "—"),
        "contains_double_quote": Q.count_lit(t, '"'),
        "contains_smart_double_quote": Q.count_re(t, "[“”]"),
        "contains_single_quote_pair": f"(CASE WHEN contains({t}, '''') AND contains({t}, '’') THEN 1 ELSE 0 END)",
    }
    for w in LX.LEGACY_WORDS:
        f[f"contains_{w}"] = f"len(list_filter({toks}, lambda x: lower(x) = {Q.lit(w)}))"
    f["number_postags_vbg"] = f"len(list_filter({toks}, lambda x: suffix(x, 'ing') AND length(x) >= 4))"
    f["number_postags_prp"] = f"len(list_filter({toks}, lambda x: x IN {Q.in_list(LX.LEGACY_PRONOUNS)}))"
    f["number_postags_rb"] = f"len(list_filter({toks}, lambda x: regexp_matches(x, {Q.lit(LX.RB_RULE)})))"
    return f


CHUNKS_SQL = f"""{CDOCS},
ck AS (SELECT doc_id, cls, text, length(text) // 5 AS k FROM cdocs WHERE length(text) >= 5),
chunks AS (SELECT doc_id, cls, i AS chunk_no, substr(text, i * k + 1, k) AS chunk FROM (SELECT *, unnest(range(5)) AS i FROM ck))"""


def _chunks(spark, sf_dir):
    return CL.equal_chunks(_cdocs(spark, sf_dir), 5, keep=["cls"])


@query("m16_legacy_features", f"""WITH {CHUNKS_SQL}
SELECT doc_id, chunk_no, {', '.join(f'({e})::BIGINT AS {k}' for k, e in _legacy_sql_feats('chunk').items())} FROM chunks""")
def m16_legacy_features(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    f = LX.legacy_features(F.col("chunk"))
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
                    *[f[k].cast("long").alias(k) for k in LX.LEGACY_FEATURES])


def _legacy_score_sql() -> str:
    f = _legacy_sql_feats("chunk")
    terms = " + ".join(f"({f[k]})::DOUBLE * CAST('{w!r}' AS DOUBLE)" for w, k in zip(LX.LEGACY_WEIGHTS, LX.LEGACY_FEATURES))
    return f"(CAST('{LX.LEGACY_INTERCEPT!r}' AS DOUBLE) + {terms})"


@query("m18_legacy_score", f"""WITH {CHUNKS_SQL}
SELECT doc_id, chunk_no, round({_legacy_score_sql()}, 6) AS score,
  CASE WHEN {_legacy_score_sql()} >= {LX.LEGACY_THRESHOLD} THEN 1 ELSE 0 END AS pred FROM chunks""")
def m18_legacy_score(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    s = LX.legacy_score(LX.legacy_features(F.col("chunk")))
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.round(s, 6).alias("score"),
                    F.when(s >= LX.LEGACY_THRESHOLD, 1).otherwise(0).alias("pred"))


@query("m19_legacy_metrics", f"""WITH {CHUNKS_SQL},
sc AS (SELECT doc_id, chunk_no, CASE WHEN cls = 'slop' THEN 0 ELSE 1 END AS y,
  CASE WHEN {_legacy_score_sql()} >= {LX.LEGACY_THRESHOLD} THEN 1 ELSE 0 END AS pred FROM chunks),
rk AS (SELECT *, row_number() OVER (ORDER BY md5('42' || CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_no AS VARCHAR)), doc_id, chunk_no) AS r,
  count(*) OVER () AS n FROM sc),
te AS (SELECT * FROM rk WHERE r <= ceil(0.2 * n)),
cm AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn,
  avg((y - pred) * (y - pred)) AS mse FROM te)
SELECT tp, fp, fn, tn, round(mse, 6) AS mse,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM cm""")
def m19_legacy_metrics(spark, sf_dir):
    """MSE, F1 and the confusion counts of the fixed legacy model on the 20% test split."""
    c = _chunks(spark, sf_dir)
    s = LX.legacy_score(LX.legacy_features(F.col("chunk")))
    sc = c.select("doc_id", "chunk_no", F.when(F.col("cls") == "slop", 0).otherwise(1).alias("y"),
                  F.when(s >= LX.LEGACY_THRESHOLD, 1).otherwise(0).alias("pred"),
                  F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("chunk_no").cast("string")).alias("key"))
    r = CL.exact_rank(sc, None, CL.hash_order_key(42, "key", sc.columns), "doc_id", "chunk_no")
    te = r.where(F.col("rank_in_group") <= F.ceil(F.col("group_size") * F.lit(0.2)))
    return LX.metrics(te, "y", "pred")
