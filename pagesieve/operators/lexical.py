"""Corpus comparison between two classes (X1..X12) and the legacy linear
model features (M16, M18).

Class texts stay as rows: every statistic is computed per document (or per
sentence) and summed per class with conditional aggregation, never by
joining a class into one string. Sentence-level sequence statistics
(tag trigrams) are counted inside a sentence's row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import preprocess as PP
from ..functions import text as T

# FIXED VALUES: legacy rule lists.
LEGACY_PRONOUNS = ["I", "me", "you", "he", "she", "it", "we", "they", "him", "her", "us", "them",
                   "myself", "yourself", "herself", "himself", "itself", "ourselves", "themselves"]
LEGACY_ADVERBS = ["here", "there", "now", "then", "soon", "always", "never", "often", "sometimes",
                  "everywhere", "nowhere", "somewhere", "very", "too", "quite", "almost", "rather",
                  "fast", "hard", "late", "near", "far", "straight", "well"]
LEGACY_WORDS = ["seamless", "elevate", "pivotal", "align", "leverage"]
LEGACY_FEATURES = [
    "contains_dash", "contains_em_dash", "contains_double_quote", "contains_smart_double_quote",
    "contains_single_quote_pair", "contains_seamless", "contains_elevate", "contains_pivotal",
    "contains_align", "contains_leverage", "number_postags_vbg", "number_postags_prp",
    "number_postags_rb",
]
LEGACY_WEIGHTS = [0.003224097730849752, 0.041174883598401546, -0.08363519093665123,
                  0.007118889863322623, -0.24675198467522655, -0.20711948433976712,
                  -0.01923992845820089, -0.06415759681531612, 0.057993917413981785,
                  0.023981672786734798, -0.012971271988087783, 0.005762784684722451,
                  0.019531599440375018]
LEGACY_INTERCEPT = 0.4748231644400827
LEGACY_THRESHOLD = 0.5
SYMBOLS = ["-", "—", '"', "“", ","]
TAGS = ["NUM", "PRP", "VBG", "RB", "X"]

RB_RULE = rf"^(?:{P.W}+ly|" + "|".join(LEGACY_ADVERBS) + ")$"


def class_col(label: Column) -> Column:
    """Legacy class name from the label (1 = Slop)."""
    return F.when(label == 1, F.lit("slop")).otherwise(F.lit("human"))


# --- X1, X2 ------------------------------------------------------------------

def blank_split_words(text: Column) -> Column:
    """``str.split()``: runs of non-whitespace."""
    return F.filter(F.split(T.py_strip(text), f"{P.S}+", -1), lambda w: w != "")


def word_count_diff(docs: DataFrame, text: str = "text", cls: str = "cls") -> DataFrame:
    """Per word, counts in each class and max(slop - human, 0), words of the slop class."""
    w = docs.select(cls, F.explode(blank_split_words(F.col(text))).alias("word"))
    c = w.groupBy("word").agg(F.count_if(F.col(cls) == "slop").alias("n_slop"),
                              F.count_if(F.col(cls) == "human").alias("n_human"))
    return c.where(F.col("n_slop") > 0).withColumn(
        "diff", F.greatest(F.col("n_slop") - F.col("n_human"), F.lit(0)))


def sentence_words(text: Column) -> Column:
    """Words of the legacy sentences of lower-cased text, flattened."""
    sents = PP.legacy_sentences(F.lower(text))
    return F.flatten(F.transform(sents, lambda s: PP.legacy_words(s)))


def vocab_compare(docs: DataFrame, text: str = "text", cls: str = "cls") -> DataFrame:
    """Words longer than 3 whose counts differ; ``"a - b = d"`` text; one grouped pass."""
    w = docs.select(cls, F.explode(sentence_words(F.col(text))).alias("word"))
    c = w.groupBy("word").agg(F.count_if(F.col(cls) == "slop").alias("n_slop"),
                              F.count_if(F.col(cls) == "human").alias("n_human"))
    d = F.col("n_slop") - F.col("n_human")
    return c.where((d != 0) & (F.length("word") > 3)).select(
        "word", "n_slop", "n_human", d.alias("diff"),
        F.format_string("%d - %d = %d", F.col("n_slop"), F.col("n_human"), d).alias("text"))


# --- X3, X4 ------------------------------------------------------------------

PIECE = f"{P.W}+|{P.NOT_W}+"


def word_list_from(texts: DataFrame, text: str = "text") -> DataFrame:
    """A word list out of a text table: all its case-kept words, and its two-word terms (one blank between)."""
    words = T.extract_all(F.col(text), P.WORD)
    terms = T.extract_all(F.col(text), f"{P.W}+ {P.W}+")
    return texts.select(F.explode(F.concat(words, terms)).alias("word")).distinct()


def word_list_hits(docs: DataFrame, wordlist: DataFrame, text: str = "text", cls: str = "cls",
                   id_col: str = "doc_id") -> DataFrame:
    """Whole-word, case-sensitive hits of each listed term per class (> 0).

    A text is its maximal runs of word and other characters; a term that begins
    and ends with a word character is found where its own runs equal as many runs
    of the text. Hits of one term in one text do not overlap (the leftmost counts).
    """
    sizes = sorted(r[0] for r in wordlist.select(F.size(T.extract_all(F.col("word"), PIECE))).distinct().collect())
    if not sizes:
        return docs.select(F.col(text).alias("word"), cls, F.lit(0).cast("long").alias("n")).limit(0)
    runs = docs.select(id_col, cls, T.extract_all(F.col(text), PIECE).alias("_p"))
    n = F.size("_p")
    windows = [F.when(n >= m, F.transform(F.sequence(F.lit(1), n - m + 1), _window(m)))
               .otherwise(F.array().cast("array<struct<pos:int,size:int,word:string>>")) for m in sizes]
    hits = (runs.select(id_col, cls, F.inline(F.flatten(F.array(*windows))))
            .join(wordlist.select("word").distinct(), "word"))
    one = hits.where("size = 1").groupBy("word", cls).agg(F.count("*").alias("n"))
    many = hits.where("size > 1").groupBy("word", cls, id_col).agg(
        F.sort_array(F.collect_list("pos")).alias("at"), F.first("size").alias("size"))
    count = F.aggregate("at", F.struct(F.lit(0).alias("next"), F.lit(0).cast("long").alias("n")),
                        lambda acc, x: F.when(x >= acc["next"], F.struct((x + F.col("size")).alias("next"),
                                                                         (acc["n"] + 1).alias("n"))).otherwise(acc))
    many = many.select("word", cls, count["n"].alias("n")).groupBy("word", cls).agg(F.sum("n").alias("n"))
    return one.unionByName(many)


def _window(m: int):
    return lambda i: F.struct(i.alias("pos"), F.lit(m).alias("size"),
                              F.array_join(F.slice("_p", i, m), "").alias("word"))


def word_list_diff(hits: DataFrame, cls: str = "cls") -> DataFrame:
    """Listed words more frequent in the slop class, with the positive difference."""
    p = hits.groupBy("word").agg(F.sum(F.when(F.col(cls) == "slop", F.col("n")).otherwise(0)).alias("n_slop"),
                                 F.sum(F.when(F.col(cls) == "human", F.col("n")).otherwise(0)).alias("n_human"))
    return p.select("word", (F.col("n_slop") - F.col("n_human")).alias("diff")).where(F.col("diff") > 0)


# --- X5, X6 ------------------------------------------------------------------

def paragraph_sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                        cls: str = "cls") -> DataFrame:
    """``(cls, paragraph, sentences)`` of each class's texts joined by newlines in id order.

    The class text is never built: newlines before a text end the paragraph before
    it, so a text gives its own paragraphs without leading newlines. The joined
    text's end gives one empty paragraph per class, and so does its beginning if
    the first text begins with a newline (or is empty and others follow).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pieces = PP.legacy_paragraphs(F.regexp_replace(t, "^\\n+", ""))
    own = docs.select(cls, F.explode(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("paragraph"))
    first = docs.groupBy(cls).agg(F.min_by(t, F.col(id_col)).alias("t"), F.count("*").alias("n"))
    opens = F.col("t").startswith("\n") | ((F.col("t") == "") & (F.col("n") > 1))
    empty = first.select(cls, F.explode(F.array_repeat(F.lit(""), F.when(opens, 2).otherwise(1))).alias("paragraph"))
    return (own.select(cls, F.regexp_replace("paragraph", "\\n+$", "").alias("paragraph")).unionByName(empty)
            .withColumn("sentences", PP.line_sentences(F.col("paragraph"))))


def distributions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cls: str = "cls") -> DataFrame:
    """The three legacy series as long rows ``(cls, series, value)``.

    Each text is taken apart once. Vowel runs (a word's syllables) become one letter
    first, which leaves paragraphs, sentences and words as they are; a word's
    syllables are then a count of that letter.
    """
    runs = docs.withColumn(text, F.regexp_replace(text, "[aeiouyAEIOUY]+", "a"))

    def one(series, value):
        return F.struct(F.lit(series).alias("series"), value.cast("int").alias("value"))

    def of_sentence(words):
        return F.concat(F.array(one("words_per_sentence", F.size(words))), F.transform(words, lambda w: one(
            "syllables_per_word", F.length(w) - F.length(F.replace(w, F.lit("a"), F.lit(""))))))
    words = F.transform("sentences", PP.legacy_words)
    values = F.concat(F.array(one("sentences_per_paragraph", F.size("sentences"))),
                      F.flatten(F.transform(words, of_sentence)))
    return paragraph_sentences(runs, id_col, text, cls).select(cls, F.inline(values))


def outlier_paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cls: str = "cls",
                       lo: int = 20, hi: int = 160) -> DataFrame:
    """Paragraphs (without their newlines) whose sentence count is below ``lo`` or above ``hi``."""
    n = F.size("sentences")
    return paragraph_sentences(docs, id_col, text, cls).where((n < lo) | (n > hi)).select(
        cls, "paragraph", n.alias("n_sentences"))


# --- X7, X8 ------------------------------------------------------------------

def rule_tag(tok: Column) -> Column:
    """A rule tagger from the legacy proxies: number, pronoun, -ing, adverb, other."""
    return (F.when(tok.rlike(r"^\p{Nd}+$"), F.lit("NUM"))
            .when(tok.isin(LEGACY_PRONOUNS), F.lit("PRP"))
            .when(tok.endswith("ing") & (F.length(tok) >= 4), F.lit("VBG"))
            .when(tok.rlike(RB_RULE), F.lit("RB"))
            .otherwise(F.lit("X")))


def sentence_tags(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """``(id, *keep, sent_pos, pos, tag)`` for every word of every legacy sentence."""
    keep = keep or []
    s = docs.select(id_col, *keep, F.posexplode(PP.legacy_sentences(F.col(text))).alias("sent_pos", "sentence"))
    return s.select(id_col, *keep, "sent_pos",
                    F.posexplode_outer(F.transform(PP.legacy_words(F.col("sentence")), rule_tag))
                    .alias("pos", "tag"))


def tagged_sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                     keep: list[str] | None = None) -> DataFrame:
    """``(id, *keep, sent_pos, tags)``: every legacy sentence's tags as a string of their first letters."""
    keep = keep or []
    s = docs.select(id_col, *keep, F.posexplode(PP.legacy_sentences(F.col(text))).alias("sent_pos", "sentence"))
    codes = F.transform(PP.legacy_words(F.col("sentence")), lambda w: F.substring(rule_tag(w), 1, 1))
    return s.select(id_col, *keep, "sent_pos", F.array_join(codes, "").alias("tags"))


def _letters(s: Column) -> Column:
    return T.extract_all(s, ".")


def trigram_perplexity(sents: DataFrame, id_col: str = "doc_id", smoothing: float = 1.0,
                       keep: list[str] | None = None) -> DataFrame:
    """Per sentence 2^(-mean log2 p), p = (tri + s) / (bi + s * V); < 3 tags -> 0.

    ``sents`` is :func:`tagged_sentences`. A sentence is one row, counted inside the row.
    Sentences of one (id, sent_pos) are counted together, their words by place; V and
    the number of tags are those of the rows with equal ``keep``. A null id has no mean.
    """
    keep = keep or []
    key = [id_col, "sent_pos"]
    own = F.struct(*keep) if keep else F.struct(F.lit(0).alias("_all"))
    x = sents.groupBy(*key).agg(F.collect_list(F.struct(own.alias("own"), "tags")).alias("parts"))
    placed = F.flatten(F.transform("parts", lambda p: F.transform(
        _letters(p["tags"]), lambda c, i: F.struct(i.alias("pos"), c.alias("tag")))))
    seq = F.when(F.size("parts") == 1, F.col("parts")[0]["tags"]).otherwise(
        F.array_join(F.transform(F.array_sort(placed), lambda t: t["tag"]), ""))
    groups = F.transform(F.array_distinct(F.transform("parts", lambda p: p["own"])), lambda o: F.struct(
        o.alias("own"), F.array_join(F.transform(F.filter("parts", lambda p: p["own"].eqNullSafe(o)),
                                                 lambda p: p["tags"]), "").alias("tags")))
    x = x.select(*key, seq.alias("seq"), groups.alias("groups"))
    x = x.select(*key, F.transform("groups", lambda g: F.struct(
        g["own"].alias("own"), F.length(g["tags"]).cast("long").alias("n_tags"),
        F.size(F.array_distinct(_letters(g["tags"]))).alias("V"))).alias("groups"),
        F.when(F.length("seq") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq") - 2, F.lit(1))),
                                                 lambda i: F.substring("seq", i, 3)))
        .otherwise(F.array().cast("array<string>")).alias("tris"))
    x = x.withColumn("counts", F.transform(F.array_distinct("tris"), lambda k: F.struct(
        k.alias("k"), F.size(F.filter("tris", lambda t: t == k)).alias("n"))))

    def prefix_count(c):
        same = F.filter("counts", lambda d: F.substring(d["k"], 1, 2) == F.substring(c["k"], 1, 2))
        return F.aggregate(same, F.lit(0), lambda acc, d: acc + d["n"])

    x = x.withColumn("counts", F.transform("counts", lambda c: F.struct(
        c["k"].alias("k"), c["n"].alias("tri_n"), prefix_count(c).alias("bi_n"))))
    x = x.withColumn("lps", F.map_from_entries(F.transform("counts", lambda c: F.struct(
        c["k"], F.aggregate("groups", F.lit(0.0), lambda acc, g: acc + F.log2(
            (c["tri_n"] + smoothing) / (c["bi_n"] + smoothing * g["V"])))))))
    # asking for the map's size keeps it a column of its own: inside the lambda it would be built for every word
    mean = F.when(F.col(id_col).isNotNull() & (F.size("lps") > 0), F.aggregate(
        "tris", F.lit(0.0), lambda acc, t: acc + F.col("lps")[t]) / (F.size("tris") * F.size("groups")))
    x = x.select(*key, "groups", mean.alias("mlp")).select(*key, "mlp", F.explode("groups").alias("g"))
    return x.select(*key, *[F.col(f"g.own.{c}").alias(c) for c in keep], F.col("g.n_tags").alias("n_tags"),
                    F.when(F.col("g.n_tags") < 3, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -F.col("mlp")))
                    .alias("perplexity"))


def tag_shares(tags: DataFrame, cls: str = "cls") -> DataFrame:
    """Share of each tag among the class's tokens and the slop - human difference."""
    c = tags.groupBy("tag").agg(F.count_if(F.col(cls) == "slop").alias("n_slop"),
                                F.count_if(F.col(cls) == "human").alias("n_human"))
    tot = tags.groupBy().agg(F.count_if(F.col(cls) == "slop").alias("tot_slop"),
                             F.count_if(F.col(cls) == "human").alias("tot_human"))
    r = tot.first()
    ts, th = (r["tot_slop"], r["tot_human"]) if r else (0, 0)
    s_slop = F.col("n_slop") / F.lit(ts) if ts else F.lit(0.0)
    s_hum = F.col("n_human") / F.lit(th) if th else F.lit(0.0)
    return c.select("tag", s_slop.alias("share_slop"), s_hum.alias("share_human"),
                    (s_slop - s_hum).alias("diff"))


# --- X9..X12 -----------------------------------------------------------------

def apostrophe_sentence_rate(docs: DataFrame, text: str = "text", cls: str = "cls") -> DataFrame:
    """Sentences holding both ' and ’, over the class's joined text length."""
    s = docs.select(cls, F.length(text).alias("len"),
                    F.size(F.filter(PP.legacy_sentences(F.col(text)),
                                    lambda x: x.contains("'") & x.contains("’"))).alias("both"))
    g = s.groupBy(cls).agg(F.sum("both").alias("n_both"), (F.sum("len") + F.count("*") - 1).alias("n_chars"))
    return g.select(cls, "n_both", "n_chars", (F.col("n_both") / F.col("n_chars")).alias("rate"))


def symbol_counts(docs: DataFrame, text: str = "text", cls: str = "cls") -> DataFrame:
    """Occurrences of five symbols per class."""
    cols = [F.sum(T.count_literal(F.col(text), s)).alias(f"s{i}") for i, s in enumerate(SYMBOLS)]
    g = docs.groupBy(cls).agg(*cols)
    stack = F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(f"s{i}").alias("n")) for i, s in enumerate(SYMBOLS)])
    return g.select(cls, F.inline(stack))


TRICOLON = r"([^,]+), ([^,]+) and ([^,]+)"


def ascending_tricolons(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                        keep: list[str] | None = None) -> DataFrame:
    """X11: "x, y and z" with len y >= len x, len z > len y, each < 60 after stripping."""
    keep = keep or []
    s = docs.select(id_col, *keep, F.posexplode(PP.legacy_sentences(F.col(text))).alias("sent_pos", "s"))
    # a match needs both literals: only such sentences meet the (backtracking) regex
    s = s.where(F.col("s").contains(", ") & F.col("s").contains(" and "))
    parts = F.arrays_zip(T.extract_all(F.col("s"), TRICOLON, 1).alias("x"),
                         T.extract_all(F.col("s"), TRICOLON, 2).alias("y"),
                         T.extract_all(F.col("s"), TRICOLON, 3).alias("z"))
    m = s.select(id_col, *keep, "sent_pos", F.inline(parts))
    lx, ly, lz = (F.length(T.py_strip(F.col(c))) for c in ("x", "y", "z"))
    return m.where((ly >= lx) & (lz > ly) & (lx < 60) & (ly < 60) & (lz < 60))


PHRASES = {
    "that_is_not": "that is not",
    "i_will": r"([^,]+)I will ([^,]+)",
    "is_not_about": r"([^,]+) is not about ([^,]+)",
}
# The two "([^,]+)<literal>([^,]+)" finders cannot cross a comma and a match
# runs to the end of its comma-free segment, so their match count equals the
# number of segments holding the literal with a character on each side. The
# segment form is linear; the regex form backtracks quadratically.
SEGMENT_LITERALS = {"i_will": "I will ", "is_not_about": " is not about "}


def phrase_matches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, phrase, match_no, before, after)`` of the three phrase finders; the plain one has no groups."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.transform(T.extract_all(t, PHRASES["that_is_not"]), lambda x: F.struct(
        F.lit("that_is_not").alias("phrase"), F.lit("").alias("before"), F.lit("").alias("after")))
    found = [F.transform(plain, lambda x, i: F.struct(i.alias("match_no"), x.alias("m")))]
    for key, lit in SEGMENT_LITERALS.items():
        rx = f"(?s)^(.+){re.escape(lit)}(.+)$"
        segments = F.filter(F.split(t, ",", -1), _holds(rx))
        found.append(F.transform(segments, _groups(key, rx)))
    return docs.select(id_col, F.explode(F.flatten(F.array(*found))).alias("f")).select(
        id_col, "f.m.phrase", "f.match_no", "f.m.before", "f.m.after")


def _holds(rx: str):
    return lambda g: g.rlike(rx)


def _groups(key: str, rx: str):
    return lambda g, i: F.struct(i.alias("match_no"), F.struct(
        F.lit(key).alias("phrase"), F.regexp_extract(g, rx, 1).alias("before"),
        F.regexp_extract(g, rx, 2).alias("after")).alias("m"))


# --- M16, M18 ----------------------------------------------------------------

def legacy_features(text: Column) -> dict[str, Column]:
    """The 13 legacy counts/flags of one text (token rules for the \\b words)."""
    toks = T.extract_all(text, P.WORD)
    low = F.transform(toks, lambda t: F.lower(t))
    feats = {
        "contains_dash": T.count_literal(text, "-"),
        "contains_em_dash": T.count_literal(text, "—"),
        "contains_double_quote": T.count_literal(text, '"'),
        "contains_smart_double_quote": T.count_matches(text, "[“”]"),
        "contains_single_quote_pair": F.when(text.contains("'") & text.contains("’"), 1).otherwise(0).cast("long"),
    }
    for w in LEGACY_WORDS:
        feats[f"contains_{w}"] = F.size(F.filter(low, _eq(w))).cast("long")
    feats["number_postags_vbg"] = F.size(F.filter(toks, lambda t: t.endswith("ing") & (F.length(t) >= 4))).cast("long")
    feats["number_postags_prp"] = F.size(F.filter(toks, lambda t: t.isin(LEGACY_PRONOUNS))).cast("long")
    feats["number_postags_rb"] = F.size(F.filter(toks, lambda t: t.rlike(RB_RULE))).cast("long")
    return feats


def _eq(w: str):
    return lambda t: t == F.lit(w)


def legacy_score(feats: dict[str, Column]) -> Column:
    """Intercept + sum(w * feature) with the fixed legacy weights."""
    acc = F.lit(LEGACY_INTERCEPT)
    for w, k in zip(LEGACY_WEIGHTS, LEGACY_FEATURES):
        acc = acc + feats[k].cast("double") * F.lit(w)
    return acc


def metrics(df, y: str, pred: str):
    """Confusion counts, MSE and F1 in one aggregation."""
    yc, pc = F.col(y), F.col(pred)
    m = df.agg(F.count_if((yc == 1) & (pc == 1)).alias("tp"), F.count_if((yc == 0) & (pc == 1)).alias("fp"),
               F.count_if((yc == 1) & (pc == 0)).alias("fn"), F.count_if((yc == 0) & (pc == 0)).alias("tn"),
               F.avg((yc - pc) * (yc - pc)).alias("mse"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return m.select(F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    F.col("fn").cast("long").alias("fn"), F.col("tn").cast("long").alias("tn"),
                    F.round("mse", 6).alias("mse"),
                    F.round(F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / den), 6).alias("f1"))
