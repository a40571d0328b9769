"""Corpus comparison rules against Python's ``re`` on the joined class texts."""
import math
import re

from pyspark.sql import functions as F

from pagesieve.operators import lexical as LX

TEXTS = [
    (1, "", "slop"), (2, "\n\nOne a. Two b!\nThree", "slop"), (3, "\n", "slop"), (4, "Tail one.\n\n", "slop"),
    (5, "We know that is not it, but I will go, and She said I will I will stay, x is not about y is not about z", "slop"),
    (6, "I will start. I will ", "human"), (7, "no newline here that is not that is not", "human"),
    (8, "a b a b a, ab a b", "human"), (9, "über ab über, überab", "human"),
]
W = r"[^\W]"


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, cls string")


def joined(cls):
    return "\n".join(t for _, t, c in TEXTS if c == cls)


def paragraphs(text):
    """Lines by hand: a line with the newlines after it is a paragraph, and an empty one ends the text."""
    out, i = [], 0
    while i < len(text):
        line = i
        while i < len(text) and text[i] != "\n":
            i += 1
        end = i
        while i < len(text) and text[i] == "\n":
            i += 1
        out.append(text[line:end])
        if i == end:        # the text ended without a newline
            break
    return out + [""]


def sentences(line):
    """By hand: up to a stop that white space or the end follows; the white space is left out, a rest is dropped."""
    out, begin, i = [], 0, 0
    while i < len(line):
        if line[i] in ".!?" and (i + 1 == len(line) or line[i + 1].isspace()):
            out.append(line[begin:i + 1])
            i += 1
            while i < len(line) and line[i].isspace():
                i += 1
            begin = i
        else:
            i += 1
    return out


def test_paragraphs_of_the_joined_class(spark):
    got = LX.paragraph_sentences(docs(spark)).collect()
    for cls in ("slop", "human"):
        want = sorted((p, sentences(p)) for p in paragraphs(joined(cls)))
        assert sorted((r.paragraph, list(r.sentences)) for r in got if r.cls == cls) == want


def test_outliers_and_series(spark):
    got = LX.outlier_paragraphs(docs(spark), lo=1, hi=1).collect()
    want = sorted((c, p, len(sentences(p))) for c in ("slop", "human") for p in paragraphs(joined(c))
                  if len(sentences(p)) != 1)
    assert sorted(tuple(r) for r in got) == want
    series = LX.distributions(docs(spark)).where("series = 'sentences_per_paragraph'").groupBy("cls").agg(
        F.sort_array(F.collect_list("value")).alias("v")).collect()
    assert {r.cls: list(r.v) for r in series} == {c: sorted(len(sentences(p)) for p in paragraphs(joined(c)))
                                                  for c in ("slop", "human")}


def test_terms_of_one_and_more_words(spark):
    terms = ["a", "a b a", "ab", "über ab", "b, ab", "I will", "missing"]
    wl = spark.createDataFrame([(t,) for t in terms], "word string")
    got = {(r.word, r.cls): r.n for r in LX.word_list_hits(docs(spark), wl).collect()}
    want = {}
    for _, text, cls in TEXTS:
        for t in terms:
            n = len(re.findall(rf"\b{re.escape(t)}\b", text))
            if n:
                want[t, cls] = want.get((t, cls), 0) + n
    assert got == want


def test_phrase_finders_return_their_groups(spark):
    rules = {"i_will": r"([^,]+)I will ([^,]+)", "is_not_about": r"([^,]+) is not about ([^,]+)"}
    got = sorted(tuple(r) for r in LX.phrase_matches(docs(spark)).collect())
    want = []
    for d, text, _ in TEXTS:
        want += [(d, "that_is_not", i, "", "") for i, _ in enumerate(re.findall("that is not", text))]
        want += [(d, k, i, a, b) for k, rx in rules.items() for i, (a, b) in enumerate(re.findall(rx, text))]
    assert got == sorted(want)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_series_take_each_text_apart_once(spark):
    df = LX.distributions(docs(spark))
    want = []
    for c in ("slop", "human"):
        for p in paragraphs(joined(c)):
            want.append((c, "sentences_per_paragraph", len(sentences(p))))
            for s in sentences(p):
                words = re.findall(r"\w+", s)
                want.append((c, "words_per_sentence", len(words)))
                want += [(c, "syllables_per_word", len(re.findall("[aeiouyAEIOUY]+", w))) for w in words]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert len(re.findall("LogicalRDD|LocalRelation", plan_of(df))) == 2        # the texts, and each class's first


def test_perplexity_is_counted_inside_a_sentence_row(spark):
    rows = [(1, "He is 12 running quickly he ran, they ran. Yes!", "a"), (2, "!!! it IS? ok 1 2 3 4 5 6.", "b"),
            (3, "We are. We are here now singing it.", "a"), (3, "We are. We are here now singing it.", "b"),
            (None, "It is what it is.", "a"), (4, "I he it 1 . ", "b"), (5, "no mark", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    got = LX.trigram_perplexity(LX.tagged_sentences(df, keep=["cls"]), keep=["cls"])
    assert "Window" not in plan_of(got) and "Join" not in plan_of(got)

    def tag(w):
        return ("NUM" if w.isdecimal() else "PRP" if w in LX.LEGACY_PRONOUNS else "VBG" if w.endswith("ing") and len(w) > 3
                else "RB" if w.endswith("ly") or w in LX.LEGACY_ADVERBS else "X")
    parts = {}
    for d, text, cls in rows:
        for i, s in enumerate(sentences(text)):
            parts.setdefault((d, i), {}).setdefault(cls, []).append([tag(w) for w in re.findall(r"\w+", s)])
    want = []
    for (d, i), by in parts.items():
        placed = [(k, t) for lists in by.values() for tags in lists for k, t in enumerate(tags)]
        seq = [t for _, t in sorted(placed)]
        tris = list(zip(seq, seq[1:], seq[2:]))
        bi = [t[:2] for t in tris]
        flat = {c: [t for tags in lists for t in tags] for c, lists in by.items()}
        logs = [math.log2((tris.count(t) + 1) / (bi.count(t[:2]) + len(set(f)))) for t in tris for f in flat.values()]
        for c, f in flat.items():
            value = 0.0 if len(f) < 3 else None if d is None else 2 ** (-sum(logs) / len(logs))
            want.append((str(d), i, c, len(f), None if value is None else round(value, 9)))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.sent_pos, r.cls, r.n_tags, None if r.perplexity is None else
                                                 round(r.perplexity, 9))) for r in got.collect())
