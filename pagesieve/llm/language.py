"""Language of texts, and of spans of mixed-language texts.

Words are runs of letters. The script of a word narrows the languages to those
that were written in that script in training. Each candidate scores the word by
its letter n-grams (1 to 4, with word edges; naive Bayes over hashed buckets),
and Viterbi with a penalty per switch labels the words of a text, so that a
short stray word does not break a span but a passage in another language does.
The text's language is the one with the most letters in its spans.

Training counts n-grams of a bounded sample of labelled documents: at most about
``PER_LANGUAGE`` different ones per language, taken by a hash of id and text (all of
them if there are fewer), of the ``MAX_LANGUAGES`` languages with the most rows.
These bounds hold at every size; prediction covers every text whole.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .registry import llm_query
from .tables import load

PER_LANGUAGE = 4000       # documents that a language is learned from, about (the bound of the sample)
MAX_LANGUAGES = 256       # languages learned: those of the most rows (the bound of the model's size)
ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
SWITCH = 8.0          # nats a change of language costs
SCRIPT_SHARE = 0.005  # a language is a candidate for a script with at least this share of its letters
UND = "und"
TEXT_BLOCK = 1 << 20  # bytes of text judged or counted at once (or one text)
_U = np.uint64

# First code points of script ranges; a range ends where the next begins. Fixed values (Unicode blocks).
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
           (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
           (0x1780, "khmer"), (0x1800, "mongolian"), (0x1900, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
           (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
           (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"),
           (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
           (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
           (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"),
           (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other")]
NAMES = sorted({s for _, s in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower-case letter (0 if no letter), n-gram code, script."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x32400):
        ch = chr(c)
        if ch.isalpha() or (unicodedata.category(ch)[0] == "M"):
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    script = np.zeros(0x110000, np.uint8)
    for (a, name), (b, _) in zip(SCRIPTS, SCRIPTS[1:] + [(0x110000, "")], strict=True):
        script[a:b] = NAMES.index(name)
    return lower, vec.constants(0x110000, 31), script


class LetterWords:
    """Letter runs of a block of texts: code point places, letters and a hash per word."""

    def __init__(self, texts: list[str]):
        lower, code, script = _tables()
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        width = np.array([len(r) for r in raw], np.int64) // 4
        self.heads = np.cumsum(width) - width
        self.n_docs = len(texts)
        cp = np.frombuffer(b"".join(raw), np.uint32)
        del raw           # what is done with goes at once: a worker shares its memory with the other tasks' ones
        low = lower[cp]
        letter = low > 0
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        heads = self.heads[width > 0]
        begins[heads] = letter[heads]
        at = np.flatnonzero(letter).astype(np.int32)
        self.start = np.flatnonzero(begins)
        where = np.flatnonzero(begins[at])          # each word's first place among the letters
        self.size = np.diff(where, append=len(at))
        self.letters = low[at]
        del low, letter, begins
        self.where = where
        self.script = script[cp[self.start]]
        self.first = np.searchsorted(self.start, np.r_[self.heads, len(cp)])
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        if len(where):
            pos = np.arange(len(at), dtype=np.int32)
            del at, cp
            pos -= np.repeat(where.astype(np.int32), self.size)
            value = code[self.letters]
            value *= vec.powers(int(self.size.max()) + 1)[pos]
            self.hash = vec.mix(np.add.reduceat(value, where))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given words: bucket of each n-gram, the n-gram's order, the word's position in ``words``."""
        _, code, _ = _tables()
        size = self.size[words]
        ends = np.cumsum(size + 1)
        stream = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.uint32)   # words parted by 0
        owner = np.zeros(len(stream), np.int64)
        if len(words):
            place = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(words) + 1), size)
            took = np.arange(int(size.sum())) + np.repeat(self.where[words] - (np.cumsum(size) - size), size)
            stream[place] = self.letters[took]
            owner = np.searchsorted(ends, np.arange(len(stream)), "right").clip(max=len(words) - 1)
        edge = stream == 0
        h = np.zeros(len(stream), np.uint64)
        out = []
        broken = np.zeros(len(stream), bool)      # a separator strictly inside
        for n in ORDERS:
            m = len(stream) - n + 1
            if m <= 0:
                break
            h = h[:m] * _U(0x9E3779B97F4A7C15) + code[stream[n - 1:]]
            if n > 2:
                broken = broken[:m] | edge[n - 2:n - 2 + m]
            ok = ~broken[:m] if n > 1 else ~edge[:m]
            i = np.flatnonzero(ok)
            x = vec.mix(h[i] ^ _U(n))
            # a gram that begins with a separator belongs to the word after it
            out.append(((x >> _U(64 - BUCKET_BITS)).astype(np.int64), np.full(len(i), n, np.int8),
                        owner[i + (edge[i] & (n > 1))]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray        # log share of the training documents, by language
    weight: np.ndarray       # [order, bucket, language] log probability
    scripts: np.ndarray      # [script, language] whether the language is a candidate

    def word_scores(self, w: LetterWords) -> np.ndarray:
        """Log score of each word in each language."""
        out = np.zeros((len(w.start), len(self.languages)), np.float32)
        if not len(out):
            return out
        _, first, slot = np.unique(w.hash, return_index=True, return_inverse=True)
        bucket, order, owner = w.grams(first)
        score = np.zeros((len(first), len(self.languages)), np.float32)
        flat = (order.astype(np.int64) - 1) << BUCKET_BITS | bucket
        for k in range(len(self.languages)):
            score[:, k] = np.bincount(owner, self.weight[:, k][flat], len(first))
        score /= len(ORDERS)
        known = self.scripts[w.script[first]]
        some = known.any(1)
        score[some] = np.where(known[some], score[some], -1e6)
        score[~some] = 0
        out[:] = score[slot]
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; ``first`` parts the words into texts. All texts advance word by word together."""
    n_docs = len(first) - 1
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, head = size[order], first[:-1][order]
    label = np.zeros(len(scores), np.int64)
    if not len(scores):
        return label
    active = np.searchsorted(-size, -np.arange(size[0]), "left")     # texts with more than t words
    back = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    own = np.arange(scores.shape[1])
    best = prior + scores[head[:active[0]]]
    final = np.zeros(n_docs, np.int64)
    for t in range(1, size[0]):
        a = active[t]
        if a < len(best):
            final[a:len(best)] = best[a:].argmax(1)
            best = best[:a]
        top = best.argmax(1)
        jump = best.max(1)[:, None] - switch
        stay = best >= jump
        at = head[:a] + t
        back[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, jump) + scores[at]
    final[:len(best)] = best.argmax(1)
    cur = final
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        at = head[:a] + t
        label[at] = cur[:a]
        if t:
            cur[:a] = back[at, cur[:a]]
    return label


def _count(languages: list[str]):
    """Per task and language: n-gram counts by order and bucket, letters by script."""
    at = {x: i for i, x in enumerate(languages)}

    def run(batches):
        grams = np.zeros((len(languages), len(ORDERS) << BUCKET_BITS), np.int32)
        scripts = np.zeros((len(languages), len(NAMES)), np.int64)
        for b in vec.blocks(batches, limit=TEXT_BLOCK):
            lang = np.array([at[x] for x in b.column("lang").to_pylist()])
            w = LetterWords(vec.strings(b.column("text")).to_pylist())
            if not len(w.start):
                continue
            word_lang = lang[w.doc]
            for k in np.unique(word_lang):
                mine = np.flatnonzero(word_lang == k)
                np.add.at(scripts[k], w.script[mine], w.size[mine])
                _, first, times = np.unique(w.hash[mine], return_index=True, return_counts=True)
                bucket, order, owner = w.grams(mine[first])
                grams[k] += np.bincount((order.astype(np.int64) - 1) << BUCKET_BITS | bucket, times[owner],
                                        grams.shape[1]).astype(np.int32)
        yield pa.record_batch([pa.array(range(len(languages)), pa.int32()),
                               pa.array([g.tobytes() for g in grams], pa.binary()),
                               pa.array([s.tobytes() for s in scripts], pa.binary())], ["k", "grams", "scripts"])
    return run


def _sum(table: pa.Table) -> pa.Table:
    def total(name, kind):
        parts = [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
        return pa.array([np.sum(parts, axis=0, dtype=kind).tobytes()], pa.binary())
    return pa.table({"k": table.column("k").slice(0, 1), "grams": total("grams", np.int32),
                     "scripts": total("scripts", np.int64)})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on rows with a language and a text; without any, a model without languages."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((len(ORDERS) << BUCKET_BITS, 0), np.float32),
                             np.zeros((len(NAMES), 0), bool))
    keep = F.lit(False)
    for x in languages:
        share = min(1.0, per_language / sizes[x])
        keep = keep | ((F.col("lang") == x) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))))
    parts = max(1, min(16, sum(min(n, per_language) for n in sizes.values()) // 250))
    sample = rows.where(keep).dropDuplicates(["lang", "h"])     # rows with one id and text come in once
    got = (sample.select("lang", "text").repartition(parts)
           .mapInArrow(_count(languages), "k int, grams binary, scripts binary")
           .groupBy("k").applyInArrow(_sum, "k int, grams binary, scripts binary").collect())
    counts = np.zeros((len(languages), len(ORDERS) << BUCKET_BITS))
    scripts = np.zeros((len(languages), len(NAMES)))
    for r in got:
        counts[r["k"]] = np.frombuffer(r["grams"], np.int32)
        scripts[r["k"]] = np.frombuffer(r["scripts"], np.int64)
    per = counts.reshape(len(languages), len(ORDERS), -1) + 0.5
    weight = np.log(per / per.sum(2, keepdims=True)).reshape(len(languages), -1).T
    n = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, np.log(n / n.sum()), np.ascontiguousarray(weight, np.float32),
                         (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)).T & (scripts.T > 0))


def _predict(model_of):
    def run(batches):
        model: LanguageModel = model_of.value
        names = np.array([*model.languages, UND], object)
        for b in vec.blocks(batches, limit=TEXT_BLOCK):
            w = LetterWords(vec.strings(b.column("text")).to_pylist())
            n, k = w.n_docs, len(model.languages)
            pred, share = np.full(n, k), np.zeros(n)
            label = np.zeros(0, np.int64)
            if k and len(w.start):
                label = viterbi(model.word_scores(w), w.first, model.prior)
                mass = np.zeros((n, k))
                np.add.at(mass, (w.doc, label), w.size)
                total = mass.sum(1)
                known = model.scripts[w.script, label]
                sure = np.bincount(w.doc, w.size * known * (label == mass.argmax(1)[w.doc]), n)
                has = total > 0
                pred[has] = mass[has].argmax(1)
                share[has] = sure[has] / total[has]
            new = np.r_[True, (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])] if len(label) else label > 0
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(label)] - 1 if len(head) else head
            base = w.heads[w.doc[head]] if len(head) else head
            spans = pa.StructArray.from_arrays(
                [pa.array(names[label[head]] if len(head) else [], pa.string()),
                 pa.array(w.start[head] - base if len(head) else [], pa.int64()),
                 pa.array(w.start[tail] + w.size[tail] - base if len(head) else [], pa.int64())],
                ["lang", "start", "end"])
            per = np.bincount(w.doc[head], minlength=n) if len(head) else np.zeros(n, np.int64)
            offs = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
            yield pa.record_batch([b.column("id"), pa.array(names[pred], pa.string()), pa.array(share),
                                   pa.ListArray.from_arrays(offs, spans)], ["id", "lang_pred", "score", "spans"])
    return run


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``lang_pred``, ``score`` and ``spans`` of (lang, start, end) in code points.

    ``score`` is the share of letters that lie in spans of the predicted language
    and in a script that it was seen in. A null text, a text without letters, and
    any text under a model without languages is ``und`` with score 0 and no span.
    Ties go to the first language by name. Repeated rows each get a row, null ids
    stay null, an empty table gives no row; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)   # languages x buckets, whatever the input's size
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double, "
                                          "spans array<struct<lang:string,start:bigint,end:bigint>>")
            .withColumnRenamed("id", id_col))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


@llm_query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from two thirds of them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


MIN_SCORE = 0.25


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows stay if their text has a language that covers at least a quarter of its letters.

    Null, empty and letterless texts go, as do all rows where no row has a
    language to learn from; repeated rows stay or go alike; long texts are judged
    whole; ids and further columns, whatever their names, come back as they are;
    an empty table stays empty.
    """
    model = train(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        score = _predict(shared)
        for b in vec.blocks(batches, limit=TEXT_BLOCK):
            slim = pa.record_batch([pa.nulls(b.num_rows, pa.int64()), b.column("text")], ["id", "text"])
            got = pa.Table.from_batches(score([slim]))
            keep = [p != UND and s >= MIN_SCORE
                    for p, s in zip(got["lang_pred"].to_pylist(), got["score"].to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
