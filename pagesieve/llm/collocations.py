"""Phrase collocations by dynamic itemset counting: lengths are interleaved in cyclic scans over shards of the texts.

The texts are dealt into ``SHARDS`` shards and scanned shard after shard, round
and round. Words are counted from the first step on. As soon as the running counts
of both subphrases of a longer phrase (all but its last word, all but its first)
have reached the threshold, the phrase is counted too, from the next step on and
for one full cycle; then its count is whole. So in one scan some phrases of two,
three and four words are counted side by side, and a length need not wait until
the one before is complete. A phrase with enough occurrences has subphrases with
enough, so each is activated at some step.

The step at which phrases reached the threshold is kept in one byte per hash slot
for each length (at most ``1 << SLOT_BITS`` bytes a length, broadcast). A slot's
step is set once and never changes, so phrases that share a slot are counted over
one full cycle as well; they may be counted in vain, never wrongly. Tasks sort
and count the active phrases of their texts and deal them, as word hashes in a
dictionary of the block, by the phrase's hash. A shard of phrases merges these with its
counts so far; phrases whose cycle is over leave it, kept if they reached the
threshold. A frequent word, line or text is one entry a task, never one group.

Scores, dropped phrases and ranks are joins on the kept phrases (whole counts, all of
them at or above the threshold).
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vec
from .registry import llm_query
from .runs import Runs, gap_table, string_array
from .tables import load, shared_path, write_table

LEAST = 30                # occurrences of a candidate
LONGEST = 4
TOP = 2000
SHARDS = 4                # scans of one cycle
RUN_BYTES = 16 << 20      # text whose phrases a task sorts at once
DEAL_BYTES = 48 << 20     # text per part of the phrases
SLOT_BITS = 25
GAP = gap_table([(9, 13), (32, 32), *((ord(c), ord(c)) for c in ".,;:!?")])
BREAK = gap_table([(10, 13), *((ord(c), ord(c)) for c in ".,;:!?")])
_U = np.uint64
_MUL = _U(0x9FB21C651E98DF25)
ROWS = "kind string, size int, part long, data binary"


# ---------------------------------------------------------------- phrases as arrays

def fold(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase: its words' hashes (each with the language in it), as columns."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = vec.mix(h * _MUL + c)
    return h


def lang_hash(langs: list) -> np.ndarray:
    out = {x: int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in set(langs)}
    return np.array([out[x] for x in langs], np.uint64)


def in_language(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return vec.mix(word * _MUL + lang)


def _planes(a: np.ndarray) -> np.ndarray:
    """Numbers as planes of their bytes, as few as they need (differences may be negative: folded)."""
    a = (a.astype(np.int64) << 1) ^ (a.astype(np.int64) >> 63)
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :planes.shape[0]] = planes.T
    a = full.reshape(-1).view("<i8")
    return (a >> 1) ^ -(a & 1)


def pack(words: list[np.ndarray], numbers: list[np.ndarray], texts: list[bytes] | None = None) -> bytes:
    """Rows of word hashes (as a dictionary and planes of its places, sorted) and numbers.

    Single words are given as their languages' hashes and their bytes instead.
    """
    values, at = np.unique(np.concatenate(words), return_inverse=True)
    at = at.reshape(len(words), -1)
    order = np.lexsort(at[::-1]) if texts is None else np.array(
        sorted(range(len(texts)), key=lambda i: (at[0, i], texts[i])), np.int64)
    at, numbers = at[:, order], [n[order] for n in numbers]
    at[0] = np.diff(at[0], prepend=0)
    buf = io.BytesIO()
    for a in (values, *(_planes(x) for x in at), *(_planes(x) for x in numbers)):
        np.save(buf, a, allow_pickle=False)
    if texts is not None:
        buf.write(b"\n".join(texts[i] for i in order.tolist()))
    raw = buf.getvalue()
    return pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def unpack(data: bytes, words: int, numbers: int) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
    """The columns that were packed, and what follows them, cut at line ends."""
    buf = io.BytesIO(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True))
    values = np.load(buf, allow_pickle=False)
    at = [_numbers(np.load(buf, allow_pickle=False)) for _ in range(words)]
    at[0] = np.cumsum(at[0])
    out = [_numbers(np.load(buf, allow_pickle=False)) for _ in range(numbers)]
    return [values[x] for x in at], out, buf.read().split(b"\n")


def hashed(texts: list[bytes], lang: np.ndarray) -> np.ndarray:
    return in_language(Runs(string_array(texts).cast(pa.large_string()), GAP).hashes(), lang)


def part_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def merged(words: list[np.ndarray], count: np.ndarray, *same: np.ndarray):
    """Distinct phrases by hash: hash, words, total count, the place of one row of each, and ``same`` there."""
    h = fold(words)
    order = np.argsort(h)
    h = h[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[order], head) if len(h) else count[:0]
    one = order[head]
    return h[head], [w[one] for w in words], total, one, *(s[one] for s in same)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                            enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                           ["kind", "size", "part", "data"])


# ---------------------------------------------------------------- one step

class Text:
    """Words of a block of texts as hashes, with the places where a phrase may go on to the next word."""

    def __init__(self, batch: pa.RecordBatch):
        runs = Runs(vec.strings(batch.column("text")), GAP)
        self.runs, self.lang = runs, lang_hash(batch.column("lang").to_pylist())[runs.doc]
        self.word = in_language(runs.hashes(), self.lang)
        broken = np.r_[0, np.cumsum(BREAK[runs.buf], dtype=np.int32)]
        piece = broken[runs.start]
        self.goes_on = (piece[1:] == piece[:-1]) & (runs.doc[1:] == runs.doc[:-1])

    def longer(self, sizes: list[int], marks: list[np.ndarray], step: int, cycle: int):
        """For each of ``sizes`` above 1, ascending: its word columns and steps of activation.

        A phrase is active since the last step at which one of its subphrases
        reached the threshold. That step is the same in every scan.
        """
        bits = int(len(marks[0])).bit_length() - 1
        at, since = np.arange(len(self.word)), np.zeros(len(self.word), np.uint8)
        on = np.r_[self.goes_on, np.zeros(1 + len(marks), bool)]
        for size in range(2, max(sizes, default=0) + 1):
            # Of the active phrases one word shorter, those at the threshold ...
            h = fold([self.word[at + i] for i in range(size - 1)])
            mark = marks[size - 2][(h >> _U(64 - bits)).astype(np.int64)]
            at, since = at[mark > 0], np.maximum(since, mark)[mark > 0]
            # ... two of which, one word apart and in one piece, make a longer one active.
            dense = np.zeros(len(self.word) + 1, np.uint8)
            dense[at] = since
            both = (dense[at + 1] > 0) & on[at + size - 2]
            at = at[both]
            since = np.maximum(dense[at], dense[at + 1])
            if size in sizes:
                due = since.astype(np.int64) + cycle >= step
                yield size, [self.word[at[due] + i] for i in range(size)], since[due]


_MARKS: dict = {}


def squeezed(marks: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """The marks, few of which are set, compressed for the broadcast."""
    return [(len(m), pa.compress(m.tobytes(), codec="zstd", asbytes=True)) for m in marks]


def _known(marks, name: str) -> list[np.ndarray]:
    """The marks of the step of that unique name, unpacked once a worker."""
    if name not in _MARKS:
        _MARKS.clear()
        _MARKS[name] = [np.frombuffer(pa.decompress(x, n, codec="zstd", asbytes=True), np.uint8) for n, x in marks.value]
    return _MARKS[name]


def _count(marks, sizes: list[int], step: int, cycle: int, bits: int):
    name = uuid.uuid4().hex

    def flush(held: dict):
        for size in sizes:
            parts, held[size] = held[size], []
            cols = [np.concatenate([p[0][i] for p in parts]) for i in range(size)]
            if not len(cols[0]):
                continue
            if size == 1:
                count, lang = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
                texts = [t for p in parts for t in p[3]]
                h, _, n, one, lang = merged(cols, count, lang)
                cols, numbers = [lang], [n, np.zeros(len(n), np.int64)]
                texts = [texts[i] for i in one.tolist()]
            else:
                since = np.concatenate([p[1] for p in parts])
                parts = None
                h, cols, n, _, since = merged(cols, np.ones(len(since), np.int64), since)
                numbers, texts = [n, since], None
            part = part_of(h, bits)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
                yield ("new", size, int(part[a]), pack([c[a:z] for c in cols], [x[a:z] for x in numbers],
                                                       texts and texts[a:z]))

    def run(batches):
        known = _known(marks, name)
        held, size_now = {s: [] for s in sizes}, 0
        for b in vec.blocks(batches):
            text = Text(b)
            if 1 in sizes:
                _, cols, n, one, lang = merged([text.word], np.ones(len(text.word), np.int64), text.lang)
                data = text.runs.buf.tobytes()
                words = [data[a:z].lower() for a, z in zip(text.runs.start[one].tolist(), text.runs.end[one].tolist(),
                                                           strict=True)]       # of bytes: A-Z only
                held[1].append((cols, n, lang, words))
            for size, cols, since in text.longer(sizes, known, step, cycle):
                held[size].append((cols, since))
            size_now += len(text.runs.buf)
            if size_now >= RUN_BYTES:
                yield _batch(list(flush(held)))
                size_now = 0
        if size_now:
            yield _batch(list(flush(held)))
    return run


def _merge(step: int, cycle: int, least: int, longest: int, slot_bits: int):
    """One part of one size: counts so far and new ones; phrases whose cycle is over leave."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, part = (k.as_py() for k in key)
        cols, count, since, old, texts = [], [], [], [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            c, (n, s), t = unpack(data, size, 2)
            if size == 1:
                c.append(hashed(t, c[0]))
                texts.extend(t)
            cols.append(c)
            count.append(n)
            since.append(s)
            old.append(n if kind == "open" else np.zeros(len(n), np.int64))
        cols = [np.concatenate([c[i] for c in cols]) for i in range(len(cols[0]))]
        lang = cols.pop(0) if size == 1 else None
        count, since, old = (np.concatenate(x) for x in (count, since, old))
        before = merged(cols, old)[2]
        h, cols, count, one, since = merged(cols, count, since)
        if size == 1:
            cols = [lang[one]]
        rows = []
        if size < longest:
            reached = h[(before < least) & (count >= least)]
            if len(reached):
                slots = np.unique((reached >> _U(64 - slot_bits)).astype(np.uint32))
                rows.append(("mark", size, part, pa.compress(slots.tobytes(), codec="zstd", asbytes=True)
                             + slots.nbytes.to_bytes(8, "little")))
        over = since + cycle <= step
        for kind, keep in (("open", ~over), ("done", over & (count >= least))):
            if keep.any():
                rows.append((kind, size, part, pack([c[keep] for c in cols], [count[keep], since[keep]],
                                                    [texts[i] for i in one[keep].tolist()] if size == 1 else None)))
        if size == 1 and over.any():    # words of a language in all, frequent or not
            langs, at = np.unique(cols[0][over], return_inverse=True)
            total = np.zeros(len(langs), np.int64)
            np.add.at(total, at, count[over])
            rows.append(("total", 1, part, langs.tobytes() + total.tobytes()))
        return pa.Table.from_batches([_batch(rows)])
    return run


# ---------------------------------------------------------------- the cycles

def _rows(batches):
    """Kept phrases as rows: word hashes and count; a single word's language's hash and bytes."""
    for b in batches:
        for size, data in zip(b.column("size").to_pylist(), b.column("data").to_pylist(), strict=True):
            cols, (n, _), texts = unpack(data, size, 2)
            lang, cols = (cols[0], [hashed(texts, cols[0])]) if size == 1 else (None, cols)
            words = np.stack(cols, 1).astype(np.int64).reshape(-1)
            yield pa.record_batch([
                pa.nulls(len(n), pa.int64()) if lang is None else pa.array(lang.astype(np.int64)),
                pa.array(np.full(len(n), size, np.int32)),
                vec.list_array(words, np.full(len(n), size), pa.int64()), pa.array(n, pa.int64()),
                pa.array([t.decode() for t in texts] if size == 1 else [None] * len(n), pa.string())],
                ["lang_h", "size", "words", "a", "word"])


def _totals(batches):
    for b in batches:
        for data in b.column("data").to_pylist():
            half = len(data) // 2
            yield pa.record_batch([pa.array(np.frombuffer(data[:half], np.int64)),
                                   pa.array(np.frombuffer(data[half:], np.int64))], ["lang_h", "n"])


def count_phrases(texts: DataFrame, least: int, longest: int, shards: int,
                  slot_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Phrases of ``lang, text`` rows with at least ``least`` occurrences, and the words of each language.

    The first table has ``size, words, a`` (and ``lang_h, word`` for single words; a word's
    hash has its language in it), the second ``lang_h, n``. Counts are exact: see the module's text.
    """
    spark = texts.sparkSession
    path = shared_path(spark, "phrase-texts")
    (texts.withColumn("shard", F.expr(f"pmod(monotonically_increasing_id(), {shards})"))
     .write.partitionBy("shard").parquet(path))
    dealt = spark.read.schema("lang string, text string, shard int").parquet(path)
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(size / DEAL_BYTES))) if size else 0
    if slot_bits is None:
        slot_bits = min(SLOT_BITS, max(16, math.ceil(math.log2(size / 64 + 1))))
    marks = [np.zeros(1 << slot_bits, np.uint8) for _ in range(longest - 1)]
    last = [0] + [-1 << 30] * (longest - 1)     # by size: the last step at which a phrase of it may have become active
    state, done = None, []
    step = 0
    while step < max(x + shards for x in last):
        step += 1
        sizes = [n + 1 for n in range(longest) if last[n] + shards >= step]
        known = spark.sparkContext.broadcast(squeezed(marks))
        rows = dealt.where(F.col("shard") == (step - 1) % shards).select("lang", "text").mapInArrow(
            _count(known, sizes, step, shards, bits), ROWS)
        if state is not None:
            rows = rows.unionByName(state.where("kind = 'open'"))
        state = write_table(rows.groupBy("size", "part").applyInArrow(
            _merge(step, shards, least, longest, slot_bits), ROWS), f"phrase-step{step}")
        done.append(state.where("kind in ('done', 'total')"))
        for r in state.where("kind = 'mark'").select("size", "data").collect():   # bounded by the slots
            slots = np.frombuffer(pa.decompress(r.data[:-8], int.from_bytes(r.data[-8:], "little"), codec="zstd",
                                                asbytes=True), np.uint32)
            m = marks[r["size"] - 1]
            m[slots[m[slots] == 0]] = step
            last[r["size"]] = step          # the phrases one word longer
        known.unpersist()
    kept = done[0]
    for d in done[1:]:
        kept = kept.unionByName(d)
    phrases = kept.where("kind = 'done'").select("size", "data").mapInArrow(
        _rows, "lang_h long, size int, words array<long>, a long, word string")
    totals = kept.where("kind = 'total'").select("data").mapInArrow(_totals, "lang_h long, n long")
    return write_table(phrases, "phrases"), totals.groupBy("lang_h").agg(F.sum("n").alias("n"))


def _lang_hashes(batches):
    for b in batches:
        langs = b.column("lang").to_pylist()
        yield pa.record_batch([b.column("lang"), pa.array(lang_hash(langs).astype(np.int64))], ["lang", "lang_h"])


def leading(rows: DataFrame, group: list[str], key: str, top: int) -> DataFrame:
    """Rows whose ``key`` may be among the first ``top`` of the group, highest first, ties included.

    ``ahead`` rows of the group are known to come before all of these. Counts per
    value are summed, not rows sorted, so no group of rows is one task.
    """
    cells = rows.groupBy(*group, key, "ahead").agg(F.count("*").alias("same"))
    by = Window.partitionBy(*group).orderBy(F.desc(key))
    cells = (cells.withColumn("past", F.col("ahead") + F.sum("same").over(by) - F.col("same"))
             .where(F.col("past") < top).drop("ahead"))
    return (rows.drop("ahead", "same").join(cells, [*group, key]).withColumnRenamed("past", "ahead"))


def exact(column: str) -> F.Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS,
                 covered_percent: int = 80, text_col: str = "text", lang_col: str = "lang",
                 slot_bits: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    A null text counts as empty, a null language as ``und`` (one with texts of
    that name); rows of empty or blank texts give no words; repeated rows count
    each time; a very long text is one block of one task; ties of score and count
    are ordered by the phrase's bytes; an empty table, or one without phrases of
    ``least`` occurrences, gives no row; other columns are left out.
    """
    if not 2 <= longest <= 200 // max(1, shards):     # steps fit in a byte
        raise ValueError("longest must be at least 2, and longest times shards at most 200")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    phrases, totals = count_phrases(texts, least, longest, shards, slot_bits)
    names = phrases.where("size = 1").select(F.col("words")[0].alias("w"), "lang_h", "word")
    long = phrases.where("size > 1").select("size", "words", "a")
    parts = phrases.select(F.col("words").alias("part"), F.col("a").alias("f"))
    # Every cut's two parts, then the cut of the lowest score.
    cuts = long.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "*", F.expr("slice(words, 1, k)").alias("left"), F.expr("slice(words, k + 1, size - k)").alias("right"))
    cuts = (cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), "left")
            .join(parts.withColumnsRenamed({"part": "right", "f": "r"}), "right"))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = (cuts.withColumn("score", score).groupBy("words")
            .agg(F.first("a").alias("a"), F.first("size").alias("size"), F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # Phrases inside a longer one that has nearly all of their occurrences go.
    inner = long.where("size > 2").select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> slice(words, i, m))))"
    )).alias("words")).groupBy("words").agg(F.max("a").alias("longer"))
    left = best.join(inner, "words", "left").where(
        F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * covered_percent))
    # Ranks by numbers first (ties at the end stay), then words for these few and the order of the ties.
    left = left.join(names.select("w", "lang_h"), F.col("words")[0] == F.col("w"))
    first = left.select("lang_h", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                        F.col("cut.score").alias("score"))
    first = write_table(leading(leading(first.withColumn("ahead", F.lit(0).cast("long")), ["lang_h"], "score", top),
                                ["lang_h", "score"], "a", top), "phrase-top")
    spelled = (first.select("words", F.posexplode("words").alias("i", "w")).join(names.select("w", "word"), "w")
               .groupBy("words")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]),
                                 " ").alias("phrase")))
    langs = texts.select("lang").distinct().mapInArrow(_lang_hashes, "lang string, lang_h long")
    out = first.join(spelled, "words").join(totals, "lang_h").join(langs, "lang_h")
    # Only phrases tied at the last place can be many: they are cut by parts first.
    by = Window.partitionBy("lang", F.expr("pmod(xxhash64(phrase), 64)")).orderBy("phrase")
    tied = out.where(F.col("same") > 2 * top).withColumn("i", F.row_number().over(by)).where(F.col("i") <= top).drop("i")
    out = out.where(F.col("same") <= 2 * top).unionByName(tied)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    return (out.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
k AS (
  SELECT c.*, k, x.f AS l, y.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM s JOIN n USING (lang)
WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.lang = s.lang AND q.phrase = s.phrase
                  AND CAST(100 AS HUGEINT) * q.a >= CAST(80 AS HUGEINT) * s.a)
QUALIFY rank <= 2000
"""


@llm_query("op13_phrase_collocations", SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 first collocations of two to four words in all documents."""
    return collocations(load(spark, sf_dir, "documents"))
