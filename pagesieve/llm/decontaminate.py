"""Benchmark decontamination: an FM-index per shard of training texts, searched for all benchmark windows.

A window is ``window`` consecutive words of a benchmark item (the whole item, if
it has fewer). The benchmark's distinct words are the alphabet. A shard is a block
of whole texts; its index holds the maximal runs of benchmark words that are long
enough for a window, since an occurrence lies inside one. All windows are searched
backward at once through wavelet-tree ranks, found rows are located by sampled
suffix positions, and the hit words are merged into removal spans.

Documents are scanned once, without a shuffle. Benchmark words reach the tasks in
blocks of at most about ``BLOCK_WORDS`` words; a larger benchmark takes one scan a
block, and the spans of a document are then merged by its row. Very long items
are cut into overlapping parts, which have the same windows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .fmindex import FMIndex
from .registry import llm_query
from .runs import CharIndex, Runs, gap_table
from .tables import load, write_table

WINDOW = 10
SHARD_BYTES = 6 << 20       # text of one index
BLOCK_WORDS = 1 << 21       # benchmark words sent to the tasks at once
PART_WORDS = 1 << 16        # words of one part of a long item
GAP = gap_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
SPAN = "struct<first:long,last:long,start:long,end:long>"
FOUND = f"n_words long, items array<string>, spans array<{SPAN}>"


# ---------------------------------------------------------------- the benchmark

def _item_parts(window: int):
    def run(batches):
        for b in vec.blocks(batches):
            words = Runs(vec.strings(b.column("text")), GAP)
            h = words.hashes().astype("<u8")
            ids, rows = b.column("item").to_pylist(), []
            for i, (a, z) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                for k in range(a, max(z - window, a) + 1, PART_WORDS):
                    end = min(z, k + PART_WORDS + window - 1)
                    if end > k:
                        rows.append((ids[i], k - a, end - k, h[k:end].tobytes()))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                                   enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                                  ["item", "at", "n", "words"])
    return run


class Windows:
    """A block of benchmark parts: its words, and its distinct windows by length with the items of each."""

    def __init__(self, parts: list[tuple[str | None, bytes]], window: int):
        self.items = sorted({i for i, _ in parts if i is not None})
        number = {x: i for i, x in enumerate(self.items)}
        words = [np.frombuffer(w, "<u8") for _, w in parts]
        self.words = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        grams: dict[int, list] = {}
        for (item, _), w in zip(parts, words, strict=True):
            size = min(window, len(w))
            grams.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(
                np.searchsorted(self.words, w) + 1, size), number.get(item, -1)))
        self.by_length = {}
        for size, found in grams.items():
            rows = np.concatenate([g for g, _ in found])
            owner = np.repeat([i for _, i in found], [len(g) for g, _ in found])
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            order = np.lexsort((owner, which))
            which, owner = which[order], owner[order]
            once = np.r_[True, (which[1:] != which[:-1]) | (owner[1:] != owner[:-1])] & (owner >= 0)
            which, owner = which[once], owner[once]
            self.by_length[size] = rows, np.searchsorted(which, np.arange(len(rows) + 1)), owner


_BLOCKS: dict = {}


def _windows(parts, name: str, window: int) -> Windows:
    """The windows of the block of that unique name, built once a worker; earlier blocks are let go."""
    if name not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[name] = Windows(parts.value, window)
    return _BLOCKS[name]


# ---------------------------------------------------------------- one shard

def occurrences(h: np.ndarray, doc: np.ndarray, windows: Windows):
    """``(first word, length, window)`` arrays by window length, from the shard's FM-index (``h``: word hashes)."""
    shortest = min(windows.by_length)
    at = np.minimum(np.searchsorted(windows.words, h), len(windows.words) - 1)
    known = windows.words[at] == h
    new = np.ones(len(h), bool)
    new[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    size = np.diff(head, append=len(h))
    keep = known[head] & (size >= shortest)
    if not keep.any():
        return
    head, size = head[keep], size[keep]
    n = int(size.sum()) + len(size) + 1
    symbols, word = np.zeros(n, np.int64), np.zeros(n, np.int64)
    inside = np.arange(int(size.sum()))
    within = inside - np.repeat(np.cumsum(size) - size, size)
    place = inside + np.repeat(np.arange(1, len(size) + 1), size)
    word[place] = np.repeat(head, size) + within
    symbols[place] = at[word[place]] + 1
    index = FMIndex(symbols, len(windows.words) + 1)
    for length, (rows, _, _) in windows.by_length.items():
        low, high = index.search(rows)
        count = high - low
        which = np.repeat(np.arange(len(rows)), count)
        found = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        yield word[index.locate(found)], length, which


def _search(parts, window: int, shard_bytes: int):
    name = uuid.uuid4().hex

    def run(batches):
        windows = _windows(parts, name, window)
        for b in vec.blocks(batches, limit=shard_bytes):
            n, start, end, first, h = b.num_rows, [], [], [0], []
            for sub in vec.blocks([b]):     # word and code-point places by smaller blocks
                text = Runs(vec.strings(sub.column("text")), GAP)
                index, h_ = CharIndex(text.buf), text.hashes()
                base = index.chars(text.offs[:-1])[text.doc]
                start.append(index.chars(text.start) - base)
                end.append(index.chars(text.end) - base)
                h.append(h_)
                first.extend((text.first[1:] + first[-1]).tolist())
            start, end, h, first = np.concatenate(start), np.concatenate(end), np.concatenate(h), np.array(first)
            doc = np.repeat(np.arange(n), np.diff(first))
            edge = np.zeros(len(h) + 1, np.int64)
            pairs = []
            if len(h) and windows.by_length:
                for word, length, which in occurrences(h, doc, windows):
                    np.add.at(edge, word, 1)
                    np.subtract.at(edge, word + length, 1)
                    _, at, owner = windows.by_length[length]
                    for d, k in np.unique(np.stack([doc[word], which], 1), axis=0).tolist():
                        pairs.append((d, owner[at[k]:at[k + 1]]))
            hit = np.cumsum(edge)[:-1] > 0
            head = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (doc[1:] != doc[:-1])][:len(hit)])
            last = np.flatnonzero(hit & np.r_[~hit[1:] | (doc[1:] != doc[:-1]), True][:len(hit)])
            items: list[list] = [[] for _ in range(n)]
            for d, owners in pairs:
                items[d].append(owners)
            named = [[windows.items[i] for i in np.unique(np.concatenate(x)).tolist()] if x else [] for x in items]
            per = np.bincount(doc[head], minlength=n) if len(head) else np.zeros(n, np.int64)
            offset = first[doc[head]]
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (
                head - offset, last - offset, start[head], end[last])], ["first", "last", "start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), spans)
            yield pa.record_batch([b.column("id"), pa.array(np.diff(first), pa.int64()),
                                   pa.array(named, pa.list_(pa.string())), spans],
                                  ["id", "n_words", "items", "spans"])
    return run


# ---------------------------------------------------------------- merging over blocks of the benchmark

def _merged(batches):
    """Per row: the spans of all blocks as disjoint spans of words, those that touch made one; sorted items."""
    for b in batches:
        out = []
        for found in b.column("spans").to_pylist():
            done: list[dict] = []
            for s in sorted((s for part in found or [] for s in part), key=lambda s: (s["first"], s["last"])):
                if done and s["first"] <= done[-1]["last"] + 1:
                    if s["last"] > done[-1]["last"]:
                        done[-1].update(last=s["last"], end=s["end"])
                else:
                    done.append(dict(s))
            out.append(done)
        items = [sorted({x for part in found or [] for x in part}) for found in b.column("items").to_pylist()]
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
        yield pa.record_batch([b.column("id"), b.column("n_words"), pa.array(items, pa.list_(pa.string())),
                               pa.array(out, kind)], ["id", "n_words", "items", "spans"])


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document row: its id, ``n_words``, ``items`` (ids as text, sorted) and removal ``spans``.

    A span is a maximal stretch of hit words: ``first`` and ``last`` word, ``start``
    and ``end`` in code points (end exclusive). Null and empty texts have no words;
    an item without words has no window; several rows of one item id are one item;
    a null item id has windows that hit but is not listed. Repeated document rows
    each give a row, null ids stay null, an empty benchmark finds nothing, empty
    documents give no row; a long text is a shard of its own; other columns are
    left out, so their names cannot clash.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    spark = docs.sparkSession
    parts = write_table(
        bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
        .mapInArrow(_item_parts(window), "item string, at long, n long, words binary"), "benchmark-words")
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    kind = docs.schema[id_col].dataType.simpleString()

    def block(k: int):
        rows = parts.where(F.expr(f"pmod(xxhash64(coalesce(item, ''), at, words), {blocks})") == k)
        return spark.sparkContext.broadcast([(r.item, bytes(r.words)) for r in rows.select("item", "words").toLocalIterator()])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks == 1:
        found = texts.mapInArrow(_search(block(0), window, shard_bytes), f"id {kind}, {FOUND}")
        return found.withColumnRenamed("id", id_col)
    texts = write_table(texts.withColumn("row", F.monotonically_increasing_id()), "decontaminate-texts")
    found = None
    for k in range(blocks):
        one = write_table(texts.select(F.col("row").alias("id"), "text").mapInArrow(
            _search(block(k), window, shard_bytes), f"id long, {FOUND}").where("size(spans) > 0 or " + str(k == 0).lower()),
            f"decontaminate-{k}")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.collect_list("items").alias("items"),
                                    F.collect_list("spans").alias("spans"))     # at most one entry a block
    found = found.mapInArrow(_merged, f"id long, {FOUND}").withColumnRenamed("id", "row")
    return texts.select("row", "id").join(found, "row").drop("row").withColumnRenamed("id", id_col)


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """The text without its removal spans (a null text stays null)."""
    begin = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    stop = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    keep = F.zip_with(begin, stop, lambda a, z: text.substr((a + 1).cast("int"), (z - a).cast("int")))
    return F.when(text.isNotNull(), F.concat_ws("", keep))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
         unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
                 FOR i IN range(1, greatest(len(w) - 10, 0) + 2)]) AS k
  FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM g),
o AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
         unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS k
  FROM d, s WHERE len(w) >= size),
m AS (SELECT o.doc_id, o.pos, o.size, g.item FROM o JOIN g ON o.size = g.size AND o.k = g.k),
h AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS word FROM m) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@llm_query("op12_benchmark_decontamination", SQL)
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark windows of ten words."""
    found = find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))
