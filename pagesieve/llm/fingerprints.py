"""Document fingerprints from prefix polynomial hashes.

For a text of code points c, the prefix array holds sum(c[j] * B^j, j < i) modulo
a prime, for two bases. A difference of two entries, shifted by an inverse power,
is the hash of a span wherever it stands, so any two spans are compared in
constant time and the longest common extension of two places is found by binary
search. Arrays are built for a block of texts at once.

A text's fingerprint is its length, the hash of the whole text and a sketch of
its windows (all spans of ``WINDOW`` code points; a shorter text is one window):
of the windows whose mixed hash falls into each of ``BINS`` bins the least one is
kept. Likeness is 1 for equal whole-text hashes, else the share of equal bins
among those used by either text: an estimate of the Jaccard similarity of the
window sets, with a standard error of at most 0.063.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .registry import llm_query
from .tables import load

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_177)
WINDOW = 16
BINS = 64
SLICE = 1 << 19
BLOCK = 2 << 20
PART_BYTES = 24 << 20
_U = np.uint64
_P = _U(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2^31 - 1, for x below 2^62."""
    x = (x & _P) + (x >> _U(31))
    x = (x & _P) + (x >> _U(31))
    return np.where(x >= _P, x - _P, x)


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime, by doubling; kept and grown."""
    t = _TABLES.get(base, np.ones(1, np.uint32))
    while len(t) < n:
        step = _U(pow(base, len(t), PRIME))
        t = np.r_[t, _mod(t.astype(np.uint64) * step).astype(np.uint32)]
    _TABLES[base] = t
    return t


class Prefixes:
    """Prefix hash arrays of a block of texts."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        self.size = np.array([len(r) for r in raw], np.int64) // 4
        self.head = np.cumsum(self.size) - self.size
        cp = np.frombuffer(b"".join(raw), np.uint32)
        self.n = len(cp)
        self.sums = []
        for base in BASES:
            p = _powers(base, self.n + 1)
            out = np.zeros(self.n + 1, np.uint32)
            carry = _U(0)
            for a in range(0, self.n, SLICE):
                b = min(self.n, a + SLICE)
                x = _mod((cp[a:b].astype(np.uint64) + _U(1)) * p[a:b])
                x[0] += carry
                x = _mod(np.cumsum(x))
                out[a + 1:b + 1] = x
                carry = x[-1]
            self.sums.append(out)

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of spans given by places in the block; equal spans have equal hashes."""
        out = np.zeros(len(start), np.uint64)
        for base, s in zip(BASES, self.sums, strict=True):
            inverse = _powers(pow(base, -1, PRIME), self.n + 1)
            d = s[start + length].astype(np.uint64) + _P - s[start]
            out = (out << _U(31)) | _mod(_mod(d) * inverse[start])
        return out

    def whole(self) -> np.ndarray:
        return self.spans(self.head, self.size)

    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        """Least window of each bin and text (16 bits of it), and which bins are used."""
        least = np.full(len(self.size) * BINS, np.iinfo(np.uint64).max, np.uint64)
        width = np.minimum(self.size, WINDOW)
        n_win = np.where(self.size > 0, self.size - width + 1, 0)
        for a in range(0, self.n, SLICE):
            b = min(self.n, a + SLICE)
            d0 = int(np.searchsorted(self.head, a, "right")) - 1
            d1 = int(np.searchsorted(self.head, b, "left"))
            lo = np.maximum(self.head[d0:d1], a)
            hi = np.minimum(self.head[d0:d1] + n_win[d0:d1], b)
            n = np.maximum(hi - lo, 0)
            if not n.sum():
                continue
            doc = np.repeat(np.arange(d0, d1), n)
            start = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            h = vec.mix(self.spans(start, width[doc]))
            np.minimum.at(least, doc * BINS + (h >> _U(58)).astype(np.int64), h << _U(6) >> _U(6))
        used = least != np.iinfo(np.uint64).max
        low = np.where(used, least & _U(0xFFFF), _U(0)).astype(np.uint16)
        return low.reshape(-1, BINS), used.reshape(-1, BINS)


def common_extension(a: Prefixes, at: np.ndarray, b: Prefixes, other: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of places ``at`` in ``a`` and ``other`` in ``b``, at most ``most``."""
    low, high = np.zeros(len(at), np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = a.spans(at, mid) == b.spans(other, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def likeness(a, b) -> np.ndarray:
    """Likeness, row by row, of (whole, size, sketch, used) tuples."""
    (wa, na, sa, ua), (wb, nb, sb, ub) = a, b
    either = (ua | ub).sum(1)
    same = (ua & ub & (sa == sb)).sum(1)
    return np.where((wa == wb) & (na == nb), 1.0, same / np.maximum(either, 1))


def _features(texts: list[str]):
    p = Prefixes(texts)
    return p, (p.whole(), p.size, *p.sketch())


def _hex(f) -> list[str]:
    whole, size, sketch, used = f
    marks = np.packbits(used, axis=1)
    return [f"{n:x}-{w:016x}-{m.tobytes().hex()}-{s.astype('>u2').tobytes().hex()}"
            for w, n, m, s in zip(whole.tolist(), size.tolist(), marks, sketch, strict=True)]


def edit(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many first code points of the following one, or all."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results for all but the last text, which only follows."""
    n = len(ids)
    own, following = texts[:n], texts[1:n + 1]
    edited = [edit(a, b) for a, b in zip(own, following, strict=True)]
    p, f = _features(texts[:n + 1])
    first, after = tuple(x[:n] for x in f), tuple(x[1:] for x in f)
    q, g = _features(edited)
    marks = _hex(first)
    return pa.record_batch([
        pa.array(ids, pa.int64()), pa.array(first[1], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(marks, pa.string()), pa.array(_hex(g), pa.string()),
        pa.array(likeness(first, g)), pa.array(likeness(first, after)),
        pa.array(common_extension(p, p.head[:n], q, q.head, np.minimum(p.size[:n], q.size)), pa.int64()),
        pa.array(common_extension(p, p.head[:n], p, p.head[1:], np.minimum(p.size[:n], p.size[1:])), pa.int64()),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        "same_edited", "same_next"])


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, same_edited long, same_next long")


def _chained(batches):
    """Rows of buckets in order; the last of a bucket is the first of the next bucket and only follows."""
    bucket, ids, texts, size, closed = None, [], [], 0, False
    for b in batches:
        for k, doc_id, text, extra in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(),
                                          vec.strings(b.column("text")).to_pylist(), b.column("extra").to_pylist(),
                                          strict=True):
            if k != bucket:
                bucket, ids, texts, size, closed = k, [], [], 0, False
            if closed:
                continue
            texts.append(text)
            size += len(text)
            if extra:
                closed = True
            if extra or size > BLOCK:
                if ids:
                    yield _rows(ids, texts)
                ids, texts, size = [], [text], len(text)
            if not extra:
                ids.append(doc_id)


def _bucketed(bounds: np.ndarray, follows: dict[int, int]):
    """Adds each row's bucket; a bucket's first row goes also, as extra, to the bucket before it."""
    def run(batches):
        for b in batches:
            key = np.asarray(b.column("key"))
            bucket = np.searchsorted(bounds, key, "left")
            yield pa.record_batch([*b.columns, pa.array(bucket, pa.int64()), pa.array(np.zeros(len(key), bool))],
                                  [*b.schema.names, "bucket", "extra"])
            top = [i for i, k in enumerate(key.tolist()) if k in follows]
            if top:
                t = b.take(pa.array(top))
                yield pa.record_batch([*t.columns, pa.array([follows[k] for k in key[top].tolist()], pa.int64()),
                                       pa.array(np.ones(len(top), bool))], [*t.schema.names, "bucket", "extra"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document in the terms of ``SCHEMA``, each against its edited text and the next document.

    The next document is the one with the next smaller id (the last one's is the
    first); rows of one id follow by text, null ids come last. ``same_edited`` and
    ``same_next`` are the lengths of the common beginnings. A null text counts as
    empty; two empty texts have likeness 1. Repeated rows each get a row, a single
    row follows itself, an empty table gives no row; other columns are left out.

    Texts are shuffled once, in ranges of ids; only a range's first text is sent
    twice, so that every range knows the text that follows its last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    parts = max(1, math.ceil(size / part_bytes))
    bounds = np.array(rows.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts)
                      if parts > 1 else [], np.float64)
    bounds = np.unique(bounds.astype(np.int64))

    def buckets(batches):
        for b in batches:
            key = np.asarray(b.column("key"))
            yield pa.record_batch([b.column("key"), pa.array(np.searchsorted(bounds, key, "left"), pa.int64())],
                                  ["key", "bucket"])
    tops = {r["bucket"]: r["top"] for r in
            rows.select("key").mapInArrow(buckets, "key long, bucket long")
            .groupBy("bucket").agg(F.max("key").alias("top")).collect()}   # one row per range
    order = sorted(tops)
    follows = {tops[b]: order[i + 1] if i + 1 < len(order) else order[0] for i, b in enumerate(order)}
    kind = "doc_id long, text string, key long, bucket long, extra boolean"
    return (rows.mapInArrow(_bucketed(bounds, follows), kind)
            .repartitionById(parts, F.col("bucket").cast("int"))    # a range is one task
            .sortWithinPartitions("bucket", "extra", F.desc("key"), "text")
            .mapInArrow(_chained, SCHEMA))


@llm_query("op9_document_fingerprints")
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(load(spark, sf_dir, "documents"))
