"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, read from mapped files.

Order 3, which the query uses, is counted and stored by the more compact form in
``trigrams``; this module holds any other order and the scores of both.

Words are hashed to 64 bits; a text is its words and one end token, led by begin
tokens that are never predicted. The highest order has plain counts; a lower
order has continuation counts, the number of distinct tokens seen before an
n-gram, that is its number of distinct n-grams of the next order.

One chain of groupings counts all orders. A task sorts the n-grams of its texts,
counts them and deals them by the leading bits of their hash; a shard merges
these runs, writes its n-grams, and deals on (a) each context's total and how
many of its n-grams occur once, twice and more often, and (b) the next lower
order's n-grams with the number found here. So a frequent word, line or text is
one entry per task or shard, never one group.

Each shard is written, in the folder that the cluster shares, as arrays sorted by
hash: a count of one byte per n-gram and four per context (those of larger totals
in a side table). Workers map these files into memory and look up sorted blocks of
hashes, so a model larger than memory is read page by page. A lost executor's
tasks write the same files again under a temporary name and rename them.
"""

from __future__ import annotations

import io
import math
import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trigrams, vec
from .registry import llm_query
from .tables import load

ORDER = 3
SHARD_BYTES = 24 << 20    # text per shard
RUN_BYTES = 16 << 20      # text that a task sorts at once
_U = np.uint64
BEGIN, END = (_U(x) for x in vec.constants(2, 41))
_MUL = _U(0x9FB21C651E98DF25)
ROWS = "kind string, n int, shard long, data binary"


# ---------------------------------------------------------------- tokens and n-grams

def tokens(texts: pa.Array, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block of texts, each led by ``lead`` begin tokens, and the text of each token."""
    w = vec.Words(texts)
    size = np.diff(w.first) + lead + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, BEGIN, np.uint64)
    if len(out):
        out[ends - 1] = END
        out[np.arange(len(w.start)) + w.doc * (lead + 1) + lead] = w.hashes()
    return out, np.repeat(np.arange(w.n_docs), size)


def predicted(tok: np.ndarray, doc: np.ndarray, lead: int) -> np.ndarray:
    """Places of the tokens that are not begin tokens."""
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    pos = np.arange(len(tok)) - np.repeat(head, np.diff(head, append=len(tok)))
    return np.flatnonzero(pos >= lead)


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of tokens given as columns."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = vec.mix(h * _MUL + c)
    return h


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


# ---------------------------------------------------------------- counting

def _slim(a: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them; hashes as they are."""
    return a if a.dtype == np.uint64 or not len(a) else a.astype(np.min_scalar_type(a.max()))


def _blob(arrays: list[np.ndarray], words: int) -> bytes:
    """Compressed arrays; of several leading columns of words the distinct words and planes of numbers, rows sorted."""
    if words > 1:
        values, at = np.unique(np.concatenate(arrays[:words]), return_inverse=True)
        at = at.reshape(words, -1)
        order = np.argsort(at[0] * len(values) + at[1])
        at = np.ascontiguousarray(at[:, order], "<u4")
        at[0] = np.diff(at[0], prepend=at[0][:1] * 0)
        arrays = [values, at.view(np.uint8).reshape(words, -1, 4).transpose(0, 2, 1), *(a[order] for a in arrays[words:])]
    buf = io.BytesIO()
    for a in arrays:
        np.save(buf, np.ascontiguousarray(_slim(a)), allow_pickle=False)
    return pa.compress(buf.getvalue(), codec="zstd", asbytes=True) + len(buf.getvalue()).to_bytes(8, "little")


def _unblob(data: bytes, n: int, words: int = 0) -> list[np.ndarray]:
    buf = io.BytesIO(pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True))
    out = [np.load(buf, allow_pickle=False) for _ in range(n - words + 2 if words > 1 else n)]
    if words > 1:
        at = np.ascontiguousarray(out[1].transpose(0, 2, 1)).view("<u4")[:, :, 0]
        out = [out[0][np.cumsum(at[0], dtype=np.int64)], *(out[0][x] for x in at[1:]), *out[2:]]
    return [a if a.dtype == np.uint64 and i < max(words, 1) else a.astype(np.int64) for i, a in enumerate(out)]


def _deal(kind: str, n: int, key: np.ndarray, bits: int, arrays: list[np.ndarray]):
    """Rows of one blob per shard; within a shard by the first column, which then compresses well."""
    if not len(key):
        return
    shard = shard_of(key, bits)
    order = np.argsort((shard.astype(np.uint64) << _U(64 - bits) if bits else _U(0)) | (arrays[0] >> _U(bits)))
    shard, arrays = shard[order], [a[order] for a in arrays]
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(shard)], strict=True):
        yield kind, n, int(shard[a]), _blob([x[a:b] for x in arrays], n if kind == "gram" else 1)


def _counted(columns: list[np.ndarray], weight: np.ndarray | None = None):
    """Distinct rows of the columns: their hash (ascending), the columns, the number or total weight of each."""
    h = fold(columns)
    order = np.argsort(h)
    h = h[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    n = np.diff(at, append=len(h)) if weight is None else (
        np.add.reduceat(weight[order], at) if len(at) else weight[:0])
    return h[at], [c[order[at]] for c in columns], n


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                            enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                           ["kind", "n", "shard", "data"])


def _runs(order: int, bits: int):
    def flush(held):
        cols = [np.concatenate([h[i] for h in held]) for i in range(order)]
        h, distinct, n = _counted(cols)
        yield from _deal("gram", order, h, bits, [*distinct, n])
        h, distinct, n = _counted(cols[-1:])
        yield from _deal("raw", 1, h, bits, [*distinct, n])

    def run(batches):
        held, size = [], 0
        for b in vec.blocks(batches):
            texts = vec.strings(b.column("text"))
            tok, doc = tokens(texts, order - 1)
            at = predicted(tok, doc, order - 1)
            held.append([tok[at - i] for i in range(order - 1, -1, -1)])
            size += int(vec.offsets(texts)[-1] - vec.offsets(texts)[0])
            if size >= RUN_BYTES:
                yield _batch(flush(held))
                held, size = [], 0
        if held:
            yield _batch(flush(held))
    return run


def _merge(path: str, bits: int):
    """One shard of one kind: merge its runs, write its arrays, deal on what lower orders and contexts need."""
    def grams(n, shard, blobs):
        parts = [_unblob(x, n + 1, n) for x in blobs]
        cols = [np.concatenate([p[i] for p in parts]) for i in range(n)]
        h, cols, c = _counted(cols, np.concatenate([p[n] for p in parts]))
        _store_counts(path, f"gram{n}-{shard}", h, count=c)
        stat = [np.count_nonzero(c == i) for i in (1, 2, 3, 4)]
        yield "stat", n, shard, np.array([*stat, c.sum(), len(c)], np.int64).tobytes()
        if n == 1:
            return
        ctx = fold(cols[:-1])
        order = np.argsort(ctx)
        ctx, per = ctx[order], c[order]
        at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (per, per == 1, per == 2, per > 2)]
        yield from _deal("context", n, ctx[at], bits, [ctx[at], *sums])
        low, lower, left = _counted(cols[1:])
        yield from _deal("gram", n - 1, low, bits, [*lower, left])

    def contexts(n, shard, blobs):
        parts = [_unblob(x, 5) for x in blobs]
        ctx, *sums = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.argsort(ctx)
        ctx = ctx[order]
        at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        total, one, two, more = (np.add.reduceat(x[order], at) for x in sums)
        _store_counts(path, f"context{n}-{shard}", ctx[at], total=total, one=one, two=two, more=more)

    def raw(shard, blobs):
        parts = [_unblob(x, 2) for x in blobs]
        h, _, c = _counted([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]))
        _store_counts(path, f"raw1-{shard}", h, count=c)
        yield "stat", 0, shard, np.array([0, 0, 0, 0, c.sum(), len(c)], np.int64).tobytes()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, n, shard = (k.as_py() for k in key)
        blobs = [x.as_py() for x in table.column("data")]
        if kind == "gram":
            rows = grams(n, shard, blobs)
        elif kind == "raw":
            rows = raw(shard, blobs)
        elif kind == "context":
            contexts(n, shard, blobs)
            rows = []
        else:
            rows = [(kind, n, shard, x) for x in blobs]
        return pa.Table.from_batches([_batch(rows)])
    return run


def _store_counts(path: str, name: str, h: np.ndarray, **counts: np.ndarray) -> None:
    """Counts of one byte each, none above the first of its row; rows whose first is 255 or more in a side table."""
    big = next(iter(counts.values())) >= 255
    _store(path, name, hash=h, **{k: np.where(big, 255, c).astype(np.uint8) for k, c in counts.items()},
           big_hash=h[big], **{f"big_{k}": c[big] for k, c in counts.items()})


def _store(path: str, name: str, **arrays: np.ndarray) -> None:
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    for part, a in arrays.items():
        buf = io.BytesIO()
        np.save(buf, a, allow_pickle=False)
        end = f"{root}/{name}-{part}.npy"
        new = f"{end}.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as out:
            out.write(buf.getbuffer())
        fs.move(new, end)


# ---------------------------------------------------------------- the model

def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; i/2 for count i where the counts of counts give none between 0 and i."""
    out, n = [], (n1, n2, n3, n4)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else -1.0
        out.append(d if 0 < d <= i else i / 2)
    return tuple(out)


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and the numbers that all shards share."""
    path: str
    order: int
    bits: int
    total: int                                     # predicted tokens of the training texts
    vocabulary: int                                # distinct among them
    discount: tuple[tuple[float, float, float], ...]   # by order, from 1
    lowest: tuple[int, int, int, int]              # of the empty context: total, and n-grams seen once, twice, more


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text",
          shard_bytes: int | None = None) -> Model | trigrams.Model:
    """Count the texts of all rows (a null text counts as empty) and write the model's files."""
    if order < 1:
        raise ValueError("order must be at least 1")
    if order == 3:
        return trigrams.train(docs, text_col, shard_bytes or trigrams.SHARD_BYTES)
    shard_bytes = shard_bytes or SHARD_BYTES
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(size / shard_bytes))) if size else 0
    path = trigrams.folder(spark, "kneser-ney")
    rows = texts.mapInArrow(_runs(order, bits), ROWS)
    for _ in range(order + 1):
        rows = rows.groupBy("kind", "n", "shard").applyInArrow(_merge(path, bits), ROWS)
    stats = rows.mapInArrow(_stat_rows, "n int, " + ", ".join(f"x{i} long" for i in range(6)))
    got = {r["n"]: [r[f"s{i}"] for i in range(6)]
           for r in stats.groupBy("n").agg(*[F.sum(f"x{i}").alias(f"s{i}") for i in range(6)]).collect()}
    zero = [0] * 6
    n1, n2, _, _, total, kinds = got.get(1, zero)
    return Model(path, order, bits, got.get(0, zero)[4], got.get(0, zero)[5],
                 tuple(discounts(*got.get(n, zero)[:4]) for n in range(1, order + 1)),
                 (total, n1, n2, kinds - n1 - n2))


def _stat_rows(batches):
    for b in batches:
        got = [np.frombuffer(x, np.int64) for x in b.column("data").to_pylist()]
        yield pa.record_batch([b.column("n"), *(pa.array([g[i] for g in got], pa.int64()) for i in range(6))],
                              ["n", *(f"x{i}" for i in range(6))])


@lru_cache(maxsize=4096)
def _mapped(path: str, name: str):
    """An array of the model: mapped if the shared folder is a path here, else read into memory; None if absent."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    at = f"{root}/{name}.npy"
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.load(at, mmap_mode="r", allow_pickle=False) if os.path.exists(at) else None
    if fs.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_file(at) as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)


def _lookup(model: Model, kind: str, h: np.ndarray, parts: tuple[str, ...]) -> list[np.ndarray]:
    """Values at the hashes ``h`` (ascending), 0 where a hash is absent."""
    out = [np.zeros(len(h), np.int64) for _ in parts]
    shard = shard_of(h, model.bits)
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(h) else []
    for a, b in zip(cut, np.r_[cut[1:], len(h)] if len(h) else [], strict=True):
        name = f"{kind}-{shard[a]}"
        keys = _mapped(model.path, f"{name}-hash")
        if keys is None or not len(keys):
            continue
        at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
        hit = keys[at] == h[a:b]
        for o, part in zip(out, parts, strict=True):
            o[a:b][hit] = _mapped(model.path, f"{name}-{part}")[at[hit]]
        many = np.flatnonzero(hit) + a
        many = many[out[0][many] == 255]
        if len(many):
            place = np.searchsorted(_mapped(model.path, f"{name}-big_hash"), h[many])
            for o, part in zip(out, parts, strict=True):
                o[many] = _mapped(model.path, f"{name}-big_{part}")[place]
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    slot = np.empty(len(h), np.int64)
    slot[order] = np.cumsum(new) - 1
    return s[new], slot


def _probabilities(model: Model, cols: list[np.ndarray]) -> np.ndarray:
    """Probability of each row's last token after the others (columns are tokens, as many as the order)."""
    p = np.full(len(cols[0]), 1.0 / (model.vocabulary + 1))
    for n in range(1, model.order + 1):
        d = np.array([0.0, *model.discount[n - 1]])
        own = cols[model.order - n:]
        each, slot = _distinct(fold(own))
        c = _lookup(model, f"gram{n}", each, ("count",))[0]
        c = np.maximum(c - d[np.minimum(c, 3)], 0)[slot]
        if n == 1:
            total, one, two, more = model.lowest
            total = np.full(len(c), total)
            left = d[1] * one + d[2] * two + d[3] * more
        else:
            each, slot = _distinct(fold(own[:-1]))
            total, one, two, more = (x[slot] for x in
                                     _lookup(model, f"context{n}", each, ("total", "one", "two", "more")))
            left = d[1] * one + d[2] * two + d[3] * more
        known = np.maximum(total, 1)
        p = np.where(total > 0, c / known + left / known * p, p)
    return p


def _known(model: Model, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each row's last token after the others, and how often that token occurs."""
    if model.order == 3:
        return trigrams.probabilities(model, [discounts(*x) for x in model.counts], *(c >> _U(8) for c in cols))
    each, slot = _distinct(fold(cols[-1:]))
    return _probabilities(model, cols), _lookup(model, "raw1", each, ("count",))[0][slot]


def _score(model: Model | trigrams.Model):
    def run(batches):
        lead = model.order - 1
        for b in vec.blocks(batches, limit=RUN_BYTES // 2):
            tok, doc = tokens(vec.strings(b.column("text")), lead)
            at = predicted(tok, doc, lead)
            n, doc = b.num_rows, doc[at]
            cols = [tok[at - i] for i in range(lead, -1, -1)]
            p, c = _known(model, cols)
            base, score = np.log10((c + 1) / (model.total + model.vocabulary + 1)), np.log10(p)
            n_tok = np.bincount(doc, minlength=n)
            total = np.bincount(doc, score, n)
            yield pa.record_batch(
                [b.column("id"), pa.array(n_tok, pa.int64()), pa.array(np.bincount(doc, c > 0, n).astype(np.int64)),
                 pa.array(np.full(n, model.total), pa.int64()), pa.array(np.bincount(doc, base, n)),
                 pa.array(total), pa.array(10 ** (-total / n_tok))],
                ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
    return run


def score(docs: DataFrame, model: Model | trigrams.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    A null text counts as empty, an empty text has the end token only. Under a
    model of no texts every token has probability 1. Repeated rows each get a row,
    null ids stay null, an empty table gives no row; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_score(model), f"id {kind}, n_tokens long, n_known long, train_tokens long, "
                                       "base_score double, score double, perplexity double")
            .withColumnRenamed("id", id_col))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


@llm_query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents under a model of six sevenths of them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                     "base_score", "score", "perplexity")
