"""The order-3 form of the Kneser-Ney model: one shuffle of trigrams dealt by their middle word.

All that a trigram (a, b, c) adds to the model is known where b's trigrams are:
its own count, the totals of the context (a, b), the continuation count of the
bigram (b, c), the totals of the context b, and how often b itself occurs. So
the trigrams are shuffled once, as numbers into a small word list per run, and
only one number per last word (its distinct predecessors) is shuffled again. A
middle word that would fill half a shard is dealt by (b, c) instead; the totals
of its contexts are then sums over shards (a second kind of row) and its own
totals, at most four words for each shard, are part of ``Model``.

A shard is one file of sorted hash arrays: middle words, under each its
predecessors, under each of those the words that follow, and under each middle
word the words that follow it. Words have 56-bit hashes; an entry under a word
keeps the leading 32 bits, sorted, so a look-up of a pair that was never seen
meets a wrong entry with a chance of the list's length in 2^32.
"""

from __future__ import annotations

import json
import math
import mmap
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .tables import shared_path

_U = np.uint64
_MUL = _U(0x9FB21C651E98DF25)
BEGIN, END = (x >> _U(8) for x in vec.constants(2, 41))
RUN_TOKENS = 4_000_000    # tokens that a task sorts at once
SHARD_BYTES = 48 << 20    # text per shard
LOCAL = 21                # bits of a word's number in a run
STEP = 8                  # contexts per stored start
ROWS = "kind string, shard long, data binary"
NO_INT = np.zeros(0, np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block of texts, two begin tokens before and one end token after each; each token's text."""
    w = vec.Words(texts)
    size = np.diff(w.first) + 3
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, BEGIN, np.uint64)
    if len(out):
        out[ends - 1] = END
        out[np.arange(len(w.start)) + w.doc * 3 + 2] = w.hashes() >> _U(8)
    return out, np.repeat(np.arange(w.n_docs), size)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return vec.mix(a * _MUL + b)


def _shard(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _among(words: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which words are among the sorted ``few``."""
    if not len(few):
        return np.zeros(len(words), bool)
    return few[np.minimum(np.searchsorted(few, words), len(few) - 1)] == words


def deal(mid: np.ndarray, last: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """Shard of trigrams by their middle word; by middle and last word where the middle word is hot."""
    key = mid << _U(8)
    at = np.flatnonzero(_among(mid, hot))
    key[at] = pair(mid[at], last[at])
    return _shard(key, bits)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _segments(order: np.ndarray, shard: np.ndarray):
    """Each shard with its rows, in the given order inside."""
    order = order[np.argsort(shard[order], kind="stable")]
    at = _heads(shard[order])
    for a, b in zip(at, [*at[1:], len(order)], strict=False):
        yield int(shard[order[a]]), order[a:b]


# ---------------------------------------------------------------- rows of the shuffle

def _pack(words: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Sorted words as differences, and columns of numbers, as byte planes without empty planes, compressed."""
    out, head = [], [len(numbers)]
    for a in (np.diff(words, prepend=_U(0)), *(x.astype(np.uint64) for x in numbers)):
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [len(a), width]
        planes = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out.append(np.ascontiguousarray(planes.T).tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0]) + 1
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for size, width in head.reshape(-1, 2):
        a = np.zeros((size, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        at += size * width
        out.append(a.reshape(-1).view("<u8") if size else np.zeros(0, np.uint64))
    return [np.cumsum(out[0], dtype=np.uint64), *(x.astype(np.int64) for x in out[1:])]


def _steps(a: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Differences inside groups of ascending values, the first value of each group as it is."""
    d = np.diff(a, prepend=0)
    d[heads] = a[heads]
    return d


def _unsteps(d: np.ndarray, heads: np.ndarray) -> np.ndarray:
    c = np.cumsum(d)
    return c - np.repeat(c[heads] - d[heads], np.diff(heads, append=len(d)))


def pack_trigrams(voc: np.ndarray, mid: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted trigrams (numbers into the sorted word list ``voc``) with their counts."""
    used = np.zeros(len(voc), bool)
    used[mid] = used[first] = used[last] = True
    rank = np.cumsum(used) - 1
    mid, first, last = rank[mid], rank[first], rank[last]
    by_mid, by_context = _heads(mid), _heads(mid, first)
    return _pack(voc[used], np.diff(mid[by_mid], prepend=0), np.diff(by_mid, append=len(mid)),
                 _steps(first[by_context], np.searchsorted(by_context, by_mid)),
                 np.diff(by_context, append=len(mid)), _steps(last, by_context), n)


def unpack_trigrams(data: bytes) -> list[np.ndarray]:
    """The word list, and the columns middle, first, last and count."""
    words, mid, per_mid, first, per_context, last, n = _unpack(data)
    by_mid, by_context = np.cumsum(per_mid) - per_mid, np.cumsum(per_context) - per_context
    first = np.repeat(_unsteps(first, np.searchsorted(by_context, by_mid)), per_context)
    return [words, np.repeat(np.cumsum(mid), per_mid), first, _unsteps(last, by_context), n]


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                            enumerate((pa.string(), pa.int64(), pa.binary()))], ["kind", "shard", "data"])


# ---------------------------------------------------------------- counting

def _runs(batches):
    """Tokens and the places of the predicted ones, in runs of at most RUN_TOKENS places."""
    held, size = [], 0

    def cut():
        tok = np.concatenate([t for t, _ in held])
        at = np.concatenate([p + s for (_, p), s in zip(held, np.cumsum([0, *(len(t) for t, _ in held)]), strict=False)])
        for i in range(0, len(at), RUN_TOKENS):
            some = at[i:i + RUN_TOKENS]
            yield tok[some[0] - 2:some[-1] + 1], some - some[0] + 2

    for b in vec.blocks(batches):
        tok, doc = tokens(vec.strings(b.column("text")))
        start = np.searchsorted(doc, np.arange(b.num_rows))
        real = np.ones(len(tok), bool)
        real[start] = real[start + 1] = False
        held.append((tok, np.flatnonzero(real)))
        size += len(tok)
        if size >= RUN_TOKENS:
            yield from cut()
            held, size = [], 0
    if held:
        yield from cut()


def _heavy(share: float):
    """Middle words that hold at least half of ``share`` of a run: a superset of those above ``share`` overall."""
    def run(batches):
        for tok, at in _runs(batches):
            w, n = vec.counts_of(tok[at - 1])
            big = n >= share / 2 * len(at)
            yield pa.record_batch([pa.array(np.r_[w[big].view(np.int64), -1]), pa.array(np.r_[n[big], len(at)])],
                                  ["word", "n"])
    return run


def _counts(bits: int, hot: np.ndarray):
    def rows(tok, at):
        voc, ids = np.unique(tok, return_inverse=True)
        if len(voc) >> LOCAL:              # more words than numbers
            half = len(at) // 2
            yield from rows(tok[:at[half]], at[:half])
            yield from rows(tok[at[half] - 2:], at[half:] - at[half] + 2)
            return
        ids = ids.astype(np.uint64)
        key = ids[at - 1] << _U(2 * LOCAL) | ids[at - 2] << _U(LOCAL) | ids[at]
        key.sort()
        head = _heads(key)
        n, key = np.diff(head, append=len(key)), key[head]
        mid, first, last = (((key >> _U(s)) & _U((1 << LOCAL) - 1)).astype(np.int64) for s in (2 * LOCAL, LOCAL, 0))
        for shard, own in _segments(np.arange(len(key)), deal(voc[mid], voc[last], hot, bits)):
            yield "gram", shard, pack_trigrams(voc, mid[own], first[own], last[own], n[own])

    def run(batches):
        for tok, at in _runs(batches):
            yield _batch(rows(tok, at))
            vec.release()
    return run


def _sums(at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Per group: total, and how many are 1, 2 and more."""
    return [np.add.reduceat(x, at, dtype=np.int64) if len(at) else NO_INT for x in (n, n == 1, n == 2, n > 2)]


def _ones(n: np.ndarray) -> list[int]:
    """How many counts are 1 to 4, their total, their number."""
    return [*(int(np.count_nonzero(n == i)) for i in (1, 2, 3, 4)), int(n.sum()), len(n)]


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct trigrams of the runs, sorted by middle, first and last word: word list, three columns, counts."""
    parts = [unpack_trigrams(x) for x in blobs]
    blobs.clear()
    voc = np.unique(np.concatenate([p[0] for p in parts]))
    b = _U(max(1, len(voc).bit_length()))
    mids = np.unique(np.concatenate([np.searchsorted(voc, p[0][p[1][_heads(p[1])]]) for p in parts]))
    wide = len(mids).bit_length() + 2 * int(b) > 64
    high, low, n = [], [], []
    while parts:
        words, mid, first, last, c = parts.pop()
        to = np.searchsorted(voc, words).astype(np.uint64)
        rank = np.searchsorted(mids, to).astype(np.uint64)
        high.append(rank[mid] << b | to[first])
        low.append(to[last])
        n.append(c.astype(np.uint32))
    high, low, n = np.concatenate(high), np.concatenate(low), np.concatenate(n)
    if wide:                               # number the contexts first
        contexts, high = np.unique(high, return_inverse=True)
        high = high.astype(np.uint64)
    key = high << b | low
    del high, low
    order = np.argsort(key)
    key, n = key[order], n[order]
    del order
    head = _heads(key)
    n = np.add.reduceat(n, head, dtype=np.int64)
    key = key[head]
    last, high = (key & ((_U(1) << b) - _U(1))).astype(np.int64), key >> b
    if wide:
        high = contexts[high.astype(np.int64)]
    return voc, mids[(high >> b).astype(np.int64)], (high & ((_U(1) << b) - _U(1))).astype(np.int64), last, n


def _short(words: np.ndarray) -> np.ndarray:
    return (words >> _U(24)).astype(np.uint32)


def _coded(name: str, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of one byte each; those of 255 or more by place in a side table."""
    big = np.flatnonzero(n >= 255)
    return {name: np.minimum(n, 255).astype(np.uint8), f"{name}_at": big.astype(np.uint32), f"{name}_big": n[big]}


def _coded_sums(name: str, sums: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of four sums as one byte each: a number in the table of the 255 commonest rows, others in a side table."""
    sums = np.stack(sums, 1)
    small = (sums < 1 << 16).all(1)
    key = (sums[:, 0] << 48 | sums[:, 1] << 32 | sums[:, 2] << 16 | sums[:, 3]).view(np.uint64)
    kinds, many = vec.counts_of(key[small])
    kinds = np.sort(kinds[np.argsort(-many, kind="stable")[:255]])
    code = np.full(len(sums), 255, np.uint8)
    if len(kinds):
        at = np.minimum(np.searchsorted(kinds, key), len(kinds) - 1)
        known = small & (kinds[at] == key)
        code[known] = at[known]
    rest = np.flatnonzero(code == 255)
    table = np.stack([(kinds >> _U(s)) & _U(65535) for s in (48, 32, 16, 0)], 1).astype(np.int64)
    return {name: code, f"{name}_table": table.reshape(-1), f"{name}_at": rest.astype(np.uint32),
            f"{name}_big": sums[rest].reshape(-1)}


def _merge(path: str, bits: int, hot: np.ndarray):
    """Write one shard's arrays; what other shards must add up goes on as rows."""
    def grams(shard, blobs):
        voc, mid, first, last, n = _merged(blobs)
        context, word = _heads(mid, first), _heads(mid)
        sums = _sums(context, n)
        raw = np.add.reduceat(n, word)
        two = mid.astype(np.uint64) << _U(32) | last.astype(np.uint64)
        two, left = vec.counts_of(two)
        two_mid, two_last = (two >> _U(32)).astype(np.int64), (two & _U(0xFFFFFFFF)).astype(np.int64)
        two_word = _heads(two_mid)
        own = _sums(two_word, left)
        words = voc[mid[word]]
        of_context = np.searchsorted(context, word)
        _store(path, f"gram-{shard}", {
            "word": words, "word_context": np.r_[of_context, len(context)].astype(np.uint32),
            "word_two": np.r_[two_word, len(two)].astype(np.uint32),
            **_coded("raw", raw), **_coded_sums("word_sums", own),
            "context": _short(voc[first[context]]), "context_start": context[::STEP].astype(np.uint32),
            **_coded_sums("context_sums", sums),
            "last": _short(voc[last]), **_coded("last_n", n),
            "two": _short(voc[two_last]), **_coded("two_n", left)})
        ends = int(n[voc[last] == END].sum())
        yield "stat3", shard, np.array([*_ones(n), ends], np.int64).tobytes()
        yield "stat2", shard, np.array([*_ones(left), 0], np.int64).tobytes()
        is_hot = _among(words, hot)
        for i in np.flatnonzero(is_hot):
            yield "hot", int(words[i]), np.array([*(s[i] for s in own), raw[i], 0, 0], np.int64).tobytes()
        mine = np.flatnonzero(is_hot[np.searchsorted(word, context, "right") - 1])
        key = pair(voc[mid[context[mine]]], voc[first[context[mine]]])
        for to, at in _segments(np.argsort(key), _shard(key, bits)):
            yield "context", to, _pack(key[at], *(s[mine[at]] for s in sums))
        followers, seen = vec.counts_of(two_last)
        for to, at in _segments(np.arange(len(followers)), _shard(voc[followers] << _U(8), bits)):
            yield "left", to, _pack(voc[followers[at]], seen[at])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, shard = (k.as_py() for k in key)
        blobs = [x.as_py() for x in table.column("data")]
        del table
        out = _batch(grams(shard, blobs) if kind == "gram" else _added(path, kind, shard, blobs))
        vec.release()
        return pa.Table.from_batches([out])
    return run


def _added(path: str, kind: str, shard: int, blobs: list[bytes]):
    """Sums over shards: contexts of hot middle words, predecessors of last words; other rows go on."""
    if kind not in ("context", "left"):
        yield from ((kind, shard, x) for x in blobs)
        return
    key, *sums = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    order = np.argsort(key)
    key = key[order]
    at = _heads(key)
    sums = [np.add.reduceat(s[order], at) for s in sums]
    if kind == "context":
        _store(path, f"context-{shard}", {"key": key[at], **_coded_sums("sums", sums)})
        yield "statc", shard, np.zeros(7, np.int64).tobytes()
    else:
        _store(path, f"left-{shard}", {"key": key[at], **_coded("n", sums[0])})
        yield "stat1", shard, np.array([*_ones(sums[0]), 0], np.int64).tobytes()


def _store(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that places each array, then the arrays, each at a multiple of 8 bytes."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    places, at = {}, 0
    for k, a in arrays.items():
        places[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    new = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as out:
        out.write(head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    fs.move(new, f"{root}/{name}")


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and the numbers that all shards share."""
    path: str
    bits: int
    total: int = 0                                     # predicted tokens of the training texts
    vocabulary: int = 0                                # distinct among them
    texts: int = 0                                     # end tokens among them
    counts: tuple[tuple[int, ...], ...] = ((0,) * 4,) * 3      # of each order how many counts are 1 to 4
    lowest: tuple[int, int, int, int] = (0, 0, 0, 0)   # of the empty context: total, and words seen after 1, 2, more
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 5), np.int64))   # as a context, and occurrences
    written: dict[str, np.ndarray] = field(default_factory=dict)   # shards that have a file, by kind
    order: int = 3


def folder(spark: SparkSession, name: str) -> str:
    """A fresh shared folder as a URI, by the file system that Spark takes for ``spark.checkpoint.dir``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, name))
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    return uri


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the texts of all rows (a null text counts as empty) and write the model's files."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(size / shard_bytes))) if size else 0
    hot = np.zeros(0, np.uint64)
    if bits:
        share = 0.5 / (1 << bits)
        heavy = texts.mapInArrow(_heavy(share), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        total = heavy.where("word = -1").first()["n"]
        rows = heavy.where((F.col("word") != -1) & (F.col("n") >= share / 2 * total)).collect()
        hot = np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))
    path = folder(spark, "trigrams")
    merge = _merge(path, bits, hot)
    rows = texts.mapInArrow(_counts(bits, hot), ROWS)
    parts = max(2 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(2):                     # about one shard a task, whatever the session's number of partitions
        rows = rows.repartition(parts, "kind", "shard").groupBy("kind", "shard").applyInArrow(merge, ROWS)
    got: dict[str, list] = {}
    for r in rows.collect():               # seven numbers a shard, and a hot word in a shard
        got.setdefault(r["kind"], []).append((r["shard"], np.frombuffer(r["data"], np.int64)))
    if "stat3" not in got:
        return Model(path, bits)
    one, two, three = (np.sum([x for _, x in got[k]], 0) for k in ("stat1", "stat2", "stat3"))
    hot_sums = np.zeros((len(hot), 5), np.int64)
    for w, x in got.get("hot", []):
        hot_sums[np.searchsorted(hot, _U(w))] += x[:5]
    written = {kind: np.sort(np.array([s for s, _ in got.get(k, [])], np.int64))
               for kind, k in (("gram", "stat3"), ("left", "stat1"), ("context", "statc"))}
    return Model(path, bits, int(three[4]), int(one[5]), int(three[6]),
                 tuple(tuple(int(i) for i in x[:4]) for x in (one, two, three)),
                 (int(one[4]), int(one[0]), int(one[1]), int(one[5] - one[0] - one[1])), hot, hot_sums, written)


# ---------------------------------------------------------------- look-ups

@lru_cache(maxsize=8)
def _opened(path: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped if the shared folder is a path here, else read; an absent file raises."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with open(f"{root}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with fs.open_input_file(f"{root}/{name}") as f:
            data = f.read()
    start = data.find(b"\n") + 1
    return {k: np.frombuffer(data, dtype, n, start + at) for k, (dtype, n, at) in json.loads(data[:start]).items()}


def _find(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the place of ``x`` in ``a[lo:hi]`` (ascending there), and whether it is there."""
    lo, end, hi = lo.astype(np.int64), hi, hi.astype(np.int64)
    on = np.flatnonzero(lo < hi)
    while len(on):
        mid = (lo[on] + hi[on]) >> 1
        less = a[mid] < x[on]
        lo[on[less]] = mid[less] + 1
        hi[on[~less]] = mid[~less]
        on = on[lo[on] < hi[on]]
    hit = np.flatnonzero(lo < end)
    found = np.zeros(len(lo), bool)
    found[hit] = a[lo[hit]] == x[hit]
    return lo, found


def _count(f: dict, name: str, at: np.ndarray) -> np.ndarray:
    out = f[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = f[f"{name}_big"][np.searchsorted(f[f"{name}_at"], at[big])]
    return out


def _sums_at(f: dict, name: str, at: np.ndarray) -> np.ndarray:
    """Rows of four sums."""
    code = f[name][at]
    out = np.zeros((len(at), 4), np.int64)
    few = code < 255
    out[few] = f[f"{name}_table"].reshape(-1, 4)[code[few]]
    if not few.all():
        out[~few] = f[f"{name}_big"].reshape(-1, 4)[np.searchsorted(f[f"{name}_at"], at[~few])]
    return out


def _starts(f: dict, at: np.ndarray) -> np.ndarray:
    """First entry of each context: the nearest stored start before it and the lengths from there."""
    out = f["context_start"][at // STEP].astype(np.int64)
    for back in range(1, STEP):
        on = np.flatnonzero(at % STEP >= back)
        out[on] += _sums_at(f, "context_sums", at[on] - back)[:, 1:].sum(1)
    return out


def _by_shard(model: Model, kind: str, shard: np.ndarray):
    """Each shard that has a file, opened, with its rows of ``shard``."""
    for s, at in _segments(np.arange(len(shard)), shard):
        if _among(np.array([s]), model.written.get(kind, NO_INT))[0]:
            yield _opened(model.path, f"{kind}-{s}"), at


def _whole(f: dict, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(f[name], x), len(f[name]) - 1)
    return at, f[name][at] == x


def _unigrams(model: Model, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and continuation counts of words."""
    raw, left = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    shard = _shard(w << _U(8), model.bits)
    for f, at in _by_shard(model, "left", shard):
        place, hit = _whole(f, "key", w[at])
        left[at[hit]] = _count(f, "n", place[hit])
    is_hot = _among(w, model.hot)
    for f, at in _by_shard(model, "gram", shard):
        at = at[~is_hot[at]]
        place, hit = _whole(f, "word", w[at])
        raw[at[hit]] = _count(f, "raw", place[hit])
    raw[is_hot] = model.hot_sums[np.searchsorted(model.hot, w[is_hot]), 4]
    raw[w == END] = model.texts
    return raw, left


def _higher(model: Model, first: np.ndarray, mid: np.ndarray, last: np.ndarray):
    """Counts of trigrams and of their last two words, and the sums of the contexts (first, mid) and mid."""
    n = len(mid)
    three, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
    of_two, of_one = np.zeros((n, 4), np.int64), np.zeros((n, 4), np.int64)
    for f, at in _by_shard(model, "gram", deal(mid, last, model.hot, model.bits)):
        word, hit = _whole(f, "word", mid[at])
        at, word = at[hit], word[hit]
        of_one[at] = _sums_at(f, "word_sums", word)
        place, hit = _find(f["two"], f["word_two"][word], f["word_two"][word + 1], _short(last[at]))
        two[at[hit]] = _count(f, "two_n", place[hit])
        place, hit = _find(f["context"], f["word_context"][word], f["word_context"][word + 1], _short(first[at]))
        at, place = at[hit], place[hit]
        of_two[at] = _sums_at(f, "context_sums", place)
        start = _starts(f, place)
        place, hit = _find(f["last"], start, start + of_two[at, 1:].sum(1), _short(last[at]))
        three[at[hit]] = _count(f, "last_n", place[hit])
    hot = np.flatnonzero(_among(mid, model.hot))
    if len(hot):
        of_one[hot] = model.hot_sums[np.searchsorted(model.hot, mid[hot]), :4]
        key = pair(mid[hot], first[hot])
        of_two[hot] = 0
        for f, at in _by_shard(model, "context", _shard(key, model.bits)):
            at = at[np.argsort(key[at])]
            place, hit = _whole(f, "key", key[at])
            of_two[hot[at[hit]]] = _sums_at(f, "sums", place[hit])
    return three, two, of_two, of_one


def _mixed(count: np.ndarray, sums: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated probability; the lower order's own where the context is unknown."""
    total = np.maximum(sums[:, 0], 1)
    p = np.maximum(count - d[np.minimum(count, 3)], 0) / total + sums[:, 1:] @ d[1:] / total * lower
    return np.where(sums[:, 0] > 0, p, lower)


def probabilities(model: Model, discount: list, first: np.ndarray, mid: np.ndarray, last: np.ndarray):
    """Probability of each last word after the two others, and how often the last word occurs."""
    d = [np.array([0.0, *x]) for x in discount]
    voc, ids = np.unique(np.concatenate([first, mid, last]), return_inverse=True)
    first, mid, last = ids.reshape(3, -1)
    words, slot = np.unique(last, return_inverse=True)
    raw, left = _unigrams(model, voc[words])
    base = np.full(len(words), 1.0 / (model.vocabulary + 1))
    uni = _mixed(left, np.tile(np.array(model.lowest, np.int64), (len(words), 1)), d[0], base)
    order = np.lexsort((last, first, mid))
    head = _heads(mid[order], first[order], last[order])
    each = order[head]
    three, two, of_two, of_one = _higher(model, voc[first[each]], voc[mid[each]], voc[last[each]])
    p = _mixed(three, of_two, d[2], _mixed(two, of_one, d[1], uni[slot[each]]))
    out = np.empty(len(order))
    out[order] = np.repeat(p, np.diff(head, append=len(order)))
    return out, raw[slot]
