"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

White space is written as the marker U+2581, with one marker before the text.
Among all ways to cut a text into pieces the one with the largest sum of log
scores is taken (on ties the longer piece comes last); a character that no piece
covers costs ``UNKNOWN`` below the least score and is written as its UTF-8 bytes'
pieces. Decoding joins the pieces, turns markers into blanks and drops the first.
A marker that stands in the text itself is written as bytes, so that decoding
always gives the text back.

The vocabulary file orders its pieces by merge rank and holds no probabilities;
the log scores are those of Zipf's law over that order.

No piece has a marker after another character (checked when the vocabulary is
read), so a text falls into units (markers, then other characters) that are cut
independently. A worker cuts every distinct unit once; the units of a block go
through the trie together, position by position, as arrays.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .pretokens import IdPool
from .registry import llm_query
from .tables import load

MARK = "▁"
UNKNOWN = 10.0
NO_CODE = 0
LITERAL_MARK = 0x110000
_U = np.uint64


def vocabulary() -> str:
    """Default place of the vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArray:
    """Trie of code sequences: a node's child for code c is ``base[node] + c`` if ``check`` there names the node."""

    def __init__(self, keys: list[tuple[int, ...]], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values, strict=True):
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = v
        top = max((max(x) for x in children if x), default=0)
        size = 2 * (top + len(children)) + 2
        base, check, out = (np.full(size, f, np.int32) for f in (0, -1, -1))
        check[0] = 0                         # the root's place
        place, low = {0: 0}, 1
        todo = [0]
        for node in todo:                    # parents before children
            codes = sorted(children[node])
            if not codes:
                continue
            while check[low] >= 0:
                low += 1
            arr = np.array(codes)
            at, span = max(low, codes[0] + 1), 1024
            while True:                      # the first free slot at which all children find room
                if at + span + top >= len(check):
                    base, check, out = (np.r_[x, np.full(span + len(x), f, np.int32)]
                                        for x, f in ((base, 0), (check, -1), (out, -1)))
                slots = at + np.flatnonzero(check[at:at + span] < 0)
                fits = slots[(check[slots[:, None] + (arr - codes[0])] < 0).all(1)]
                if len(fits):
                    b = int(fits[0]) - codes[0]
                    break
                at, span = at + span, span * 2
            here = place[node]
            base[here] = b
            for c in codes:
                child = children[node][c]
                check[b + c] = here
                out[b + c] = value[child]
                place[child] = b + c
                todo.append(child)
        last = int(np.flatnonzero(check >= 0)[-1]) + 1
        fit = lambda x, f: np.r_[x[:last], np.full(top + 1, f, np.int32)]
        self.base, self.check, self.value = fit(base, 0), fit(check, -1), fit(out, -1)


@dataclass
class Vocabulary:
    pieces: list[str]
    score: np.ndarray          # log score of each id that Viterbi may use
    byte_id: np.ndarray        # id of each byte's piece
    code: np.ndarray           # trie code of each code point, 0 if in no piece
    trie: DoubleArray
    deepest: int

    @staticmethod
    def build(pieces: dict[int, tuple[str, float]], byte_id: list[int], size: int) -> Vocabulary:
        """From normal pieces (id -> text, log score), the ids of the 256 byte pieces and the number of ids."""
        for text, _ in pieces.values():
            if MARK in text.lstrip(MARK):
                raise ValueError(f"piece {text!r} has a marker after another character")
        often: dict[str, int] = {}
        for text, _ in pieces.values():
            for ch in text:
                often[ch] = often.get(ch, 0) + 1
        code = np.zeros(LITERAL_MARK + 1, np.int32)
        for i, ch in enumerate(sorted(often, key=lambda x: (-often[x], x))):
            code[ord(ch)] = i + 1
        keys = sorted((tuple(code[ord(c)] for c in text), i) for i, (text, _) in pieces.items())
        names = [""] * size
        score = np.zeros(size + 1)
        for i, (text, s) in pieces.items():
            names[i], score[i] = text, s
        score[size] = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN
        return Vocabulary(names, score, np.array(byte_id, np.uint32), code,
                          DoubleArray([k for k, _ in keys], [i for _, i in keys]),
                          max((len(t) for t, _ in pieces.values()), default=0))

    def decode_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, where each begins and how many it has."""
        data = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_id):
            data[i] = bytes([b])
        size = np.array([len(d) for d in data], np.int64)
        return np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size, size


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> Vocabulary:
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    byte_id = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    rank = sorted(normal, key=lambda i: (-m.get_score(i), i))
    total = np.log(sum(1 / (r + 2) for r in range(len(rank))))
    return Vocabulary.build({i: (m.id_to_piece(i), -float(np.log(r + 2)) - float(total)) for r, i in enumerate(rank)},
                            byte_id, n)


def viterbi(v: Vocabulary, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of each unit, one after another (``len(v.pieces)`` for an uncovered character), and their number."""
    unknown = len(v.pieces)
    order = np.argsort(-size, kind="stable")
    start, length = start[order], size[order]
    node0 = np.cumsum(length + 1) - (length + 1)           # a unit of n characters has n + 1 nodes
    best = np.full(int((length + 1).sum()), -np.inf)
    best[node0] = 0.0
    via, back = np.full(len(best), -1, np.int32), np.zeros(len(best), np.int32)
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest + 1), "left")    # units with more than i characters
    for i in range(longest):
        unit = np.arange(alive[i])
        here = best[node0[unit] + i]
        state = np.zeros(len(unit), np.int64)
        for d in range(1, v.deepest + 1):
            at = start[unit] + i + d - 1
            c = codes[at]
            nxt = v.trie.base[state].astype(np.int64) + c
            ok = (c > 0) & (v.trie.check[nxt] == state) & (nxt > 0)
            if d == 1:
                piece = np.where(ok, v.trie.value[nxt], -1)
                edge = np.where(piece >= 0, piece, unknown)
            else:
                unit, here, nxt = unit[ok], here[ok], nxt[ok]
                edge = v.trie.value[nxt]
            cand = here + v.score[edge]
            to = node0[unit] + i + d
            better = (edge >= 0) & (cand > best[to])
            t = to[better]
            best[t], via[t], back[t] = cand[better], edge[better], d
            if d == 1:
                unit, here, nxt = unit[ok], here[ok], nxt[ok]
            more = length[unit] > i + d
            unit, here, state = unit[more], here[more], nxt[more]
            if not len(unit):
                break
    # Walk all units back together; pieces come out last first.
    pos, who = length.copy(), np.arange(len(length))
    outs, whos = [], []
    who = who[pos[who] > 0]
    while len(who):
        at = node0[who] + pos[who]
        outs.append(via[at])
        whos.append(order[who])
        pos[who] -= back[at]
        who = who[pos[who] > 0]
    if not outs:
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    piece, owner = np.concatenate(outs), np.concatenate(whos)
    step = np.repeat(np.arange(len(outs)), [len(x) for x in outs])
    by = np.lexsort((-step, owner))
    return piece[by].astype(np.int64), np.bincount(owner, minlength=len(size))


class PieceEncoder:
    """Ids of blocks of texts; keeps the ids of units met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known = IdPool()
        self.salt = vec.constants(LITERAL_MARK + 1, 51)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        raw = [(" " + t).encode("utf-32-le") if t else b"" for t in texts]
        width = np.array([len(r) for r in raw], np.int64) // 4
        cp = np.frombuffer(b"".join(raw), np.uint32)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        blank = cp == 32
        cp = np.where(blank, ord(MARK), np.where(cp == ord(MARK), LITERAL_MARK, cp))
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        heads = (np.cumsum(width) - width)[width > 0]
        begins[heads] = True
        start = np.flatnonzero(begins)
        size = np.diff(start, append=len(cp))
        pos = np.arange(len(cp)) - np.repeat(start, size)
        p = vec.powers(int(size.max()) + 1)
        h = vec.mix(np.add.reduceat(self.salt[cp] * p[pos], start))

        def fresh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, count = viterbi(self.v, self.v.code[cp], start[at], size[at])
            bad = np.flatnonzero(ids == len(self.v.pieces))
            if not len(bad):
                return ids, count
            return self._bytes(ids, count, bad, cp, start[at])
        ids, per = self.known.ids(h, fresh)
        total = np.r_[0, np.cumsum(per)]
        bounds = np.searchsorted(start, np.cumsum(width))
        return ids, np.diff(np.r_[0, total[bounds]])

    def _bytes(self, ids, count, bad, cp, start):
        """Uncovered characters written as their bytes' pieces."""
        chars = np.array([len(x) for x in self.v.pieces] + [1])
        ends = np.cumsum(count)
        unit = np.searchsorted(ends, bad, "right")
        done = np.cumsum(chars[ids]) - chars[ids]                     # characters before each piece
        first = done[(ends - count)[unit]]
        place = start[unit] + done[bad] - first
        new = [self.v.byte_id[list((MARK if c == LITERAL_MARK else chr(c)).encode())] for c in cp[place].tolist()]
        grown = np.array([len(x) for x in new])
        out_size = np.ones(len(ids), np.int64)
        out_size[bad] = grown
        out = np.repeat(ids, out_size)
        at = np.repeat((np.cumsum(out_size) - out_size)[bad], grown) + np.arange(grown.sum()) - np.repeat(
            np.cumsum(grown) - grown, grown)
        out[at] = np.concatenate(new)
        extra = np.bincount(unit, grown - 1, len(count)).astype(np.int64)
        return out, count + extra


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of id lists given one after another; bytes that are no UTF-8 become U+FFFD."""
    data, at, size = v.decode_table()
    n = size[ids]
    ends = np.cumsum(n)
    flat = data[np.repeat(at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    total = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
    out = []
    for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True):
        t = flat[a:b].decode("utf-8", "replace")
        out.append(t[1:] if t[:1] == " " else t)
    return out


_ENCODERS: dict[str, PieceEncoder] = {}      # a worker's, by the vocabulary's place


def _encode(path: str, shared):
    def run(batches):
        e = _ENCODERS.get(path)
        if e is None:
            e = _ENCODERS[path] = PieceEncoder(shared.value)
        for b in vec.blocks(batches):
            texts = vec.strings(b.column("text")).to_pylist()
            ids, counts = e.encode(texts)
            is_byte = np.zeros(len(e.v.pieces), bool)
            is_byte[e.v.byte_id] = True
            cut = np.cumsum(counts)
            crc = [zlib.crc32(x.astype("<u4")) for x in np.split(ids, cut[:-1])] if len(counts) else []
            owner = np.repeat(np.arange(len(counts)), counts)
            back = [x == y for x, y in zip(decode(e.v, ids, counts), texts, strict=True)]
            yield pa.record_batch(
                [b.column("id"), pa.array(counts, pa.int64()), vec.list_array(ids.astype(np.int32), counts, pa.int32()),
                 pa.array(crc, pa.int64()), pa.array(np.bincount(owner, is_byte[ids], len(counts)).astype(np.int64)),
                 pa.array(back, pa.bool_())], ["id", "n_ids", "ids", "ids_crc32", "n_bytes", "decodes"])
    return run


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_ids, ids, ids_crc32, n_bytes, decodes``.

    ``n_bytes`` counts byte pieces, ``decodes`` tells whether decoding the ids gives
    the text back. A null text counts as empty; an empty text has no ids. Repeated
    rows each get a row, null ids stay null, an empty table gives no row; other
    columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    path = path or vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))   # as large as the vocabulary
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_encode(path, shared), f"id {kind}, n_ids long, ids array<int>, ids_crc32 long, "
                                                       "n_bytes long, decodes boolean")
            .withColumnRenamed("id", id_col))


def _decode(shared):
    def run(batches):
        v = shared.value
        for b in batches:
            lists = b.column("ids")
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
            texts = decode(v, np.asarray(lists.flatten()), counts)
            yield pa.record_batch([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])
    return run


def decode_pieces(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` of lists of ids; a null list gives an empty text."""
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path or vocabulary()))
    return (rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(_decode(shared), f"id {kind}, text string").withColumnRenamed("id", id_col))


@llm_query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and whether they decode to the text."""
    return encode_pieces(load(spark, sf_dir, "documents"))
