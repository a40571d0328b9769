"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A document's ids (and an end id) are cut into pieces of at most ``capacity``.
A full piece is a sequence of its own. The others, longest first, are placed one
by one: among the open bins and a new bin, take the one after which the sum over
residual gaps of (number of open bins with that gap)^2 is smallest; on ties the
tightest. Only the counts per gap matter, so a step costs the same however many
bins are open.

Pieces are packed in groups of about ``GROUP`` pieces, dealt by a row number of
the written piece table (so no key makes a group large). The rule keeps some
bins of every gap open to the end; the pieces of all groups' open bins are dealt
anew into groups of the same size, packed once more, and what is then still open
is laid tightest-fit into bins. Tokens never move: groups see (row, length).
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .pretokens import Encoder
from .registry import llm_query
from .tables import load, write_table

CAPACITY = 1024
GROUP = 1 << 16
END_ID = 2
TEXT_BLOCK = 1 << 20      # bytes of text encoded at once (or one text)
NEVER = 1 << 60


def vocabulary() -> str:
    """Default place of the tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full, only the first may be shorter."""
    if total <= capacity:
        return [total]
    head = total % capacity
    return ([head] if head else []) + [capacity] * (total // capacity)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        encoder = _encoder(path)
        for b in vec.blocks(batches, limit=TEXT_BLOCK):
            ids, counts = encoder.encode(vec.strings(b.column("text")).to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            row, piece, start, length, crc, at = [], [], [], [], [], 0
            for i, total in enumerate((counts + 1).tolist()):
                done = 0
                for k, size in enumerate(cut_lengths(total, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(done)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at + done:at + done + size]))
                    done += size
                at += total
            yield pa.record_batch([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                                   pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                                   pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32`` (null text: empty)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(path or vocabulary(), capacity, end_id),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths, capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths`` (each 1 to ``capacity``), placed in the given order."""
    bins: list[list[int]] = []
    held: list[list[int]] = [[] for _ in range(capacity + 1)]   # open bins by gap
    leave = np.full(capacity + 1, NEVER, np.int64)              # change of the sum when a bin leaves a gap ...
    leave[capacity] = 0                                         # ... (a new bin leaves none)
    enter = np.ones(capacity + 1, np.int64)                     # ... and when it enters one; a full bin counts nowhere
    enter[0] = 0
    for i, size in enumerate(lengths):
        gap = size + int((leave[size:] + enter[:capacity + 1 - size]).argmin())
        if gap == capacity:
            bins.append([i])
            b = len(bins) - 1
        else:
            b = held[gap].pop()
            bins[b].append(i)
            n = len(held[gap])
            leave[gap], enter[gap] = (1 - 2 * n if n else NEVER), 2 * n + 1
        gap -= size
        if gap:
            held[gap].append(b)
            n = len(held[gap])
            leave[gap], enter[gap] = 1 - 2 * n, 2 * n + 1
    return bins


def tightest(lengths, capacity: int) -> list[list[int]]:
    """Bins filled in the given order, each item into the open bin that it leaves the smallest gap in."""
    bins: list[list[int]] = []
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    some[capacity] = True
    for i, size in enumerate(lengths):
        gap = size + int(some[size:].argmax())
        if gap == capacity:
            bins.append([i])
            b = len(bins) - 1
        else:
            b = held[gap].pop()
            bins[b].append(i)
            some[gap] = bool(held[gap])
        gap -= size
        if gap:
            held[gap].append(b)
            some[gap] = True
    return bins


def _place(capacity: int, final: bool):
    """Packs one group of ``row, length``; without ``final``, open bins' rows get a null sequence."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        row, length = (table.column(c).to_numpy() for c in ("row", "length"))
        order = np.lexsort((row, -length))
        row, length = row[order], length[order]
        sizes = length.tolist()
        bins = sum_of_squares(sizes, capacity)
        full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
        rest = sorted(i for b in bins if sum(sizes[i] for i in b) < capacity for i in b)
        if final:
            full += [[rest[i] for i in b] for b in tightest([sizes[i] for i in rest], capacity)]
            rest = []
        seq = np.full(len(row), -1, np.int64)
        offset = np.zeros(len(row), np.int64)
        base = int(key[0].as_py()) << 32
        for k, b in enumerate(full):
            at = 0
            for i in b:
                seq[i], offset[i] = base + k, at
                at += sizes[i]
        return pa.table({"row": pa.array(row), "length": pa.array(length),
                         "seq": pa.array(seq, mask=seq < 0), "offset": pa.array(offset)})
    return run


def _packed(items: DataFrame, salt: int, capacity: int, final: bool) -> DataFrame:
    groups = -(-items.count() // GROUP) or 1
    return (items.withColumn("g", F.expr(f"pmod(xxhash64(row, {salt}), {groups})"))
            .groupBy("g").applyInArrow(_place(capacity, final), "row long, length long, seq long, offset long"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces`` (``length`` from 1 to ``capacity``) with ``sequence_id, offset``.

    Every row is placed once, repeated rows too; places in a sequence are gapless
    from 0. An empty table gives no row. ``pieces`` may not have columns named
    sequence_id, offset or _row.
    """
    clash = {"sequence_id", "offset", "_row"} & set(pieces.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    pieces = write_table(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    items = pieces.where(F.col("length") < capacity).select(F.col("_row").alias("row"), "length")
    once = write_table(_packed(items, 1, capacity, False), "pack-first")
    closed = once.where("seq is not null").select("row", F.expr("seq * 4").alias("seq"), "offset")
    again = _packed(once.where("seq is null").select("row", "length"), 2, capacity, True).select(
        "row", F.expr("seq * 4 + 1").alias("seq"), "offset")
    placed = closed.unionByName(again)
    full = pieces.where(F.col("length") >= capacity).select(
        "*", F.expr("_row * 4 + 2").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = (pieces.where(F.col("length") < capacity)
            .join(placed, pieces["_row"] == placed["row"])
            .select(*[pieces[c] for c in pieces.columns], F.col("seq").alias("sequence_id"), "offset"))
    return full.unionByName(part).drop("_row")


@llm_query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_pieces(cut_pieces(load(spark, sf_dir, "documents")))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' pieces and their places in sequences.

    A null or empty text is one piece, its end id; a long one many; repeated rows
    each have their pieces; a null id stays null; further columns are left out;
    an empty table gives no row.
    """
    return pack_pieces(cut_pieces(docs))
