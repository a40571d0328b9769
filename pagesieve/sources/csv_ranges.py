"""Quoted CSV read in byte ranges.

A line break inside quotes does not end a record, so a range cannot tell by itself
whether it begins inside quotes. Two passes over the same ranges settle it:

1. each range reports the parity of its quotes and whether a record would begin
   in it, should it begin inside quotes; running parities over the ranges of a
   file (a row a range) then say how each really begins, and which range holds
   the beginning of a record that it continues;
2. each range cuts its lines into records. Its whole records are final; a first
   and last part of records that cross a range's end are put together by the
   range in which they begin.

Doubled quotes leave the parity alone, so the cut is exact for every file whose
fields with quotes or line breaks are quoted. Bytes that are not UTF-8 become U+FFFD, blank lines are left out, a
carriage return before a record's end is dropped. A record whose number of fields
or whose quoting is wrong goes to the quarantine with its place; a quote that is
never closed makes the rest of its file one such record.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_shared

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
_RANGE = "file string, start long, odd int, inside_starts boolean"
_PIECE = "file string, start long, line long, part string, owner long, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.make_valid_utf8("value").alias("text")))


def _spans(batch: pa.RecordBatch):
    """(file, start, first row, end row) of each run of rows of one range."""
    files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
    a = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or (files[i], starts[i]) != (files[a], starts[a]):
            yield files[a], starts[a], a, i
            a = i


def _quotes_before(text: pa.Array, odd: int):
    """Parity of the quotes before each line, ``odd`` of them before the first; and after the last."""
    n = pc.count_substring(text, '"').to_numpy(zero_copy_only=False)
    total = n.cumsum() + odd
    return (total - n) % 2, int(total[-1] % 2)


def _survey(batches):
    """One row per range: parity of its quotes, and whether a line of it follows an odd number of them."""
    seen: dict[tuple, list] = {}
    for b in batches:
        text = b.column("text")
        for file, start, a, z in _spans(b):
            held = seen.setdefault((file, start), [0, False])
            before, held[0] = _quotes_before(text.slice(a, z - a), held[0])
            held[1] = held[1] or bool(before.any())
    rows = [(*k, *v) for k, v in seen.items()]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                           enumerate((pa.string(), pa.int64(), pa.int32(), pa.bool_()))],
                          ["file", "start", "odd", "inside_starts"])


class _Cutter:
    """Records of the consecutive lines of one range; the open one is kept between batches."""

    def __init__(self, file, start, inside, owner):
        self.file, self.start, self.owner, self.odd = file, start, owner, inside
        self.line, self.open = 0, (0, "head", []) if inside else None

    def lines(self, text: pa.Array):
        before, self.odd = _quotes_before(text, self.odd)
        at = (before == 0).nonzero()[0]
        first = int(at[0]) if len(at) else len(text)
        if first and self.open:
            self.open[2].extend(text.slice(0, first).to_pylist())
        if len(at):
            yield from self.close("whole")
            ends = pa.array([*at.tolist(), len(text)], pa.int32())
            records = pc.binary_join(pa.ListArray.from_arrays(ends, text.cast(pa.string())), "\n")
            for i, r in zip(at[:-1].tolist(), records.slice(0, len(at) - 1).to_pylist(), strict=True):
                yield self.row(self.line + i, "whole", r)
            self.open = (self.line + int(at[-1]), "tail", text.slice(int(at[-1])).to_pylist())
        self.line += len(text)

    def close(self, part="tail"):
        """The open record: whole if a new one begins or the range ends outside quotes, but for the head."""
        if self.open:
            line, kind, texts = self.open
            yield self.row(line, "head" if kind == "head" else part, "\n".join(texts))
            self.open = None

    def row(self, line, part, text):
        owner = {"whole": None, "tail": self.start, "head": self.owner}[part]
        return self.file, self.start, line, part, owner, text


def _rows(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                           ["file", "start", "line", "part", "owner", "text"])


def _cut(batches):
    now = None
    for b in batches:
        rows, text = [], b.column("text")
        for file, start, a, z in _spans(b):
            if now is None or (now.file, now.start) != (file, start):
                if now is not None:
                    rows.extend(now.close("tail" if now.odd else "whole"))
                inside, owner = b.column("inside")[a].as_py(), b.column("owner")[a].as_py()
                if inside is None:
                    raise RuntimeError("the ranges of the files changed between two passes")
                now = _Cutter(file, start, inside, owner)
            rows.extend(now.lines(text.slice(a, z - a)))
        yield _rows(rows)
    if now is not None:
        yield _rows(list(now.close("tail" if now.odd else "whole")))


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``file, start, line, text``: each record with the range and the line in it where it begins.

    With ``header`` each file's first record is left out. The records are written once to the shared
    folder; the table of ranges, broadcast, has one row per
    ``spark.sql.files.maxPartitionBytes`` at most.
    """
    ranges = _lines(spark, path).mapInArrow(_survey, _RANGE)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    begins = F.when((F.col("inside") == 0) | F.col("inside_starts"), F.col("start"))
    ranges = ranges.select("file", "start", "inside", F.max(begins).over(before).alias("owner"))
    pieces = _lines(spark, path).join(F.broadcast(ranges), ["file", "start"], "left").mapInArrow(_cut, _PIECE)
    pieces = write_shared(pieces, "csv-records")
    whole = pieces.where(F.col("part") == "whole").select("file", "start", "line", "text")
    crossing = (pieces.where(F.col("part") != "whole").groupBy("file", "owner")
                .agg(F.max(F.when(F.col("part") == "tail", F.col("line"))).alias("line"),
                     F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
                .select("file", F.col("owner").alias("start"), "line", F.array_join("parts.text", "\n").alias("text")))
    records = whole.unionByName(crossing)
    if header:
        records = records.where((F.col("start") != 0) | (F.col("line") != 0))
    return records.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where(F.col("text") != "")


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType,
                    header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of ``schema`` (columns by position), and the quarantine: ``file, start, line, record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = csv_records(spark, path, header).withColumn(
        "_row", F.from_csv("text", full.simpleString()[7:-1].replace(":", " "), OPTIONS))
    wrong = F.col("_row._corrupt").isNotNull() | (F.regexp_count("text", F.lit('"')) % 2 == 1)
    good = parsed.where(~wrong).select(*[F.col(f"_row.`{f.name}`") for f in schema.fields])
    bad = parsed.where(wrong).select("file", "start", "line", F.col("text").alias("record"))
    return good, bad
