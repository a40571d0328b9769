"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and written with the middle last.

Texts stay UTF-8 bytes. A sparse exception index (:class:`runs.CharIndex`) holds
the multibyte characters' positions and excess bytes only; cuts between tokens
are found in bytes and told in code points, cuts between code points are turned
into bytes, each by one ``searchsorted``; ASCII spans are plain arithmetic.

The two cuts and the form depend on a seed and the row's id alone, so a task that
runs again writes the same rows. The job is map-only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .registry import llm_query
from .runs import CharIndex, gap_table, string_array
from .tables import load

SEED = 42
MARKS = ("<P>", "<S>", "<M>")
FIM_PERCENT = 50
SPM_PERCENT = 80
SPACE = gap_table([(9, 13), (32, 32)])


def token_ends(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte ends of all tokens (white space and the word after it; white space at a text's end) of a block."""
    solid = ~SPACE[buf]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    tails = offs[1:][np.diff(offs) > 0] - 1
    end[tails] = True
    return np.flatnonzero(end) + 1


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers per id: the first 8-digit groups of the hex SHA-256 of ``seed:id`` (a null id: nothing after ``:``)."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def _cut(seed: int, unit: str, fim: int, spm: int, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(batches):
        for b in vec.blocks(batches):
            buf, offs = vec.utf8(vec.strings(b.column("text")))
            data, index, h = buf.tobytes(), CharIndex(buf), draws(b.column("id").to_pylist(), seed)
            head, tail = offs[:-1], offs[1:]
            base = index.chars(offs)
            if unit == "token":
                ends = token_ends(buf, offs)
                first = np.searchsorted(ends, offs, "right")
                n = np.diff(first)
            else:
                n = np.diff(base)
            ab = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            if unit == "token":
                ends = np.r_[0, ends]
                cut = np.where(ab > 0, ends[first[:-1, None] + ab], head[:, None])
                char = index.chars(cut)
            else:
                char = base[:-1, None] + ab
                cut = index.bytes(char)
            form, out, texts = [], [], zip(head.tolist(), tail.tolist(), cut.tolist(), strict=True)
            for (a, z, (x, y)), (_, _, h3, h4) in zip(texts, h.tolist(), strict=True):
                text = data[a:z]
                if not text or h3 % 100 >= fim or p in text or s in text or m in text:
                    form.append("plain")
                    out.append(text)
                elif h4 % 100 < spm:
                    form.append("spm")
                    out.append(b"".join((s, data[y:z], p, data[a:x], m, data[x:y])))
                else:
                    form.append("psm")
                    out.append(b"".join((p, data[a:x], s, data[y:z], m, data[x:y])))
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.record_batch(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(char[:, 0] - base[:-1], pa.int64(), mask=plain),
                 pa.array(char[:, 1] - char[:, 0], pa.int64(), mask=plain), string_array(out)],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: str = "token", fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    ``unit`` is ``token`` or ``char``. The form is ``plain`` (the text as it is,
    no lengths) for empty texts, for texts that hold a mark and for the share
    that the draw leaves; else ``spm`` or ``psm``. A null text counts as empty, a
    null id as no digits. Equal ids are cut alike, repeated rows each give a row;
    a long text is one Arrow value and is cut whole; an empty table gives no row;
    other columns are left out, so their names cannot clash.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit must be token or char")
    if len(set(marks)) != 3 or not all(x[:1] == "<" and "<" not in x[1:] for x in marks):
        raise ValueError("marks must differ and have '<' in front and nowhere else")   # then none begins inside another
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_cut(seed, unit, fim_percent, spm_percent, marks),
                        f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
            .withColumnRenamed("id", id_col))


def restored(output: F.Column, form: F.Column, marks: tuple[str, str, str] = MARKS) -> F.Column:
    """The text of which ``output`` was made, from the output and its form alone."""
    part = F.split(output, "|".join("\\Q" + x + "\\E" for x in marks), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1]))
            .otherwise(output))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
         ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
         greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
              ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@llm_query("op11_fill_in_middle", SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged, with digests of the output and of the text rebuilt from it."""
    rows = fill_in_middle(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
