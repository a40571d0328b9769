"""MinHash near-duplicate groups by a signature-coordinate inverted join.

1. Words, distinct five-word shingles and a 64-coordinate MinHash signature per
   text; texts with the same shingle set fall into one class.
2. Every class is posted under each of its (coordinate, value) tokens. Two sets
   of similarity 0.75 agree on 48 of 64 coordinates on average and on fewer than
   ``MATCHES`` = 32 with a probability of about 5e-6, so pairs with at least 32
   collisions are retained.
3. Prefix: in the order rarest token first, two classes with 32 common tokens
   share one among their first 33. Only these are posted; tokens that occur once
   count towards the 33 but are never joined, and the frequent tokens of passages
   that many texts share come last.
4. Skip merging: a pair found in any list is not counted through its other lists;
   its collisions are read off the two signatures at once.
5. Retained pairs are confirmed on their full shingle sets, exactly.

A list of n copies is not expanded into n*n rows. First each class is compared
with one member of its lists, the one whose tokens are the most frequent in all
(of a text and its edited copies usually the text), and the confirmed links are
joined into components. Then only pairs of different components are left. They
are compared list by list, in cells of two blocks of members, on sketches of 1024
bytes; a cell returns only pairs whose sketches agree so far that the sets can be
similar enough (a pair of similarity 0.75 fails with a probability of 5e-6). All
such pairs are confirmed on their sets, so no link between two components is
lost, whatever the size of a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .components import components
from .registry import llm_query
from .tables import free_name, load, write_table

WORDS = 5
COORDINATES = 64
MATCHES = 32
PERCENT = 75
SKETCH = 1024      # one-byte coordinates; a pair of similarity 0.75 agrees on 769 of them on average ...
AGREE = 708        # ... and on fewer than this with a probability of about 5e-6
CELL = 2048
_U = np.uint64
_A = vec.constants(COORDINATES, 11) | _U(1)
_B = vec.constants(COORDINATES, 12)
_STEP = vec.constants(WORDS, 13) | _U(1)
_SHORT = vec.constants(WORDS, 14)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending within a text, and their number per text.

    A text with fewer than five words has its whole sequence as one shingle; one
    without words has none.
    """
    w = vec.Words(texts)
    h = w.hashes()
    n_words = np.diff(w.first)
    values, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        full = w.doc[:m] == w.doc[WORDS - 1:]
        x = np.zeros(m, np.uint64)
        for i in range(WORDS):
            x += h[i:i + m] * _STEP[i]
        values, docs = vec.mix(x[full]), w.doc[:m][full]
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):
        x = _SHORT[n_words[short]].copy()
        for i in range(WORDS - 1):
            has = n_words[short] > i
            x[has] += h[w.first[short[has]] + i] * _STEP[i]
        values, docs = np.r_[values, vec.mix(x)], np.r_[docs, short]
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])]
        values, docs = values[new], docs[new]
    return values, np.bincount(docs, minlength=w.n_docs)


def _heads(counts: np.ndarray) -> np.ndarray:
    return (np.cumsum(counts) - counts)[counts > 0]


def _digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = np.zeros((2, len(counts)), np.uint64)
    if len(values):
        for i, salt in enumerate(vec.constants(2, 15)):
            out[i, counts > 0] = np.add.reduceat(vec.mix(values ^ salt), _heads(counts))
    return out[0].view(np.int64), out[1].view(np.int64)


def _signature(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One token per coordinate: 58 bits of the least hash, 6 bits of the coordinate's number."""
    sig = np.zeros(((counts > 0).sum(), COORDINATES), np.uint64)
    if len(values):
        at = _heads(counts)
        x = np.empty_like(values)
        for k in range(COORDINATES):
            np.bitwise_xor(values, _B[k], out=x)
            np.multiply(x, _A[k], out=x)
            sig[:, k] = np.minimum.reduceat(x, at)
    return ((sig >> _U(6) << _U(6)) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def _sign(batches):
    for b in vec.blocks(batches):
        values, counts = shingles(vec.strings(b.column("text")))
        d1, d2 = _digests(values, counts)
        sig = _signature(values, counts)
        yield pa.record_batch([b.column("id"), pa.array(counts, pa.int64()), pa.array(d1), pa.array(d2),
                               vec.list_array(sig.ravel(), np.where(counts > 0, COORDINATES, 0), pa.int64())],
                              ["id", "n", "d1", "d2", "sig"])


def _sets(bits: np.ndarray):
    """Shingle sets of the rows whose id is marked in ``bits`` (a superset of those needed)."""
    def run(batches):
        for b in batches:
            b = b.filter(pa.array(np.unpackbits(bits, bitorder="little")[_slot(b.column("id"), len(bits) * 8)] > 0))
            for c in vec.blocks([b]):
                values, counts = shingles(vec.strings(c.column("text")))
                d1, _ = _digests(values, counts)
                yield pa.record_batch([c.column("id"), pa.array(d1),
                                       vec.list_array(values.view(np.int64), counts, pa.int64())],
                                      ["id", "d1", "set"])
    return run


MARKS = 1 << 22   # bits of the bitmap of ids whose sets are needed: half a megabyte, whatever the input


_HIGH = 0x9E3779B1   # of a row key the high bits name its partition


def _slot(ids: pa.Array, size: int) -> np.ndarray:
    x = np.asarray(ids.fill_null(0)).astype(np.int64)
    return (x ^ ((x >> 33) * _HIGH)) & (size - 1)


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the ids' slots, put together from at most MARKS/32 words."""
    slots = ids.select(F.expr(f"(id ^ (shiftright(id, 33) * {_HIGH}L)) & {MARKS - 1}").alias("s"))
    words = (slots.select(F.shiftright("s", 5).alias("w"), F.expr("shiftleft(1L, cast(s & 31 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    bits = np.zeros(MARKS // 32, np.uint32)
    for w, b in words:
        bits[w] = b
    return bits.view(np.uint8)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links (itself included),
    ``kept`` marks the document that has it. Null text counts as empty; a text
    without words has no shingle and forms its own group. Ids are whole numbers;
    a null id never names a group that has another id, and stays if it is alone.
    Repeated rows each get a row. An empty table gives no row; other columns are
    left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = write_table(texts.mapInArrow(_sign, "id long, n long, d1 long, d2 long, sig array<long>"), "minhash-docs")
    classes = write_table(
        signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
    links = _links(texts, classes)
    comp = components(links)
    named = (classes.select("cid", "rep", "d1", "d2", "n").join(comp, "cid", "left")
             .withColumn("comp", F.coalesce("comp", "cid")))
    named = named.join(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp")
    out = (signed.select("id", "n", "d1", "d2")
           .join(named.select("d1", "d2", "n", "component_id"), ["d1", "d2", "n"], "left")
           .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _sized(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def _prefixes(classes: DataFrame) -> DataFrame:
    """Postings ``tok, cid, n, pop`` of the prefix of each class that can have a partner.

    ``pop`` is the total frequency of a class's tokens.
    """
    posts = classes.select("cid", "n", F.explode("sig").alias("tok"))
    often = posts.groupBy("tok").agg(F.count("*").alias("f")).where("f > 1")
    own = (posts.join(often, "tok").groupBy("cid", "n")
           .agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("toks"), F.sum("f").alias("pop"))
           .where(F.size("toks") >= MATCHES))
    first = COORDINATES - MATCHES + 1
    return own.select("cid", "n", "pop", F.explode(F.expr(
        f"slice(toks.tok, 1, {first} - ({COORDINATES} - size(toks)))")).alias("tok"))


def _links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links ``a, b`` that connect the same classes as all links do."""
    posts = write_table(_prefixes(classes), "minhash-postings")
    info = classes.join(posts.select("cid").distinct(), "cid", "left_semi").select("cid", "n", "rep", "d1", "sig")
    info = write_table(info, "minhash-candidates")
    bits = _marked(info.select(F.coalesce("rep", F.lit(0)).alias("id")))
    sets = write_table(
        texts.mapInArrow(_sets(bits), "id long, d1 long, set array<long>")
        .join(info.select("rep", F.col("d1").alias("d"), "cid"),
              F.col("id").eqNullSafe(F.col("rep")) & (F.col("d1") == F.col("d")))
        .select("cid", "set").dropDuplicates(["cid"]), "minhash-sets")

    hubs = posts.groupBy("tok").agg(F.max(F.struct("pop", F.expr("-cid").alias("c"), "n")).alias("m")).select(
        "tok", F.expr("-m.c").alias("b"), F.col("m.n").alias("nb"))
    stars = (posts.join(hubs, "tok").where("cid <> b and " + _sized("n", "nb"))
             .select(F.col("cid").alias("a"), "b").distinct())
    near = _collisions(stars, info).where(F.col("m") >= MATCHES)
    best = near.groupBy("a").agg(F.max(F.struct("m", F.expr("-b").alias("b"))).alias("x")).select(
        "a", F.expr("-x.b").alias("b"))
    links = write_table(_confirm(best, info, sets), "minhash-links")

    comp = components(links)
    now = posts.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    per = now.groupBy("tok", "comp").agg(F.count("*").alias("c"))
    lists = write_table(
        per.groupBy("tok").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("k"))
        .where("k > 1")
        .select("tok", F.col("m.comp").alias("main"), F.ceil(F.col("m.c") / CELL).cast("int").alias("mains"),
                F.ceil((F.col("c") - F.col("m.c")) / CELL).cast("int").alias("others"),
                (F.col("c") <= CELL).alias("small")), "minhash-lists")
    live = write_table(now.join(lists, "tok"), "minhash-live")
    prefix = posts.groupBy("cid").agg(F.collect_list("tok").alias("prefix"))
    sketch = (sets.join(live.select("cid").distinct(), "cid", "left_semi")
              .mapInArrow(_sketches, "cid long, sketch binary").join(prefix, "cid"))
    cells = (live.join(sketch, "cid").withColumn("c", F.explode(F.expr(_CELLS)))
             .select("tok", "c.cell", "c.side", "cid", "n", "comp", "sketch", "prefix"))
    pairs = cells.groupBy("tok", "cell").applyInArrow(_compare, "a long, b long")
    return links.unionByName(write_table(_confirm(pairs, info, sets), "minhash-links"))


# The cells of a posting: one for a list that fits in a cell, else pairs of blocks of which one holds
# members outside the list's largest component ("main"); a block's number comes from the class id. In a
# cell of two blocks, only members of different sides are compared.
_CELLS = """
case when small then array(struct('all' as cell, -1 as side))
     when comp = main then
       transform(sequence(0, others - 1),
                 i -> struct(concat(i, 'm', pmod(hash(cid), mains)) as cell, 0 as side))
     else concat(
       transform(sequence(0, mains - 1), j -> struct(concat(pmod(hash(cid), others), 'm', j) as cell, 1 as side)),
       transform(sequence(0, others - 1),
                 j -> struct(concat(least(j, pmod(hash(cid), others)), 'o', greatest(j, pmod(hash(cid), others))) as cell,
                             case when j = pmod(hash(cid), others) then -1 else pmod(hash(cid), others) end as side)))
end"""


def _sketches(batches):
    """One byte per coordinate: the low bits of the least hash."""
    mul, add = vec.constants(SKETCH, 16) | _U(1), vec.constants(SKETCH, 17)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            sets = b.column("set")
            counts = np.asarray(pa.compute.list_value_length(sets)).astype(np.int64)
            values = np.asarray(sets.flatten()).astype(np.int64).view(np.uint64)
            heads, out = _heads(counts), np.zeros((b.num_rows, SKETCH), np.uint8)
            x = np.empty_like(values)
            for k in range(SKETCH):
                np.bitwise_xor(values, add[k], out=x)
                np.multiply(x, mul[k], out=x)
                least = np.minimum.reduceat(x, heads)
                out[:, k] = (least * _U(0x9E3779B97F4A7C15) >> _U(56)).astype(np.uint8)
            yield pa.record_batch([b.column("cid"), pa.array([r.tobytes() for r in out], pa.binary())],
                                  ["cid", "sketch"])
        vec.release()


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of one cell, of different components and fitting sizes, whose sketches agree enough.

    A pair meets in the lists of all tokens that both post; only the list of the
    least of them returns it.
    """
    tok = key[0].as_py()
    cid, n, comp, side = (table.column(c).to_numpy() for c in ("cid", "n", "comp", "side"))
    order = np.lexsort((cid, n))
    cid, n, comp, side = cid[order], n[order], comp[order], side[order]
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(cid), SKETCH)[order]
    lists = table.column("prefix").combine_chunks()
    size = np.asarray(pa.compute.list_value_length(lists))
    none = np.iinfo(np.int64).max
    prefix = np.full((len(cid), COORDINATES - MATCHES + 1), none)
    prefix[np.arange(prefix.shape[1]) < size[:, None]] = np.asarray(lists.flatten())
    prefix = prefix[order]
    first = np.ascontiguousarray(sketch[:, :64])
    out_a, out_b = [], []
    for i in range(len(cid) - 1):
        # sizes ascend: partners are those up to 4/3 of this size
        j = np.arange(i + 1, int(np.searchsorted(n * PERCENT, n[i] * 100, "right")))
        j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] < 0) | (side[j] < 0))]
        if len(j):
            j = j[np.count_nonzero(first[j] == first[i], axis=1) >= MATCHES]
        if len(j):
            j = j[np.count_nonzero(sketch[j] == sketch[i], axis=1) >= AGREE]
        if len(j):
            both = np.isin(prefix[j], prefix[i][prefix[i] < none])
            j = j[np.where(both, prefix[j], none).min(1) == tok]
        if len(j):
            out_a.append(np.full(len(j), cid[i]))
            out_b.append(cid[j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _side(info: DataFrame, x: str, *cols: str) -> DataFrame:
    return info.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])


def _collisions(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """``a, b`` and the number ``m`` of equal coordinates."""
    both = pairs.join(_side(info, "a", "sig"), "a").join(_side(info, "b", "sig"), "b")
    return both.select("a", "b", F.size(F.array_intersect("sig_a", "sig_b")).alias("m"))


def _confirm(pairs: DataFrame, info: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``a, b`` those whose sets are similar enough."""
    both = pairs.join(_side(sets, "a", "set"), "a").join(_side(sets, "b", "set"), "b")
    counted = both.select("a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"),
                          F.size(F.array_intersect("set_a", "set_b")).alias("s"))
    return counted.where(f"100L * s >= {PERCENT}L * (na + nb - s)").select("a", "b")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
f AS (SELECT doc_id, n, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3,
        lead(x, 4) OVER o AS x4 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS MATERIALIZED (
  SELECT DISTINCT doc_id, concat_ws(' ', x, x1, x2, x3, x4) AS x FROM f WHERE x4 IS NOT NULL OR (n < 5 AND i = 0)),
n AS MATERIALIZED (
  SELECT doc_id, count(p.x) AS n FROM documents LEFT JOIN p USING (doc_id) GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT s.a, s.b FROM (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id) s
  JOIN n na ON na.doc_id = s.a JOIN n nb ON nb.doc_id = s.b
  WHERE 100 * s.c >= 75 * (na.n + nb.n - s.c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT walk.a, l.b FROM walk JOIN both_ways l ON walk.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(walk.b) AS component_id, n.doc_id = min(walk.b) AS kept
FROM n JOIN walk ON walk.a = n.doc_id GROUP BY n.doc_id, n.n
"""


@llm_query("op6_minhash_near_dedup", SQL)
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_groups(load(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group the row with the smallest id stays, null ids last.

    Rows are grouped under a row key of their own, written before it is used: a
    ``doc_id`` only orders the rows of a group, so unlike texts with null or equal
    ids all stay, and of rows with one id and alike texts the first stays. All columns
    of ``docs`` come back as they are, whatever their names; texts that are null or
    without words are never alike; an empty table stays empty.
    """
    key = free_name(docs.columns, "_row")
    numbered = write_table(docs.withColumn(key, F.monotonically_increasing_id()), "minhash-rows")
    groups = near_groups(numbered, key).select(F.col(key).alias("row"), F.col("component_id").alias("group"))
    rows = (numbered.select("doc_id", F.col(key).alias("row")).join(groups, "row")
            .groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
            .select(F.col("least.row").alias(key)))
    return numbered.join(rows, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
