"""Bucket hash (T1) and character n-gram expansion (T2) as Spark expressions.

The hash is 64-bit FNV-1a over the UTF-8 bytes, reduced modulo the bucket
count. Spark longs are signed and ANSI mode forbids overflow, so the 64-bit
state is kept as two 32-bit halves in longs and the multiply by the FNV prime
(2^40 + 435) is split accordingly:

    x   = lo XOR byte
    lo' = (x * 435) & M
    hi' = (hi * 435 + ((x * 435) >> 32) + (x << 8)) & M,  M = 2^32 - 1

and ``h mod B = ((hi mod B) * (2^32 mod B) + lo) mod B``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# FIXED VALUES: FNV-1a 64 offset basis (as 32-bit halves) and prime factors.
FNV_OFFSET_HI = 0xCBF29CE4
FNV_OFFSET_LO = 0x84222325
FNV_PRIME_LOW = 435          # prime = 2^40 + 435
MASK32 = 0xFFFFFFFF
DEFAULT_BUCKETS = 500_000


def utf8_bytes(s: Column) -> Column:
    """array<long> of the UTF-8 bytes of ``s`` (empty for the empty string)."""
    hx = F.hex(F.encode(s, "UTF-8"))
    n = (F.length(hx) / 2).cast("int")
    seq = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    arr = F.transform(seq, lambda i: F.conv(F.substring(hx, i * 2 + 1, 2), 16, 10).cast("long"))
    return F.when(n > 0, arr).otherwise(F.array().cast("array<long>"))


def _fnv_step(acc: Column, b: Column) -> Column:
    m = F.lit(MASK32).cast("long")
    x = acc["lo"].bitwiseXOR(b)
    xp = x * F.lit(FNV_PRIME_LOW)
    lo = xp.bitwiseAND(m)
    hi = (acc["hi"] * F.lit(FNV_PRIME_LOW) + F.shiftright(xp, 32) + F.shiftleft(x, 8)).bitwiseAND(m)
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def _code_points(s: Column) -> Column:
    """array<long> of the code points of ``s`` (``ascii`` gives a character's code point)."""
    n = F.length(s)
    cps = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: F.ascii(F.substring(s, i, 1)).cast("long"))
    return F.when(n > 0, cps).otherwise(F.array().cast("array<long>"))


def fnv1a64_state(s: Column) -> Column:
    """struct(hi, lo): the 64-bit FNV-1a state after all UTF-8 bytes of ``s``.

    Folds over code points and feeds each one's 1-4 UTF-8 bytes (computed
    arithmetically) into the FNV step, so no per-byte string work is needed.
    """
    init = F.struct(F.lit(FNV_OFFSET_HI).cast("long").alias("hi"),
                    F.lit(FNV_OFFSET_LO).cast("long").alias("lo"))

    def b(cp, shift, mask, lead):
        return F.lit(lead) + F.shiftright(cp, shift).bitwiseAND(F.lit(mask))

    def step(acc, cp):
        one = _fnv_step(acc, cp)
        two = _fnv_step(_fnv_step(acc, b(cp, 6, 0x1F, 0xC0)), b(cp, 0, 0x3F, 0x80))
        three = _fnv_step(_fnv_step(_fnv_step(acc, b(cp, 12, 0x0F, 0xE0)), b(cp, 6, 0x3F, 0x80)),
                          b(cp, 0, 0x3F, 0x80))
        four = _fnv_step(_fnv_step(_fnv_step(_fnv_step(acc, b(cp, 18, 0x07, 0xF0)), b(cp, 12, 0x3F, 0x80)),
                                   b(cp, 6, 0x3F, 0x80)), b(cp, 0, 0x3F, 0x80))
        return (F.when(cp < 0x80, one).when(cp < 0x800, two).when(cp < 0x10000, three).otherwise(four))

    return F.aggregate(_code_points(s), init, step)


def fnv1a64_hex(s: Column) -> Column:
    """The 64-bit hash as 16 upper-case hex digits (for checks)."""
    st = fnv1a64_state(s)
    return F.concat(F.lpad(F.hex(st["hi"]), 8, "0"), F.lpad(F.hex(st["lo"]), 8, "0"))


def bucket(s: Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    """``fnv1a64(s) mod buckets`` (unsigned), as a long.

    As a single expression the state is inlined twice (hi and lo); in
    DataFrame code prefer ``with_bucket``, which computes the state once.
    """
    return bucket_from_state(fnv1a64_state(s), buckets)


def bucket_from_state(st: Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    b = F.lit(buckets).cast("long")
    two32 = F.lit((1 << 32) % buckets).cast("long")
    return F.pmod(F.pmod(st["hi"], b) * two32 + st["lo"], b)


def with_bucket(df, gram_col: str, out: str = "bucket", buckets: int = DEFAULT_BUCKETS):
    """Add ``out`` = bucket of ``gram_col``.

    The hash state is a one-element array that a generator opens: it is computed
    once per row, and no later filter or expression is moved before it (a plain
    column would be repeated wherever the bucket is used).
    """
    one = F.transform(F.array(fnv1a64_state(F.col(gram_col))),
                      lambda st: F.struct(bucket_from_state(st, buckets).alias(out)))
    return df.select("*", F.inline(one))


FULL_TOKEN = rf"^__{P.W}+__$"


def _sub_of(w: Column, n: int):
    return lambda i: F.substring(w, i, n)


def _grams_for_n(w: Column, n: int) -> Column:
    empty = F.array().cast("array<string>")
    grams = F.when(F.length(w) > n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), _sub_of(w, n))) \
        .otherwise(empty)
    whole = F.when(F.length(w) != n + 1, F.array(w)).otherwise(empty)
    return F.concat(grams, whole)


def word_ngrams(w: Column, min_n: int, max_n: int) -> Column:
    """N-grams of one word for n in min..max, distinct, first-seen order.

    For each n: every n-gram when the word is longer than n, then the word
    itself unless its length is n + 1. Placeholder words ``__x__`` stay whole.
    """
    if min_n > max_n:
        raise ValueError("min_n must not exceed max_n")
    parts = [_grams_for_n(w, n) for n in range(min_n, max_n + 1)]
    out = F.array_distinct(F.flatten(F.array(*parts)))
    return F.when(w.rlike(FULL_TOKEN), F.array(w)).otherwise(out)
