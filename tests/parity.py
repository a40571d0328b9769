"""Spark vs DuckDB oracle parity, the way the driver checks it.

Usage: python tests/parity.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pagesieve.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, q, sf_dir):
    t0 = time.time()
    sdf = q.fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if q.sql is None:
        return {"name": q.name, "rows": len(srows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    rel = con.sql(q.sql)
    dcols = rel.columns
    drows = rel.fetchall()
    t2 = time.time()
    res = {"name": q.name, "rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sorted(scols) != sorted(dcols):
        res["error"] = f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}"
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        in_a, in_b = set(a), set(b)
        diff_a = [r for r in a if r not in in_b][:3]
        diff_b = [r for r in b if r not in in_a][:3]
        res["error"] = f"values differ: spark_only={diff_a} duck_only={diff_b}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from pagesieve.plans.registry import load_all
    from pagesieve.session import get_spark
    spark = get_spark()
    con = duck(sf_dir)
    reg = load_all()
    bad = 0
    for name, q in sorted(reg.items()):
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if "error" in r:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
