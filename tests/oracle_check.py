"""Local twin of the driver's correctness gate: run a query in Spark and its
oracle SQL in DuckDB on the same parquet tables; compare row count, column
names and an order-insensitive hash of the rounded values."""

from __future__ import annotations

import hashlib
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factloom.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con, verbose=True):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None}
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and hs == hd
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "match": ok}
    if not ok and verbose:
        out["spark_cols"], out["duck_cols"] = sorted(s_cols), sorted(d_cols)
        a, b = set(ls), set(ld)
        out["only_spark"] = sorted(a - b)[:3]
        out["only_duck"] = sorted(b - a)[:3]
    return out


if __name__ == "__main__":
    import json
    import time

    from factloom.session import get_spark

    import __spark_entry__ as E

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = get_spark("local[8]", 8)
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf)
    for n in (names or sorted(qs)):
        t = time.time()
        try:
            r = compare(spark, n, qs[n], oracle.get(n), sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        r["sec"] = round(time.time() - t, 2)
        print(json.dumps(r, default=str), flush=True)
