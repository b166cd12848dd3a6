"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
Compares row count, column names and order-insensitive values (floats
rounded to 4 places), like the driver's correctness gate.
"""
from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))

from lotline.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 4)
    if isinstance(v, int):
        return round(float(v), 4)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat(sep=" ")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((str(k), _norm(x)) for k, x in v.items()))
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, name, q, sf_dir):
    t0 = time.time()
    df = q.build(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if not q.sql:
        return name, "rows-only", len(s_rows), None, t1 - t0
    rel = con.sql(q.sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return name, f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}", len(s_rows), len(d_rows), t1 - t0
    if len(s_rows) != len(d_rows):
        return name, "ROWCOUNT", len(s_rows), len(d_rows), t1 - t0
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        bad = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        return name, f"VALUES first diff {a[bad]} vs {b[bad]}", len(s_rows), len(d_rows), t1 - t0
    return name, "OK", len(s_rows), len(d_rows), t1 - t0


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    from lotline.plans.registry import load_all
    from lotline.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs = load_all()
    bad = 0
    for name, q in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            res = check(spark, con, name, q, sf_dir)
        except Exception as ex:  # report and continue
            res = (name, f"ERROR {type(ex).__name__}: {str(ex)[:300]}", None, None, 0)
            traceback.print_exc(limit=2)
        bad += res[1] not in ("OK", "rows-only")
        print(f"{res[0]:40s} {res[1][:400]:10s} spark={res[2]} duck={res[3]} {res[4]:.1f}s", flush=True)
    print(f"FAILED {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
