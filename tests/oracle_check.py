"""Compare every registered Spark query with its DuckDB oracle.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Rows are compared as sorted multisets of normalised tuples; doubles must
match exactly (NaN equals NaN), like an order-insensitive value hash.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return ("~none",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", v)
    if isinstance(v, decimal.Decimal):
        return ("f", float(v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, dt.datetime):
        return ("ts", v.replace(tzinfo=None))
    if isinstance(v, dt.date):
        return ("d", v)
    return ("s", str(v))


def compare(spark, con, name, spark_df, sql):
    t0 = time.time()
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
        return problems, len(s_rows), t1 - t0, t2 - t1
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sn = sorted(tuple(norm(r[i]) for i in si) for r in s_rows)
    dn = sorted(tuple(norm(r[i]) for i in di) for r in d_rows)
    if len(sn) != len(dn):
        problems.append(f"rows spark={len(sn)} duck={len(dn)}")
    if sn != dn:
        diffs = [(a, b) for a, b in zip(sn, dn) if a != b][:3]
        problems.append(f"values differ (cols {order}): {diffs}")
    return problems, len(s_rows), t1 - t0, t2 - t1


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from fundflow.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        if name not in sqls:
            print(f"{name:40s} (no oracle)")
            continue
        try:
            problems, n, ts, td = compare(spark, con, name, fn(spark, sf_dir), sqls[name])
        except Exception as exc:  # report and keep going
            problems, n, ts, td = [f"ERROR {type(exc).__name__}: {str(exc)[:400]}"], -1, 0, 0
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name:40s} rows={n:6d} spark={ts:5.2f}s duck={td:5.2f}s", flush=True)
        for pr in problems:
            print("      ", pr[:1500], flush=True)
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
