"""Compare registered queries with their SQL oracle in DuckDB: row count, column names, sorted value multiset."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(df, con, sql):
    names = sorted(df.columns)
    rows = sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(got) != names:
        return f"columns differ: spark={names} sql={sorted(got)}"
    idx = [got.index(n) for n in names]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in raw)
    if rows != want:
        a, b = [x for x in rows if x not in set(want)][:3], [x for x in want if x not in set(rows)][:3]
        return f"rows spark={len(rows)} sql={len(want)} cols={names}\n   spark-only={a}\n   sql-only={b}"
    types = [f"{n}:{t}" for n, t in df.dtypes]
    del types
    return f"ok {len(rows)}"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from estatelens.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in q:
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            df = q[name](spark, sf)
            res = compare(df, con, o[name]) if name in o else f"rows-only {df.count()}"
        except Exception as ex:  # noqa: BLE001
            res = "FAIL " + str(ex)[:400]
        flag = "" if res.startswith("ok") or res.startswith("rows-only") else "  <<<<<<"
        bad += bool(flag)
        print(f"{name:42s} {time.time()-t:6.2f}s {res}{flag}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
