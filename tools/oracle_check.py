"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name-substring ...]

Comparison mirrors the driver's gate: same column names (sorted), same row
count, and the same multiset of rows (values compared exactly; a second,
tolerant comparison is reported to tell rounding noise from real bugs).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from querylab.session import get_spark  # noqa: E402
from querylab.plans.registry import load_all  # noqa: E402
from querylab.tables import TABLE_NAMES  # noqa: E402


def norm(v, tol=False):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) if tol else v
    if isinstance(v, decimal.Decimal):
        return float(v) if not tol else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, tol) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, tol)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols, rows, tol=False):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i], tol) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_spark("local[8]", 8)
    reg = load_all()
    con = duck(a.sf)
    ok = bad = 0
    for name, spec in reg.items():
        if a.names and not any(s in name for s in a.names):
            continue
        t0 = time.time()
        try:
            df = spec.run(spark, a.sf)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if spec.sql is None:
            print(f"ROWS {name}: {len(s_rows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            cur = con.execute(spec.sql)
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(s_cols) != sorted(d_cols):
            print(f"FAIL {name}: columns spark={s_cols} duck={d_cols}")
            bad += 1
            continue
        exact = rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
        if exact:
            ok += 1
            print(f"OK   {name}: {len(s_rows)} rows {ts:.2f}s")
        else:
            tol = rows_of(s_cols, s_rows, True) == rows_of(d_cols, d_rows, True)
            bad += 1
            print(f"FAIL {name}: spark {len(s_rows)} rows vs duck {len(d_rows)} rows; tolerant-equal={tol}")
            sa, da = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
            print("   spark-only:", list((sa - da).items())[:3])
            print("   duck-only: ", list((da - sa).items())[:3])
    print(f"== {ok} ok, {bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
