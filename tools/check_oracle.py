"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of the values
(floats rounded to 6 decimals), like the external correctness gate.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from marquee.plans.registry import load_all  # noqa: E402
from marquee.session import local_session  # noqa: E402
from marquee.sources.tables import TABLES, table_path  # noqa: E402


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12], lines


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    reg = load_all()
    spark = local_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    ok = bad = 0
    for name, (fn, sql) in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception:
            print(f"FAIL {name}: spark error\n{traceback.format_exc()[-2000:]}")
            bad += 1
            continue
        ts = time.time() - t0
        if sql is None:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            res = con.execute(sql)
            dcols = [c[0] for c in res.description]
            drows = res.fetchall()
        except Exception as e:
            print(f"FAIL {name}: duckdb error {e}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        same = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        if same:
            ok += 1
            print(f"ok   {name}: {len(srows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"DIFF {name}: spark {len(srows)} rows {sorted(scols)} | duck {len(drows)} rows {sorted(dcols)}")
            sd = [x for x in ls if x not in set(ld)][:3]
            dd = [x for x in ld if x not in set(ls)][:3]
            print("   spark-only:", [x[:300] for x in sd])
            print("   duck-only: ", [x[:300] for x in dd])
    print(f"ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
