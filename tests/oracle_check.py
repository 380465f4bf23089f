"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Mirrors the correctness gate: row count, column names, and an order-insensitive
hash of the values with columns sorted by name.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from pairshift.session import build_session  # noqa: E402
from pairshift.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(oracle_sql())
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, ors = queries(), oracle_sql()
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            t1 = time.time()
            if n not in ors:
                print(f"{n:28s} rows={len(srows)} (no oracle) spark={t1 - t0:.1f}s")
                continue
            res = con.execute(ors[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            t2 = time.time()
            hs, ls = digest(scols, srows)
            hd, ld = digest(dcols, drows)
            ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols) and hs == hd
            print(f"{n:28s} {'OK ' if ok else 'BAD'} rows={len(srows)}/{len(drows)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s")
            if not ok:
                bad += 1
                if sorted(scols) != sorted(dcols):
                    print("   cols spark:", sorted(scols))
                    print("   cols duck :", sorted(dcols))
                else:
                    ss, dd = set(ls), set(ld)
                    print("   spark-only:", [x[:600] for x in sorted(ss - dd)[:2]])
                    print("   duck-only :", [x[:600] for x in sorted(dd - ss)[:2]])
        except Exception as e:  # report and continue
            bad += 1
            print(f"{n:28s} ERROR {type(e).__name__}: {str(e)[:400]}")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
