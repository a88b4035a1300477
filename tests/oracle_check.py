"""Compare registered Spark queries with their DuckDB SQL twins.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's gate: row count, column names, and an order-insensitive
hash of the values (columns sorted by name).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from presswire.session import build_session
    spark = build_session()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or sorted(qs)):
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        if name not in sql:
            print(f"rows {name}: {len(srows)} rows (no oracle) {time.time() - t:.1f}s")
            continue
        try:
            res = con.execute(sql[name])
            dcols = [c[0] for c in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        if ok_cols and len(srows) == len(drows) and hs == hd:
            print(f"ok   {name}: {len(srows)} rows {time.time() - t:.1f}s")
        else:
            bad += 1
            print(f"FAIL {name}: cols {scols} vs {dcols}; rows {len(srows)} vs {len(drows)}")
            diff_s = [x for x in ls if x not in set(ld)][:3]
            diff_d = [x for x in ld if x not in set(ls)][:3]
            print("   spark-only:", [x[:300] for x in diff_s])
            print("   duck-only: ", [x[:300] for x in diff_d])
    print("bad", bad)


if __name__ == "__main__":
    main()
