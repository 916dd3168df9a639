"""Runs registered queries beside their SQL checks and reports differences.

usage: python tools/check.py [folder] [name ...]
"""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duskboard.plans.registry import oracle_sql, queries  # noqa: E402
from duskboard.session import local_session  # noqa: E402
from duskboard.sources.views import BASE_TABLES  # noqa: E402


def canon(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    checks = oracle_sql()
    bad = []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            cols = sorted(df.columns)
            got = canon([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SPARK-ERROR {name}: {str(e)[:700]}", flush=True)
            continue
        spent = time.time() - start
        if name not in checks:
            print(f"rows-only   {name} rows={len(got)} {spent:.1f}s", flush=True)
            continue
        try:
            rel = con.execute(checks[name])
            duck_cols = [d[0] for d in rel.description]
            order = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
            want = canon([tuple(r[i] for i in order) for r in rel.fetchall()])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SQL-ERROR   {name}: {str(e)[:700]}", flush=True)
            continue
        same = got == want and cols == sorted(duck_cols)
        took = time.time() - start - spent
        print(f"{'ok' if same else 'DIFF':11s} {name} rows={len(got)}/{len(want)} spark={spent:.1f}s sql={took:.1f}s", flush=True)
        if not same:
            bad.append(name)
            print("   cols", cols, sorted(duck_cols))
            left = [r for r in got if r not in set(want)][:4]
            right = [r for r in want if r not in set(got)][:4]
            for r in left:
                print("   spark", r)
            for r in right:
                print("   sql  ", r)
    print("failing:", bad)
    return len(bad)


if __name__ == "__main__":
    del hashlib
    sys.exit(min(main(), 1))
