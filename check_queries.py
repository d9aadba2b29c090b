"""Compare registered queries with their DuckDB SQL: ``python check_queries.py [sf] [name...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from vellumine.session import build_session
from vellumine.workload import load

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return tuple(canon(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat().split("+")[0]
    return value if isinstance(value, str) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in [n for n in queries if not args or any(n.startswith(a) for a in args)]:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            mine = rows_of(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:700]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(mine)} rows {took:.1f}s")
            continue
        start = time.time()
        try:
            cur = con.execute(oracles[name])
            theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
            cols = sorted(d[0] for d in cur.description)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle {str(e)[:700]}")
            bad += 1
            continue
        duck = time.time() - start
        if sorted(df.columns) != cols:
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {cols}")
            bad += 1
        elif mine != theirs:
            diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
            print(f"FAIL {name}: {len(mine)} vs {len(theirs)} rows, {len(diff)} differ; e.g.")
            for a, b in diff[:2]:
                for x, y in zip(a, b):
                    if x != y:
                        p = next((i for i, (c, d) in enumerate(zip(str(x), str(y))) if c != d), 0)
                        print("   ", repr(str(x)[max(0, p - 40) : p + 80]), "|", repr(str(y)[max(0, p - 40) : p + 80]))
            bad += 1
        else:
            print(f"ok   {name}: {len(mine)} rows spark {took:.1f}s duck {duck:.1f}s" + ("  EMPTY" if not mine else ""))
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
