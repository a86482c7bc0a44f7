"""Compare registered queries with their SQL in DuckDB.

Usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows(cols: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from provenir.catalog import ORACLES, QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    picked = [n for n in QUERIES if not a.names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in a.names)]
    for n in picked:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, a.sf)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: spark {type(e).__name__} {str(e)[:900]}", flush=True)
            continue
        t1 = time.time()
        if n not in ORACLES:
            print(f"rows {n}: {len(got)} rows {t1 - t0:.1f}s {df.dtypes if not got else got[0]}"[:300], flush=True)
            continue
        try:
            cur = con.execute(ORACLES[n])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {n}: duckdb {str(e)[:700]}", flush=True)
            continue
        t2 = time.time()
        sc = df.columns
        if sorted(sc) != sorted(cols):
            bad += 1
            print(f"FAIL {n}: columns {sorted(sc)} vs {sorted(cols)}", flush=True)
            continue
        x, y = rows(sc, got), rows(cols, want)
        kinds = {k: (v, types[k]) for k, v in df.dtypes}
        odd = {k: v for k, v in kinds.items() if not _alike(*v)}
        if x == y and not odd:
            print(f"ok   {n}: {len(x)} rows spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s", flush=True)
        else:
            bad += 1
            sx, sy = set(map(repr, x)), set(map(repr, y))
            diff = [sorted(sx - sy)[:2], sorted(sy - sx)[:2], len(sx - sy)]
            print(f"FAIL {n}: {len(x)} vs {len(y)} rows, {diff[2]} differ, types {odd}\n   {sorted(cols)}\n   {diff[0]}\n   {diff[1]}"[:1500], flush=True)
    print("bad", bad, "of", len(picked))
    return 1 if bad else 0


def _alike(s: str, d: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    return pairs.get(s) == d


if __name__ == "__main__":
    sys.exit(main())
