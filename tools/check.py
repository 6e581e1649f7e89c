"""Run the named queries on Spark and DuckDB and compare all rows.

usage: python tools/check.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from corposcope.catalog import REGISTRY
from corposcope.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def norm(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, sf, q):
    start = time.time()
    df = q.build(spark, sf)
    left = canonical(df.columns, df.collect())
    spent = time.time() - start
    if q.sql is None:
        return spent, len(left[1]), None
    start = time.time()
    res = con.execute(q.sql)
    right = canonical([d[0] for d in res.description], res.fetchall())
    note = ""
    if left != right:
        note = f"MISMATCH columns {left[0]} / {right[0]} rows {len(left[1])} / {len(right[1])}"
        for a, b in zip(left[1], right[1]):
            if a != b:
                note += f"\n   spark {str(a)[:600]}\n   duck  {str(b)[:600]}"
                break
    return spent, len(left[1]), note + (f" (duckdb {time.time() - start:.1f}s)" if time.time() - start > 5 else "")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, q in REGISTRY.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            spent, rows, note = compare(spark, con, sf, q)
        except Exception as error:  # report and go on with the next query
            spent, rows, note = 0.0, -1, "ERROR " + "".join(traceback.format_exception_only(error))[:900]
        state = "rows-only" if note is None else ("ok" if not note.strip() or note.startswith(" (") else "BAD")
        bad += state == "BAD"
        print(f"{state:9} {name:32} {spent:6.2f}s {rows:7} {note or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
