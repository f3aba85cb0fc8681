"""Run registered queries and their SQL twins side by side on one scale.

usage: python tools/compare.py [sf or folder] [key ...]   (@name stands for a catalog module)
"""

from __future__ import annotations

import glob
import importlib
import math
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return str(v)


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(rec[i]) for i in order) for rec in records), key=repr)


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith(("sf0", "/")):
        first = args.pop(0)
        sf = first if first.startswith("/") else f"/root/testdata/{first}"
    wanted = args
    base = importlib.import_module("gridloom.plans.catalog.base")
    importlib.import_module("gridloom.plans.catalog").load()
    areas = {a[1:] for a in wanted if a.startswith("@")}
    keys = [k for k, fn in base.QUERIES.items() if fn.__module__.rsplit(".", 1)[-1] in areas]
    keys += [a for a in wanted if not a.startswith("@")]
    keys = keys or list(base.QUERIES)
    spark = session()
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = base.QUERIES[key](spark, sf)
            got = [tuple(x) for x in df.collect()]
        except Exception as e:
            bad += 1
            print(f"FAIL {key}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if key not in base.SQL:
            print(f"rows {key}: {len(got)} rows {took:.2f}s {df.columns} {got[:2]}", flush=True)
            continue
        try:
            cur = con.execute(base.SQL[key])
            names = [c[0] for c in cur.description]
            ref = cur.fetchall()
        except Exception as e:
            bad += 1
            print(f"FAIL {key}: sql {str(e)[:800]}", flush=True)
            continue
        a, b = rows(got, df.columns), rows(ref, names)
        ok = sorted(df.columns) == sorted(names) and a == b
        nulls = sum(v is None for row in a for v in row)
        note = f"{len(a)} rows, {nulls} nulls, {took:.2f}s"
        if ok:
            print(f"ok   {key}: {note}", flush=True)
        else:
            bad += 1
            diff = [(p, q) for p, q in zip(a, b) if p != q]
            print(f"DIFF {key}: {note} vs {len(b)}; {sorted(df.columns)} vs {sorted(names)}; {len(diff)} {diff[:3]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
