"""Run registered queries and their SQL twins side by side.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}", seconds
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    sql_s = time.time() - start
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", seconds
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    notes = [
        f"{n}: {t} vs {dict(zip(names, types))[n]}"
        for n, t in df.dtypes
        if kinds.get(t, t.replace("array<double>", "DOUBLE[]").replace("array<bigint>", "BIGINT[]").replace("array<int>", "INTEGER[]").replace("array<string>", "VARCHAR[]")) != dict(zip(names, types))[n]
    ]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    note = f"{len(a)} rows, sql {sql_s:.1f}s" + (f", TYPES {notes}" if notes else "")
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{len(a)} vs {len(b)} rows; cols {sorted(names)}; first differences {str(diff)[:700]} {note}", seconds
    return not notes, note, seconds


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--root", default="/root/testdata")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{args.root}/sf{args.sf}"
    con = connect(folder)
    fns, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in fns.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        try:
            ok, note, seconds = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as error:  # report and go on
            ok, note, seconds = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:28s} {seconds:6.2f}s  {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
