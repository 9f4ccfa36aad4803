"""Run queries against their DuckDB oracle: ``python tools/check.py [-s sf] [key ...]``."""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import suite  # noqa: E402
from suite.fixtures import BASE_TABLES  # noqa: E402


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("merchloom-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "as_integer_ratio"):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((str(k), _norm(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return True, f"rows-only {len(got)} rows", spent
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want_cols, want = _rows(cols, res.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", spent
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else []
        lack = [r for r in want if r not in set(got)][:3] if len(want) < 20000 else []
        return False, f"rows {len(got)} vs {len(want)}\n   spark only {str(extra)[:900]}\n   oracle only {str(lack)[:900]}", spent
    return True, f"{len(got)} rows", spent


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", "--sf", default="0.01")
    ap.add_argument("-m", "--module", default=None)
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    if args.module:
        suite._MODULES = tuple(f"suite.{m}" for m in args.module.split(","))
    queries, oracles = suite.all_queries(), suite.all_oracles()
    keys = args.keys or list(queries)
    spark = session()
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = []
    for key in keys:
        try:
            ok, note, spent = compare(spark, con, key, queries[key], oracles.get(key), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, spent = False, 0.0
            lines = traceback.format_exc().splitlines()
            note = "\n".join([str(exc)[:1500], *lines[-4:]])[:2500]
        if not ok:
            bad.append(key)
        print(f"{'ok  ' if ok else 'FAIL'} {key:32s} {spent:6.2f}s {note}", flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} ok; failing: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
