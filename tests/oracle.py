"""Runs registered queries against DuckDB on the same parquet files.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    from parafid.plans import catalog
    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if name not in catalog.ORACLES:
        return True, f"{len(got)} rows, no oracle, {t1 - t0:.1f}s"
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        only_s = [r for r in got if r not in set(want)][:2]
        only_d = [r for r in want if r not in set(got)][:2]
        return False, f"spark {len(got)} duck {len(want)} rows\n   spark only {str(only_s)[:900]}\n   duck only  {str(only_d)[:900]}"
    return True, f"{len(got)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
         .config("spark.sql.session.timeZone", "UTC").config("parafid.fixture.partitions", cores)
         .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


if __name__ == "__main__":
    from parafid.plans import catalog
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark, con, bad = session(), connect(sf), []
    for n in names:
        try:
            ok, info = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(("ok   " if ok else "FAIL ") + n + ": " + info, flush=True)
        bad += [] if ok else [n]
    print(f"{len(names) - len(bad)}/{len(names)} ok; failing: {bad}")
