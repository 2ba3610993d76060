"""Queries of the llm subpackage against their DuckDB texts: check_sql.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
from oracle import connect, rows_of, session  # noqa: E402


def compare(spark, con, name, sf_dir):
    from parafid.llm import catalog
    t0 = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if name not in catalog.ORACLES:
        return True, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    return got == want, f"{len(got)} and {len(want)} rows, {t1 - t0:.1f}s and {time.time() - t1:.1f}s {str(odd[:2])[:900]}"


if __name__ == "__main__":
    from parafid.llm import catalog
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    for n in sys.argv[2:] or list(catalog.QUERIES):
        print(n, *compare(spark, con, n, sf), flush=True)
