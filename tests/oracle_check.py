"""Run registered queries against their DuckDB SQL (row count, columns, values).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    return v


def compare(spark_df, con, sql: str):
    """(ok, message): same columns, same multiset of rows."""
    pdf = spark_df.toPandas()
    odf = con.execute(sql).fetchdf()
    sc, oc = sorted(pdf.columns), sorted(odf.columns)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    if len(pdf) != len(odf):
        return False, f"rows differ: spark={len(pdf)} oracle={len(odf)}"

    def rows(df):
        out = [tuple(_norm(v) for v in rec) for rec in df[sc].astype(object).itertuples(index=False)]
        return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))

    a, b = rows(pdf), rows(odf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(a)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from lagwise.session import get_spark
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    failures = 0
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sql:
                ok, msg = compare(df, con, sql[name])
            else:
                ok, msg = True, f"rows-only {df.count()}"
        except Exception as e:  # report and go on
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:300]}"
        failures += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t:6.1f}s {msg}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
