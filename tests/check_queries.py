"""Run registered queries beside their SQL and compare the rows.

Usage: python tests/check_queries.py [sf] [name ...]
"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from fraudloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def open_duckdb(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "\\N"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    return str(v)


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return f"rows {len(got)}", spent, True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", spent, False
    a, b = canonical(got, df.columns), canonical(want, names)
    if a == b:
        return f"ok {len(a)}", spent, True
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"DIFF {len(a)} vs {len(b)} {diff} types {df.dtypes} / {[str(d[1]) for d in cur.description]}", spent, False


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in sys.argv[2:]):
            continue
        try:
            verdict, spent, ok = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            verdict, spent, ok = f"ERROR {type(e).__name__} {str(e)[:600]}", 0.0, False
        print(f"{name:32s} {spent:6.2f}s {verdict[:1500]}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
