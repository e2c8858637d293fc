"""Run queries in Spark and their SQL in DuckDB on one folder and compare whole results.

    python tools/compare.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def kind(v):
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def compare(spark, con, name, check, folder):
    start = time.time()
    df = check.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if check.sql is None:
        return "ROWS", f"{len(got)} rows", took
    cur = con.execute(check.sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of(cols, want)
    if gc != wc:
        return "FAIL", f"columns {gc} vs {wc}", took
    if len(g) != len(w):
        return "FAIL", f"{len(g)} rows vs {len(w)}; first spark {g[:1]} sql {w[:1]}", took
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        diff = [(c, x, y) for c, x, y in zip(gc, *bad[0]) if x != y]
        return "FAIL", f"{len(bad)} rows differ, e.g. {diff} in {bad[0][0]}", took
    types = [(c, kind(x), kind(y)) for c, x, y in zip(gc, g[0], w[0]) if kind(x) != kind(y)] if g else []
    if types:
        return "TYPE", str(types), took
    return ("OK" if g else "EMPTY"), f"{len(g)} rows", took


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    from doorstep import build_session
    from doorstep.checks import load_all

    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                       "spark.driver.memory": os.environ.get("DRIVER_MEMORY", "8g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name, check in load_all().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            state, note, took = compare(spark, con, name, check, folder)
        except Exception as e:  # report and go on with the other queries
            state, note, took = "ERROR", str(e).split("JVM stacktrace")[0][:900], 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += state not in ("OK", "ROWS")
        print(f"{state:6}{took:7.2f}s {name}: {note}", flush=True)
    print(f"{failed} not ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
