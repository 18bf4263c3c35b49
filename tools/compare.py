"""Run registered queries against their SQL in an in-process DuckDB and report differences.

    python tools/compare.py [--sf DIR] [--only substring ...] [--module name] [--split]

``--split`` forces the plan for large groups in every cross-sectional operator.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog.registry import load_all  # noqa: E402
from crosspanel.operators import cross  # noqa: E402
from crosspanel.session import drop_tables, local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", nargs="*", default=[])
    ap.add_argument("--module")
    ap.add_argument("--show", type=int, default=3)
    ap.add_argument("--split", action="store_true")
    args = ap.parse_args()
    if args.split:
        cross.WINDOW_ROWS = -1
    entries = load_all()
    con = duckdb.connect()
    for t in TABLES:
        path = f"{args.sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    spark = local_session(8, "compare")
    spark.sparkContext.setLogLevel("OFF")
    bad = []
    slow = []
    for name, e in entries.items():
        if args.only and not any(o in name for o in args.only):
            continue
        if args.module and e.module != f"catalog.{args.module}":
            continue
        try:
            start = time.time()
            df = e.run(spark, args.sf)
            got = df.collect()
            took = time.time() - start
            drop_tables(spark)
            slow.append((took, name))
            if e.sql is None:
                print(f"rows-only {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            t0 = time.time()
            cur = con.execute(e.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            ora = time.time() - t0
            if sorted(cols) != sorted(df.columns):
                bad.append(name)
                print(f"COLUMNS {name}: spark={sorted(set(df.columns) - set(cols))} sql={sorted(set(cols) - set(df.columns))}", flush=True)
                continue
            a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
            nulls = [c for i, c in enumerate(df.columns) if got and all(r[i] is None for r in got)]
            if a == b:
                note = "" if len(got) else " EMPTY"
                print(f"ok {name}: {len(got)} rows {took:.1f}s sql {ora:.1f}s{note}{' ALLNULL ' + str(nulls) if nulls else ''}", flush=True)
            else:
                bad.append(name)
                sa, sb = set(a), set(b)
                print(f"DIFF {name}: spark {len(a)} rows, sql {len(b)} rows; only-spark {len(sa - sb)}, only-sql {len(sb - sa)}")
                names = sorted(cols)
                differ = [n for i, n in enumerate(names) if sorted(x[i] for x in a) != sorted(x[i] for x in b)]
                print("  differing columns", differ, "of", names if len(names) < 12 else len(names))
                if len(names) >= 12:
                    pick = [i for i, n in enumerate(names) if n in ("date", "ticker") or n in differ]
                    sa, sb = {tuple(x[i] for i in pick) for x in sa}, {tuple(x[i] for i in pick) for x in sb}
                    sa, sb = sa - sb, sb - sa
                for x in sorted(sa - sb)[: args.show]:
                    print("  spark", x)
                for x in sorted(sb - sa)[: args.show]:
                    print("  sql  ", x, flush=True)
        except Exception as ex:  # noqa: BLE001
            bad.append(name)
            msg = str(ex)
            print(f"ERROR {name}: {type(ex).__name__} {msg[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(slow)} run, bad: {bad}")
    print("slowest:", [(n, round(t, 1)) for t, n in sorted(slow, reverse=True)[:8]])
    spark.stop()


if __name__ == "__main__":
    main()
