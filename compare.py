"""Run registered queries against their reference SQL in DuckDB on one data folder.

Usage: python compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from listing_radar.queries import oracle_sql, queries
from listing_radar.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normalize(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(value):
        if value is None or value != value:
            return "NULL"
        if isinstance(value, bool):
            return str(value)
        try:
            return f"{float(value):.6g}" if not isinstance(value, str) else value
        except (TypeError, ValueError):
            return str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def main() -> None:
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    every, oracle, bad = queries(), oracle_sql(), []
    wanted = [n for n in every if not args[1:] or any(n.startswith(a) for a in args[1:])]
    for name in wanted:
        start = time.time()
        try:
            df = every[name](spark, folder)
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name}: spark: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            result = con.execute(oracle[name])
            names = [d[0] for d in result.description]
            expected = result.fetchall()
        except Exception as error:
            bad.append(name)
            print(f"FAIL {name}: duckdb: {str(error)[:500]}", flush=True)
            continue
        left, right = normalize(rows, df.columns), normalize(expected, names)
        if sorted(df.columns) != sorted(names):
            bad.append(name)
            print(f"DIFF {name}: columns {sorted(df.columns)} vs {sorted(names)}", flush=True)
        elif left != right:
            bad.append(name)
            only_left = sorted(set(left) - set(right))[:2]
            only_right = sorted(set(right) - set(left))[:2]
            print(f"DIFF {name}: {len(left)} vs {len(right)} rows\n   spark  {str(only_left)[:700]}\n   duckdb {str(only_right)[:700]}", flush=True)
        else:
            flag = "" if rows else "  EMPTY"
            print(f"ok   {name}: {len(rows)} rows {took:.1f}s / {time.time() - start:.1f}s{flag}", flush=True)
    print(f"{len(wanted)} queries, {len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
