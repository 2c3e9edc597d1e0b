"""Run registered queries on Spark and on DuckDB and compare rows exactly.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    """A hashable value that keeps the type family apart: 1, 1.0, '1' and True differ."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("null" if value is None else "nan",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", repr(value))
    if isinstance(value, dt.datetime):
        return ("timestamp", value.isoformat())
    if isinstance(value, dt.date):
        return ("date", value.isoformat())
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    return ("text", str(value))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in records)


def compare(spark, con, sf_dir: str, name: str, queries, oracles) -> str:
    """Empty when the results agree, else what differs."""
    df = queries[name](spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return "" if got else "no rows"
    cur = con.execute(oracles[name])
    names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if columns != names:
        return f"columns {columns} != {names}"
    if got == want:
        return "" if got else "no rows on either side"
    extra = sorted(set(got) - set(want))[:2]
    lost = sorted(set(want) - set(got))[:2]
    return f"{len(got)} vs {len(want)} rows\n   {columns}\n   spark only {extra}\n   sql only   {lost}"


def main() -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con, failed = make_session(), duck(sf_dir), 0
    for name in args or queries:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, queries, oracles)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        kind = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - start:.1f}s {problem}", flush=True)
    spark.stop()
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
