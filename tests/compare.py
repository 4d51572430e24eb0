"""Run registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from fundaflow.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def check(spark, con, name, sf_dir):
    """(status, spark rows, oracle rows, first difference, seconds)."""
    began = time.time()
    df = entry.queries()[name](spark, sf_dir)
    names = df.columns
    got = normal([tuple(r) for r in df.collect()], names)
    seconds = time.time() - began
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows", len(got), None, None, seconds
    cur = con.execute(sql)
    sql_names = [c[0] for c in cur.description]
    want = normal(cur.fetchall(), sql_names)
    if sorted(names) != sorted(sql_names):
        return "COLUMNS", len(got), len(want), (sorted(names), sorted(sql_names)), seconds
    if got == want:
        return "ok", len(got), len(want), None, seconds
    got_set, want_set = set(got), set(want)
    only_spark = [r for r in got if r not in want_set][:3]
    only_sql = [r for r in want if r not in got_set][:3]
    return "DIFF", len(got), len(want), (only_spark, only_sql), seconds


def main() -> int:
    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session(8), duck(sf_dir), 0
    for name in wanted:
        try:
            status, n, m, diff, sec = check(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on to the next query
            status, n, m, diff, sec = "ERROR", None, None, str(exc)[:1500], 0.0
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:34} {n} {m} {sec:.2f}s", flush=True)
        if diff:
            print("   ", diff, flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
