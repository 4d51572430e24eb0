"""Queries do the whole job of their tables; the tables are built here."""

from __future__ import annotations

from datetime import datetime

import __spark_entry__ as entry
from tests.compare import normal


def write_tables(spark, folder, quarters, suppliers):
    """One line item per supplier and quarter."""
    spark.createDataFrame([(0, "AFRICA")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    spark.createDataFrame([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(k, 0) for k in suppliers], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    lines = [(k, 1e8 * (10 + k + i), 0.0, datetime(1995 + i // 4, 3 * (i % 4) + 2, 15)) for k in suppliers for i in range(quarters)]
    spark.createDataFrame(lines, "l_suppkey long, l_extendedprice double, l_discount double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")


def from_sql(name, folder, tables):
    """What the SQL twin gives over folders of Parquet files."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    return normal(cur.fetchall(), [c[0] for c in cur.description])


def test_snapshots_of_every_anchor(spark, tmp_path):
    """Twenty quarters of a quarterly, a year-to-date and an annual issuer: more anchors than twelve where each quarter is filed."""
    write_tables(spark, tmp_path, 20, [0, 1, 2, 3])
    df = entry.queries()["statement_snapshots"](spark, str(tmp_path))
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got == from_sql("statement_snapshots", tmp_path, ["region", "nation", "supplier", "lineitem"])
    ends = {k: sum(r.security_id == k + 1 for r in df.select("security_id").collect()) for k in (0, 2, 3)}
    # four quarters, or the points carried on to an annual end
    assert ends == {0: 17, 2: 5, 3: 17}
