"""Closures and cycles in logarithmic rounds, counted, and seeds from one scan of the bars."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fundaflow.operators import lineage, market

PAIRS = "from_node_id string, to_node_id string"


@pytest.fixture()
def written(monkeypatch):
    """Counts the tables that a closure writes."""
    tables = []
    cut = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: tables.append(1) or cut(df))
    return tables


def closure(pairs, root):
    seen, open_ = {root}, [root]
    while open_:
        here = open_.pop()
        for a, b in pairs:
            if a == here and b not in seen:
                seen.add(b)
                open_.append(b)
    return seen


def frames(spark, pairs, roots):
    rows = spark.createDataFrame([(a, b, "input") for a, b in pairs], "child_product_id string, parent_product_id string, role string")
    known = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "product_id string")
    return rows, known, spark.createDataFrame([(r,) for r in roots], "product_id string")


def test_a_chain_of_4096_takes_14_rounds(spark, written):
    chain = spark.range(4095).select(F.concat(F.lit("p"), "id").alias("child_product_id"), F.concat(F.lit("p"), F.col("id") + 1).alias("parent_product_id"), F.lit("input").alias("role"))
    known = spark.range(4096).select(F.concat(F.lit("p"), "id").alias("product_id"))
    out = lineage.ancestors(chain, known, known.filter("product_id in ('p0', 'p4000')"))
    counts = {r.root_product_id: r["count"] for r in out.groupBy("root_product_id").count().collect()}
    assert counts == {"p0": 4096, "p4000": 96}
    assert len(written) <= 2 + 2 * 14


def test_closures_of_random_graphs_with_cycles(spark):
    rng = random.Random(7)
    for size, edges in ((12, 20), (30, 34), (25, 60)):
        pairs = {(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(edges)} | {("n0", "n0"), ("n1", "n2"), ("n2", "n1")}
        rows, known, roots = frames(spark, sorted(pairs), ["n0", "n1", "n5"])
        got = {(r.root_product_id, r.product_id) for r in lineage.ancestors(rows, known, roots).collect()}
        assert got == {(root, x) for root in ("n0", "n1", "n5") for x in closure(pairs, root)}


def test_a_deep_layered_graph_takes_few_rounds(spark, written):
    """A thousand layers of three, each joined to all of the next: no cycle; then one behind which a part of it lies."""
    layered = spark.range(999).select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("i"), ).select("id", "i", F.explode(F.array(*map(F.lit, range(3)))).alias("j")).select(
        F.concat_ws("_", "id", "i").alias("from_node_id"), F.concat_ws("_", F.col("id") + 1, "j").alias("to_node_id"))
    assert lineage.audit_cycles(layered).count() == 0
    assert len(written) <= 1 + 2 * 25
    written.clear()
    knot = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "990_0")], PAIRS)
    got = {r.subject for r in lineage.audit_cycles(layered.unionByName(knot)).collect()}
    assert got == {"x", "y", "990_0", *(f"{k}_{i}" for k in range(991, 1000) for i in range(3))}
    assert len(written) <= 1 + 2 * 25


@pytest.mark.parametrize("walks", [0, 8])
def test_cycles_of_random_graphs(spark, monkeypatch, walks):
    """With and without doubling, on and behind cycles is what plain removal of unfed nodes leaves."""
    monkeypatch.setattr(lineage, "WALKS", walks)
    rng = random.Random(11)
    for size, edges in ((10, 12), (20, 22), (20, 40)):
        pairs = {(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(edges)}
        left = set(pairs)
        while True:
            fed = {b for _, b in left}
            kept = {(a, b) for a, b in left if a in fed}
            if kept == left:
                break
            left = kept
        got = {r.subject for r in lineage.audit_cycles(spark.createDataFrame(sorted(pairs), PAIRS)).collect()}
        assert got == {b for _, b in left}


def bars(rng, n, hot):
    out = []
    for k in range(n):
        symbol = "HOT" if rng.random() < hot else rng.choice(["A", "B", "C", None])
        out.append((symbol, f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", float(rng.randrange(1, 9)), float(rng.randrange(0, 50))))
    return out


@pytest.mark.parametrize("held", [64, 200_000])
def test_bar_statistics_in_one_scan(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(market, "HELD", held)
    rows = bars(random.Random(5), 4000, 0.5)
    schema = "symbol string, time string, close double, volume double"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(f"{tmp_path}/bars")
    stats = market.bar_statistics(spark.read.parquet(f"{tmp_path}/bars"), 20)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {r.symbol: tuple(r)[1:] for r in stats.collect()}
    for symbol in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == symbol), reverse=True)
        top = own[:20]
        want = (len(own), own[0][0], own[0][1], pytest.approx(sum(c * v for _, c, v in top) / len(top)))
        assert got[symbol] == want
    assert market.bar_statistics(spark.createDataFrame([], schema), 20).count() == 0


def test_newest_rows_order_nan_and_null_as_spark_does(spark):
    nan = float("nan")
    rows = [("A", "2024-01-01", nan, 1.0), ("A", "2024-01-01", 9.0, 2.0), ("A", None, 3.0, 4.0), ("A", "2023-01-01", None, 1.0), ("A", "2024-01-01", 9.0, nan)]
    frame = spark.createDataFrame(rows, "symbol string, time string, close double, volume double")
    for n in range(1, 6):
        kept = market._newest(frame.withColumn("bars", F.lit(1).cast("long")).coalesce(1), n).collect()
        want = frame.orderBy(F.desc("time"), F.desc("close"), F.desc("volume")).limit(n).collect()
        assert [str(tuple(r)[:4]) for r in kept] == [str(tuple(r)) for r in want]
        assert sum(r.bars for r in kept) == 5
