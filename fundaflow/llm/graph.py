"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.shared import checkpointed


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and all its neighbours.  Combined before the shuffle; a hot u is split by the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them.  Edges run from the larger to the smaller node."""
    moved = _star(edges)
    below = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(moved.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): for each node of an edge (u, v), the least node reachable; roots are left out.

    Rows with a null end and loops are no edges; repeated and reversed edges count once.  Each round writes a
    checkpoint, compares count and hash sums on the driver, and ends when nothing moves: O(log n) rounds.
    """
    ends = [F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")]
    cur = checkpointed(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(*ends).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
    before = mark(cur)
    for _ in range(most_rounds):
        if not before[0]:
            break
        cur = checkpointed(small_star(large_star(cur)))
        after = mark(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
