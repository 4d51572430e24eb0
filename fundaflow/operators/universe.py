"""Universe snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow import vocab
from fundaflow.functions.ids import stable_id


def build_universe(securities: DataFrame, observations: DataFrame, min_adv_usd: float, min_facts: int) -> DataFrame:
    """Investable, liquid members with enough usable observations (none counts as zero)."""
    counts = (
        observations.filter(F.col("observation_status").isin(*vocab.USABLE_STATUSES))
        .groupBy("security_id")
        .agg(F.count("*").alias("fact_count"))
    )
    return (
        securities.filter(F.col("investable") & (F.col("adv_usd") >= min_adv_usd))
        .select("security_id", "adv_usd")
        .join(counts, "security_id", "left")
        .withColumn("fact_count", F.coalesce("fact_count", F.lit(0).cast("long")))
        .filter(F.col("fact_count") >= min_facts)
    )


def universe_snapshot(name: str, created_at: Column, min_adv_usd: float, min_facts: int) -> list[Column]:
    """Header columns of a universe snapshot."""
    return [
        stable_id("universe", name=F.lit(name), created_at=(created_at, "time")).alias("snapshot_id"),
        F.lit(name).alias("name"),
        created_at.alias("created_at"),
        F.to_json(F.struct(F.lit(min_adv_usd).alias("min_adv_usd"), F.lit(min_facts).alias("min_fact_count"))).alias("rule_json"),
    ]


def resolve_universe(snapshots: DataFrame, snapshot_id: str | None = None, name: str = "") -> DataFrame:
    """The snapshot with the id, or the newest one of the name.  No row when it does not exist."""
    if snapshot_id and name.strip():
        raise ValueError("use either a snapshot id or a universe name, not both")
    if snapshot_id:
        return snapshots.filter(F.col("snapshot_id") == snapshot_id)
    return (
        snapshots.filter(F.col("name") == name)
        .orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc())
        .limit(1)
    )
