"""TTM statements, their quality bits and their identity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow import vocab
from fundaflow.functions.flags import bit_if, combine, has_any
from fundaflow.functions.ids import content_hash, stable_id
from fundaflow.operators.ttm import FLOW_METRICS, POINT_METRICS, _newest_anchors, statement_timeline

PARTS = [vocab.METRICS[m][0] for m in FLOW_METRICS + POINT_METRICS]
AMOUNTS = [
    "revenue_usd", "net_income_usd", "diluted_eps_usd", "diluted_shares", "operating_cash_flow_usd",
    "capex_usd", "free_cash_flow_usd", "cash_usd", "debt_usd", "net_debt_usd",
]
BUILDER_VERSION = 1


def observation_quality(flags: Column) -> Column:
    """Statement bits implied by the bits of the observations that went in."""
    s = vocab.STMT
    return combine(
        bit_if(has_any(flags, vocab.OBS_AMENDED | vocab.OBS_RESTATED), s["amended_or_restated"]),
        bit_if(has_any(flags, vocab.OBS_DERIVED), s["derived_ttm"]),
        bit_if(has_any(flags, vocab.OBS_LOW_CONFIDENCE_SET), s["low_confidence"]),
        bit_if(has_any(flags, vocab.OBS_NON_COMPARABLE_SET), s["non_comparable_period"]),
    )


def statement_quality(parts: dict[str, Column], fcf: Column) -> Column:
    """All statement bits from the eight part structs (NULL when a part is missing)."""
    s = vocab.STMT
    seen = combine(*[F.coalesce(p["quality_flags"], F.lit(0).cast("long")) for p in parts.values()])

    def not_positive(name: str) -> Column:
        return parts[name].isNull() | (parts[name]["value"] <= 0)

    return combine(
        observation_quality(seen),
        bit_if(not_positive("revenue"), s["missing_revenue"] | s["low_confidence"]),
        bit_if(not_positive("diluted_shares"), s["missing_shares"] | s["low_confidence"]),
        bit_if(parts["operating_cash_flow"].isNull(), s["missing_operating_cash_flow"] | s["low_confidence"]),
        bit_if(parts["capex"].isNull(), s["missing_capex"] | s["low_confidence"]),
        bit_if(parts["cash"].isNull(), s["missing_cash"]),
        bit_if(parts["debt"].isNull(), s["missing_debt"]),
        bit_if(F.coalesce(fcf < 0, F.lit(False)), s["negative_fcf"]),
    )


def build_statements(facts: DataFrame, securities: DataFrame, now: datetime | None = None,
                     max_age_s: int = 0, max_anchors: int | None = None) -> DataFrame:
    """Statements of every investable security on its anchors, or on the newest `max_anchors` of them."""
    listed = securities.filter("investable").select("security_id")
    timeline = statement_timeline(facts, now, max_age_s).filter("is_anchor")
    rows = _newest_anchors(timeline.join(listed, "security_id", "left_semi"), max_anchors)

    part = {name: F.col(name) for name in PARTS}

    def amount(name: str) -> Column:
        return F.coalesce(part[name]["value"], F.lit(0.0))

    fcf = part["operating_cash_flow"]["value"] - part["capex"]["value"]
    core = part["revenue"].isNotNull() | part["net_income"].isNotNull() | part["operating_cash_flow"].isNotNull()
    return (
        rows.filter(core)
        .select(
            "security_id",
            F.coalesce(part["revenue"]["period_start"], F.col("period_end")).alias("period_start"),
            "period_end",
            F.greatest(*[p["available_at"] for p in part.values()]).alias("available_at"),
            F.lit(True).alias("is_ttm"),
            amount("revenue").alias("revenue_usd"),
            amount("net_income").alias("net_income_usd"),
            amount("eps_diluted").alias("diluted_eps_usd"),
            amount("diluted_shares").alias("diluted_shares"),
            amount("operating_cash_flow").alias("operating_cash_flow_usd"),
            amount("capex").alias("capex_usd"),
            F.coalesce(fcf, F.lit(0.0)).alias("free_cash_flow_usd"),
            amount("cash").alias("cash_usd"),
            amount("debt").alias("debt_usd"),
            (amount("debt") - amount("cash")).alias("net_debt_usd"),
            statement_quality(part, fcf).alias("quality_flags"),
        )
        .filter(F.unix_seconds("available_at") > 0)
    )


def statement_snapshots(statements: DataFrame, inserted_at: Column) -> DataFrame:
    """Adds the source hash over all seventeen fields and the snapshot id."""
    hashed = content_hash(
        security_id=(F.col("security_id"), "int"),
        period_start=(F.col("period_start"), "date"),
        period_end=(F.col("period_end"), "date"),
        available_at=(F.col("available_at"), "time"),
        is_ttm=(F.col("is_ttm").cast("int"), "int"),
        **{name: (F.col(name), "num") for name in AMOUNTS},
        quality_flags=(F.col("quality_flags"), "int"),
        version=(F.lit(BUILDER_VERSION), "int"),
    )
    identity = stable_id(
        "stmt",
        security_id=(F.col("security_id"), "int"),
        period_end=(F.col("period_end"), "date"),
        available_at=(F.col("available_at"), "time"),
        source_hash=F.col("source_hash"),
    )
    return (
        statements.withColumn("source_hash", hashed)
        .withColumn("snapshot_id", identity)
        .withColumn("inserted_at", inserted_at)
    )


def statement_diagnostics(facts: DataFrame, securities: DataFrame, statements: DataFrame) -> DataFrame:
    """Counts of securities, investable securities, facts and statements as one row."""
    sec = securities.agg(
        F.count("*").alias("securities"), F.count_if("investable").alias("investable")
    )
    return sec.select(
        "securities",
        "investable",
        facts.agg(F.count("*")).scalar().alias("facts"),
        statements.agg(F.count("*")).scalar().alias("statements"),
    )
