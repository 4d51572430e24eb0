"""Target weights, order intents and the checks on model inputs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.config import ModelConfig, RiskLimits, Scenario
from fundaflow.functions.ids import stable_id
from fundaflow.functions.numbers import TINY, clamp, exact_sum, is_finite
from fundaflow.operators.valuation import check_scenarios
from fundaflow.session import cut_lineage

VALUE_REASON = "valuation-weighted long-only target"
FORECAST_REASON = "score-weighted long-only target"


def first_position(positions: DataFrame) -> DataFrame:
    """One weight per security.  Positions are unique per security; of repeated ones the smallest weight counts, not the first."""
    return positions.groupBy("security_id").agg(F.min("weight_ratio").alias("weight_ratio"))


def targets(scored: DataFrame, positions: DataFrame, config: ModelConfig, reason: str = VALUE_REASON,
            checkpoint: bool = True) -> DataFrame:
    """Exposure shared out in proportion to score; what the name cap clips is not redistributed.

    The score total is a one-row aggregate read back as a scalar subquery.  The scored rows
    (one per security) are checkpointed first, so the model behind them runs once and not
    once for the total and once for the rows.  The total is summed in fixed point and
    therefore does not depend on partitioning.
    """
    rows = scored.select("security_id", "investable", "score", "eligible")
    if checkpoint:
        rows = cut_lineage(rows)
    total = rows.agg(exact_sum(F.col("score")).alias("total")).scalar()
    held = F.coalesce("weight_ratio", F.lit(0.0))
    share = F.lit(config.target_gross_exposure_ratio) * F.col("score") / F.col("total")
    gets_weight = F.coalesce(F.col("investable") & (F.col("total") > TINY) & F.col("eligible"), F.lit(False))
    return (
        rows.withColumn("total", total)
        .join(first_position(positions), "security_id", "left")
        .select(
            "security_id",
            held.alias("current_weight_ratio"),
            F.when(gets_weight, clamp(share, 0.0, config.max_name_weight_ratio)).otherwise(F.lit(0.0)).alias("target_weight_ratio"),
            F.when(gets_weight, F.lit(reason)).otherwise(F.lit("zero target")).alias("reason"),
        )
        .withColumn("delta_weight_ratio", F.col("target_weight_ratio") - F.col("current_weight_ratio"))
    )


def intents(target_rows: DataFrame, config: ModelConfig, limits: RiskLimits, run_id: str | None = None,
            created_at: Column | None = None) -> DataFrame:
    """Orders for every target that moves at least the minimum notional."""
    notional = F.abs(F.col("delta_weight_ratio") * F.lit(limits.portfolio_value_usd))
    rows = (
        target_rows.withColumn("notional_usd", notional)
        .filter(F.col("notional_usd") >= config.min_abs_order_notional_usd)
        .select(
            "security_id",
            F.when(F.col("delta_weight_ratio") > 0, F.lit("buy")).otherwise(F.lit("sell")).alias("side"),
            "notional_usd", "current_weight_ratio", "target_weight_ratio", "reason",
        )
    )
    if run_id is None:
        return rows
    return rows.select(
        stable_id("intent", run_id=F.lit(run_id), security_id=(F.col("security_id"), "int")).alias("intent_id"),
        F.lit(run_id).alias("run_id"), "*", created_at.alias("created_at"),
    )


def _broken(rule: Column, key: Column, detail: str) -> list[Column]:
    return [F.lit(detail).alias("rule"), key.cast("string").alias("subject")]


def check_settings(config: ModelConfig, limits: RiskLimits, scenarios: Sequence[Scenario] | None) -> list[str]:
    """Broken rules of the scalar settings."""

    def outside(value: float, low: float, high: float, open_low: bool = False) -> bool:
        return not math.isfinite(value) or value > high or value < low or (open_low and value <= low)

    broken = []
    if outside(limits.portfolio_value_usd, 0.0, math.inf, open_low=True):
        broken.append("portfolio_value_usd must be positive")
    if outside(config.target_gross_exposure_ratio, 0.0, 1.0):
        broken.append("target_gross_exposure_ratio out of range")
    if outside(config.max_name_weight_ratio, 0.0, 1.0, open_low=True):
        broken.append("max_name_weight_ratio out of range")
    if scenarios is None:
        if outside(config.max_forecast_abs_growth_ratio, 0.0, 10.0, open_low=True):
            broken.append("max_forecast_abs_growth_ratio out of range")
    else:
        broken.extend(check_scenarios(scenarios))
    return broken


def validate_model_inputs(securities: DataFrame, positions: DataFrame, config: ModelConfig, limits: RiskLimits,
                          scenarios: Sequence[Scenario] | None = None) -> DataFrame:
    """One row per broken rule; empty when the model may run."""
    spark = securities.sparkSession
    settings = spark.createDataFrame(
        [(rule, "settings") for rule in check_settings(config, limits, scenarios)], "rule string, subject string"
    )
    no_id = securities.filter((F.col("security_id") == 0) | F.col("security_id").isNull()).select(
        *_broken(F.lit(True), F.coalesce("cik", F.lit("")), "security_id must be nonzero"))
    weight = F.col("weight_ratio")
    heavy = positions.filter(~is_finite(weight) | (F.abs(weight) > 10.0)).select(
        *_broken(F.lit(True), F.col("security_id"), "position weight out of range"))
    return settings.unionByName(no_id).unionByName(heavy)
