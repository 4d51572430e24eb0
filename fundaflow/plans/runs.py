"""Model, feature and ingest runs.  Each returns the frames a caller appends to its tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.config import DEFAULT_SCENARIOS, ModelConfig, RiskLimits, Scenario
from fundaflow.functions.ids import content_hash, stable_id
from fundaflow.operators import features, growth, portfolio, statements, valuation
from fundaflow.session import cut_lineage


def _config_json(config: ModelConfig) -> str:
    return json.dumps(asdict(config), sort_keys=True)


def _run_row(like: DataFrame, run_id: str, kind: str, config: ModelConfig, created_at: Column,
             counts: dict[str, Column]) -> DataFrame:
    """Run header with its counts rendered as diagnostics text."""
    text = F.concat_ws(" ", F.lit(f"{kind}_ok"), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in counts.items()])
    one = like.sparkSession.range(1)
    return one.select(
        F.lit(run_id).alias("run_id"), F.lit(kind).alias("run_kind"), F.lit(_config_json(config)).alias("config_json"),
        text.alias("diagnostics"), created_at.alias("created_at"),
    )


def _count(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def plan_run(facts: DataFrame, securities: DataFrame, positions: DataFrame, config: ModelConfig, limits: RiskLimits,
             run_id: str, created_at: Column) -> dict[str, DataFrame]:
    """Growth forecasts, targets and intents."""
    rows = cut_lineage(growth.forecast_scores(growth.forecasts(facts, securities, config, limits.now), config))
    target_rows = portfolio.targets(rows, positions, config, portfolio.FORECAST_REASON, checkpoint=False)
    orders = portfolio.intents(target_rows, config, limits, run_id, created_at)
    header = _run_row(facts, run_id, "plan", config, created_at, {"securities": _count(rows), "intents": _count(orders)})
    return {
        "model_runs": header,
        "forecasts": rows.drop("score", "eligible").withColumn("run_id", F.lit(run_id)),
        "target_weights": target_rows.withColumn("run_id", F.lit(run_id)),
        "order_intents": orders,
    }


def assumption_set(scenarios: Sequence[Scenario]) -> tuple[str, Column]:
    """Scenario set as sorted-key JSON and its hash."""
    text = json.dumps({"scenario_count": len(scenarios), "scenarios": [asdict(s) for s in scenarios]}, sort_keys=True)
    return text, F.sha2(F.lit(text), 256)


def forecast_outcomes(rows: DataFrame, run_id: str, horizon_days: int, created_at: Column) -> DataFrame:
    """Opening rows of the later outcome check, one per valued security."""
    return rows.filter(F.col("intrinsic_value_per_share_usd") != 0).select(
        stable_id("outcome", run_id=F.lit(run_id), security_id=(F.col("security_id"), "int"),
                  horizon=(F.lit(horizon_days), "int")).alias("outcome_id"),
        F.lit(run_id).alias("run_id"), "security_id", F.lit(horizon_days).alias("horizon_days"),
        F.col("current_price_usd").alias("price_at_forecast_usd"),
        F.col("expected_return_ratio").alias("forecast_return_ratio"),
        created_at.alias("created_at"),
    )


def value_run(facts: DataFrame, securities: DataFrame, positions: DataFrame, config: ModelConfig, limits: RiskLimits,
              run_id: str, created_at: Column, scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
              horizon_days: int = 365) -> dict[str, DataFrame]:
    """Statements, valuations, targets and intents.

    Statements and scored valuations (one row) are
    checkpointed: everything behind them is read once however many outputs are written.
    """
    age = config.max_fact_age_s
    built = cut_lineage(statements.build_statements(facts, securities, limits.now, age))
    scored = cut_lineage(valuation.valuation_scores(
        valuation.valuations(built, securities, scenarios, limits.now, age), limits))
    target_rows = portfolio.targets(scored, positions, config, checkpoint=False)
    orders = portfolio.intents(target_rows, config, limits, run_id, created_at)
    text, digest = assumption_set(scenarios)
    header = _run_row(facts, run_id, "value", config, created_at, {
        "securities": _count(scored), "statements": _count(built), "intents": _count(orders)})
    return {
        "model_runs": header.withColumn("assumption_sha256", digest),
        "model_assumptions": header.select(
            F.lit(text).alias("assumption_json"), digest.alias("assumption_sha256"), "created_at"),
        "statement_snapshots": statements.statement_snapshots(built, created_at),
        "valuations": scored.drop("score", "eligible").withColumn("run_id", F.lit(run_id)),
        "target_weights": target_rows.withColumn("run_id", F.lit(run_id)),
        "order_intents": orders,
        "forecast_outcomes": forecast_outcomes(scored, run_id, horizon_days, created_at),
    }


def feature_run(snapshots: DataFrame, securities: DataFrame, name: str, as_of: datetime, created_at: Column,
                universe: DataFrame | None = None, universe_id: str | None = None) -> dict[str, DataFrame]:
    """Feature rows and their snapshot header."""
    rows = cut_lineage(features.feature_rows(features.latest_with_prior(snapshots, securities, as_of, universe)))
    header = features.feature_snapshot(rows, name, as_of, universe_id, created_at)
    snapshot_id = header.select("feature_snapshot_id").scalar()
    return {
        "feature_snapshots": header,
        "feature_rows": rows.withColumn("feature_snapshot_id", snapshot_id).withColumn("created_at", created_at),
    }


def config_hash(config: ModelConfig) -> Column:
    return content_hash(config=F.lit(_config_json(config)))
