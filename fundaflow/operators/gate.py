"""Risk gate over order intents and the selections of the order chain."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow import vocab
from fundaflow.config import RiskLimits
from fundaflow.functions.ids import stable_id
from fundaflow.functions.numbers import exact_sum, is_finite
from fundaflow.sources.ledger import event_rows

APPROVED = "approved by deterministic hard risk gate"


def risk_limits(broker_state: DataFrame, now: datetime, **overrides: float) -> RiskLimits:
    """Limits from the single broker-state row; positive overrides replace what it says."""
    rows = broker_state.select(
        "reconciled", F.unix_seconds("checked_at").alias("checked"), "portfolio_value_usd", "cash_usd"
    ).take(2)
    if len(rows) > 1:
        raise ValueError("the broker state has more than one row")
    base = RiskLimits(now=now)
    if rows:
        row = rows[0]
        checked = None if row.checked is None else datetime.fromtimestamp(row.checked, timezone.utc)
        base = replace(
            base, broker_reconciled=bool(row.reconciled), reconciliation_checked_at=checked,
            portfolio_value_usd=float(row.portfolio_value_usd), cash_usd=float(row.cash_usd),
        )
    for name in ("portfolio_value_usd", "cash_usd"):
        if overrides.get(name, 0.0) <= 0.0:
            overrides.pop(name, None)
    return replace(base, **overrides)


def _utc(moment: datetime) -> datetime:
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def reconciliation_fresh(limits: RiskLimits) -> bool:
    if not limits.broker_reconciled or limits.reconciliation_checked_at is None or limits.max_reconciliation_age_s <= 0:
        return False
    now, checked = _utc(limits.now).timestamp(), _utc(limits.reconciliation_checked_at).timestamp()
    return now > 0 and checked > 0 and int(now) - int(checked) <= limits.max_reconciliation_age_s


def reconciliation_status(broker_state: DataFrame, now: Column, max_age_s: int) -> DataFrame:
    """Freshness of each reconciliation row as a column."""
    age = F.unix_seconds(now) - F.unix_seconds("checked_at")
    ok = F.col("reconciled") & (F.unix_seconds("checked_at") > 0) & (age <= max_age_s) & F.lit(max_age_s > 0)
    return broker_state.withColumn("is_fresh", F.coalesce(ok, F.lit(False)))


def risk_gate(intents: DataFrame, securities: DataFrame, limits: RiskLimits) -> DataFrame:
    """First failing rule per intent, in fixed order.

    The buy total covers every positive buy of the batch, whatever else is wrong with it,
    and fails all buys when it exceeds cash.
    """
    notional, side = F.col("notional_usd"), F.col("side")
    buys = (side == "buy") & is_finite(notional) & (notional > 0)
    total = intents.agg(F.coalesce(exact_sum(F.when(buys, notional)), F.lit(0.0))).scalar()
    known = securities.select(
        "security_id", F.col("investable").alias("listed"), F.col("adv_usd").alias("adv"), F.lit(True).alias("known")
    )
    weight, adv = F.col("target_weight_ratio"), F.col("adv")
    stale = F.lit(not reconciliation_fresh(limits))
    reason = (
        F.when(stale, F.lit("broker reconciliation is missing or stale"))
        .when(F.col("known").isNull(), F.lit("security not found"))
        .when(~F.col("listed"), F.lit("security not investable"))
        .when(~F.coalesce(side.isin("buy", "sell"), F.lit(False)), F.lit("invalid order side"))
        .when(~is_finite(notional) | (notional < limits.min_abs_order_notional_usd), F.lit("notional below minimum or invalid"))
        .when((F.lit(limits.max_order_notional_usd) > 0) & (notional > limits.max_order_notional_usd),
              F.lit("order notional exceeds hard limit"))
        .when(~is_finite(weight) | (F.abs(weight) > limits.max_name_weight_ratio), F.lit("target weight exceeds name limit"))
        .when(~is_finite(adv) | (adv < limits.min_adv_usd), F.lit("liquidity below minimum ADV"))
        .when((F.lit(limits.max_adv_participation_ratio) > 0) & (notional > adv * limits.max_adv_participation_ratio),
              F.lit("order exceeds ADV participation limit"))
        .when((side == "buy") & (F.col("buy_total") > limits.cash_usd), F.lit("aggregate buy notional exceeds cash"))
        .otherwise(F.lit(APPROVED))
    )
    return (
        intents.withColumn("buy_total", total)
        .join(known, "security_id", "left")
        .withColumn("decision_reason", reason)
        .withColumn("approved", F.col("decision_reason") == APPROVED)
        .drop("listed", "adv", "known", "buy_total")
    )


def pending_intents(intents: DataFrame, decisions: DataFrame, run_id: str | None = None) -> DataFrame:
    """Intents nobody has decided on yet."""
    rows = intents if run_id is None else intents.filter(F.col("run_id") == run_id)
    return rows.join(decisions.select("intent_id"), "intent_id", "left_anti")


def gate_run(intents: DataFrame, decisions: DataFrame, securities: DataFrame, limits: RiskLimits,
             created_at: Column, run_id: str | None = None) -> DataFrame:
    """New decision rows for the pending intents."""
    gated = risk_gate(pending_intents(intents, decisions, run_id), securities, limits)
    return gated.select(
        stable_id("decision", intent_id=F.col("intent_id"), created_at=(created_at, "time")).alias("decision_id"),
        "intent_id", "security_id", "approved", F.col("decision_reason").alias("reason"), "notional_usd",
        created_at.alias("created_at"),
    )


def stageable(decisions: DataFrame, intents: DataFrame, staged: DataFrame, mode: str, run_id: str | None = None,
              limit: int | None = None) -> DataFrame:
    """Approved decisions not staged yet, oldest first; none outside the staging modes."""
    if mode not in vocab.STAGE_MODES:
        raise ValueError(f"cannot stage orders in mode={mode!r}; set mode explicitly")
    orders = intents if run_id is None else intents.filter(F.col("run_id") == run_id)
    rows = (
        decisions.filter("approved")
        .join(staged.select("decision_id"), "decision_id", "left_anti")
        .join(orders.select("intent_id", "side", "run_id"), "intent_id")
        .select("decision_id", "intent_id", "security_id", "side", "notional_usd", "created_at")
    )
    return rows if limit is None else rows.orderBy("created_at", "decision_id").limit(limit)


def stage(rows: DataFrame, staged_at: Column) -> DataFrame:
    """Rows of the staged-order table for stageable rows, each with an id that follows from its decision."""
    return rows.select(
        stable_id("staged", decision_id=F.col("decision_id")).alias("staged_order_id"),
        "decision_id", "intent_id", "security_id", "side", "notional_usd", staged_at.alias("staged_at"))


def gate_counts(decisions: DataFrame) -> DataFrame:
    """Decided, approved and rejected intents as one row."""
    return decisions.agg(
        F.count("*").alias("intent_count"), F.count_if("approved").alias("approved_count"), F.count_if(~F.col("approved")).alias("rejected_count"))


def gate_events(decisions: DataFrame, occurred_at: Column) -> DataFrame:
    """The ledger row of a gate run."""
    return event_rows(gate_counts(decisions), "gate_completed", ["intent_count", "approved_count", "rejected_count"], occurred_at)


def stage_events(staged: DataFrame, occurred_at: Column) -> DataFrame:
    """One ledger row per staged order."""
    fields = ["staged_order_id", "decision_id", "intent_id", "security_id", "side", "notional_usd"]
    return event_rows(staged, "order_staged", fields, occurred_at)


def submittable(staged: DataFrame, broker_events: DataFrame, mode: str, limits: RiskLimits,
                limit: int | None = None) -> DataFrame:
    """Staged orders without a submission event; needs a paper or live mode and fresh books."""
    if mode not in vocab.SUBMIT_MODES:
        raise ValueError(f"cannot send broker orders in mode={mode!r}")
    if not reconciliation_fresh(limits):
        raise ValueError("broker reconciliation is missing or stale")
    sent = broker_events.filter(F.col("event_type") == vocab.SUBMITTED_EVENT).select("staged_order_id")
    rows = staged.join(sent, "staged_order_id", "left_anti")
    return rows if limit is None else rows.orderBy("staged_at", "staged_order_id").limit(limit)
