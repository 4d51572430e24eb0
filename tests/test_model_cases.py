"""Small cases with known answers for statements, forecasts, valuation and the risk gate."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fundaflow import vocab
from fundaflow.config import DEFAULT_SCENARIOS, ModelConfig, RiskLimits, Scenario
from fundaflow.operators import gate, growth, portfolio, statements, ttm, valuation
from fundaflow.session import cut_lineage
from tests import builders as b

NOW = datetime(2024, 6, 30)
CONFIG = ModelConfig(0.50, 0.10, 0.02, 100.0, 1.0, 0)
LIMITS = RiskLimits(now=NOW, portfolio_value_usd=100_000.0, cash_usd=1e6, max_name_weight_ratio=0.10, max_order_notional_usd=20_000.0,
                    min_adv_usd=1000.0, max_adv_participation_ratio=0.5, broker_reconciled=True, reconciliation_checked_at=NOW)
Q = [("2023-01-01", "2023-03-31"), ("2023-04-01", "2023-06-30"), ("2023-07-01", "2023-09-30"), ("2023-10-01", "2023-12-31"), ("2024-01-01", "2024-03-31")]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def growth_case(spark):
    values = {1: {1: (100, 125), 2: (10, 13)}, 2: {1: (100, 90), 2: (10, 9)}}
    facts = [b.fact(s, m, v, *Q[i]) for s, ms in values.items() for m, pair in ms.items() for i, v in zip((3, 4), pair)]
    return b.facts(spark, facts), b.securities(spark, [(1, True, 10, 1e6), (2, True, 10, 1e6)])


def test_growth_plan_buys_the_grower(spark):
    facts, sec = growth_case(spark)
    rows = {r["security_id"]: r for r in rows_of(growth.forecasts(facts, sec, CONFIG, NOW))}
    assert rows[1]["expected_return_proxy"] == pytest.approx(0.265)
    assert rows[2]["expected_return_proxy"] == pytest.approx(-0.10)
    scored = growth.forecast_scores(growth.forecasts(facts, sec, CONFIG, NOW), CONFIG)
    orders = portfolio.intents(portfolio.targets(scored, b.positions(spark), CONFIG, portfolio.FORECAST_REASON), CONFIG, LIMITS)
    (order,) = rows_of(orders)
    assert (order["security_id"], order["side"], order["notional_usd"]) == (1, "buy", pytest.approx(10_000))
    assert rows_of(gate.risk_gate(orders, sec, LIMITS))[0]["approved"]
    stale = replace(LIMITS, max_reconciliation_age_s=0)
    assert not rows_of(gate.risk_gate(orders, sec, stale))[0]["approved"]


def test_year_to_date_and_ambiguous_facts_do_not_forecast(spark):
    facts = b.facts(spark, [
        b.fact(1, 1, 100, "2023-01-01", "2023-06-30", "fiscal_ytd"), b.fact(1, 1, 150, "2023-01-01", "2023-09-30", "fiscal_ytd"),
        b.fact(1, 2, 10, *Q[3], flags=vocab.OBS_AMBIGUOUS), b.fact(1, 2, 20, *Q[4], flags=vocab.OBS_AMBIGUOUS)])
    (row,) = rows_of(growth.forecasts(facts, b.securities(spark, [(1, True, 10, 1e6)]), CONFIG, NOW))
    assert row["confidence_ratio"] == 0
    assert row["quality_flags"] == vocab.OBS_MISSING_COMPARABLE | vocab.OBS_LOW_CONFIDENCE


def intents(spark, rows):
    return spark.createDataFrame(
        [(f"i{n}", s, side, float(v), 0.0, float(w), "r") for n, (s, side, v, w) in enumerate(rows)],
        "intent_id string, security_id long, side string, notional_usd double, current_weight_ratio double, target_weight_ratio double, reason string")


def test_every_gate_reason_in_order(spark):
    sec = b.securities(spark, [(1, True, 10, 1e6), (2, False, 10, 1e6), (3, True, 10, 10), (4, True, 10, 2000)])
    cases = intents(spark, [(9, "buy", 500, .01), (2, "buy", 500, .01), (1, "none", 500, .01), (1, "buy", 50, .01), (1, "sell", float("nan"), .01),
                            (1, "buy", 30_000, .01), (1, "buy", 500, .2), (3, "buy", 500, .01), (4, "sell", 1500, .01), (1, "buy", 500, .01)])
    got = [r["decision_reason"] for r in sorted(rows_of(gate.risk_gate(cases, sec, LIMITS)), key=lambda r: r["intent_id"])]
    assert got == [
        "security not found", "security not investable", "invalid order side", "notional below minimum or invalid", "notional below minimum or invalid",
        "order notional exceeds hard limit", "target weight exceeds name limit", "liquidity below minimum ADV", "order exceeds ADV participation limit",
        gate.APPROVED]


@pytest.mark.parametrize(("cash", "approved"), [(1000.0, False), (1200.0, True)])
def test_buys_share_the_cash(spark, cash, approved):
    sec = b.securities(spark, [(1, True, 10, 1e6), (2, True, 10, 1e6)])
    out = gate.risk_gate(intents(spark, [(1, "buy", 600, .01), (2, "buy", 600, .01)]), sec, replace(LIMITS, cash_usd=cash))
    assert {r["approved"] for r in rows_of(out)} == {approved}


SCENARIOS = (Scenario("bear", 0.25, 0.00, 0.00, 0.10, 0.12, 10.0), Scenario("base", 0.50, 0.08, 0.02, 0.15, 0.10, 15.0),
             Scenario("bull", 0.25, 0.12, 0.03, 0.20, 0.09, 18.0))


def test_valuation_matches_closed_form(spark):
    st = b.statements(spark, [b.statement(1, "2024-03-31"), b.statement(1, "2023-12-31")])
    (row,) = rows_of(valuation.valuations(st, b.securities(spark, [(1, True, 10, 1e6)]), DEFAULT_SCENARIOS, NOW))
    total = 0.0
    for s in DEFAULT_SCENARIOS:
        flows = [1000e6 * (1 + s.revenue_cagr_5y) ** y * s.target_fcf_margin for y in range(1, 6)]
        worth = sum(f / (1 + s.discount_rate) ** y for y, f in enumerate(flows, 1))
        worth += flows[-1] * (1 + s.terminal_revenue_growth) * s.terminal_fcf_multiple / (1 + s.discount_rate) ** 5
        total += s.probability_weight * (worth + 200e6)
    assert row["intrinsic_value_per_share_usd"] == pytest.approx(total / 100e6, rel=1e-12)
    assert row["enterprise_value_usd"] == pytest.approx(800e6)
    assert row["confidence_ratio"] == pytest.approx(0.90)


def test_stale_and_low_confidence_statements_get_nothing(spark):
    sec = b.securities(spark, [(1, True, 10, 1e6)])
    st = b.statements(spark, [b.statement(1, "2024-03-31")])
    (old,) = rows_of(valuation.valuations(st, sec, DEFAULT_SCENARIOS, NOW, 3600))
    assert old["reason"] == "missing usable statement"
    flagged = b.statements(spark, [b.statement(1, "2024-03-31", flags=vocab.STMT["low_confidence"] | vocab.STMT["amended_or_restated"])])
    values = valuation.valuation_scores(valuation.valuations(flagged, sec, DEFAULT_SCENARIOS, NOW), LIMITS)
    assert rows_of(values)[0]["confidence_ratio"] < 0.5
    assert rows_of(portfolio.targets(values, b.positions(spark), CONFIG))[0]["target_weight_ratio"] == 0


def test_scenarios_are_checked():
    assert valuation.check_scenarios([]) and valuation.check_scenarios([replace(DEFAULT_SCENARIOS[0], discount_rate=0.01)])
    assert not valuation.check_scenarios(DEFAULT_SCENARIOS)


def build(spark, rows):
    out = statements.build_statements(b.facts(spark, rows), b.securities(spark, [(1, True, 10, 1e6)]), NOW)
    return sorted(rows_of(out), key=lambda r: r["period_end"], reverse=True)


def test_four_quarters_sum(spark):
    rows = [b.fact(1, 1, 100 + 10 * i, *q) for i, q in enumerate(Q)]
    rows += [b.fact(1, 5, 20, *q) for q in Q] + [b.fact(1, 6, 5, *q) for q in Q] + [b.fact(1, 4, 10, *q) for q in Q]
    rows += [b.fact(1, m, 50, Q[3][1], Q[3][1], "instant") for m in (7, 8)]
    first, second = [r for r in build(spark, rows) if r["revenue_usd"] > 0]
    assert (first["revenue_usd"], second["revenue_usd"]) == (500, 460)
    assert not first["quality_flags"] & vocab.STMT["low_confidence"]
    assert first["free_cash_flow_usd"] == 60


def test_bridge(spark):
    year, ytd, prior = ("2023-01-01", "2023-12-31"), ("2024-01-01", "2024-06-30"), ("2023-01-01", "2023-06-30")
    rows = [b.fact(1, 1, 400, *year, "fiscal_year"), b.fact(1, 1, 100, "2024-04-01", "2024-06-30")]
    for metric, values in ((5, (100, 70, 40)), (6, (20, 12, 8))):
        rows += [b.fact(1, metric, values[0], *year, "fiscal_year"), b.fact(1, metric, values[1], *ytd, "fiscal_ytd"),
                 b.fact(1, metric, values[2], *prior, "fiscal_ytd")]
    newest = build(spark, rows)[0]
    assert (newest["operating_cash_flow_usd"], newest["capex_usd"], newest["free_cash_flow_usd"]) == (130, 24, 106)
    assert newest["quality_flags"] & vocab.STMT["derived_ttm"]


def test_missing_capex(spark):
    rows = [b.fact(1, m, 10, *q) for m in (1, 5) for q in Q[:4]]
    newest = build(spark, rows)[0]
    assert newest["free_cash_flow_usd"] == 0
    assert newest["quality_flags"] & vocab.STMT["missing_capex"] and newest["quality_flags"] & vocab.STMT["low_confidence"]


def test_broker_state_limits(spark):
    state = spark.sql("select true as reconciled, timestamp'2024-06-29 23:30:00' as checked_at, 5000.0D as portfolio_value_usd, 700.0D as cash_usd")
    limits = gate.risk_limits(state, NOW, cash_usd=900.0, portfolio_value_usd=0.0)
    assert (limits.portfolio_value_usd, limits.cash_usd, limits.max_name_weight_ratio) == (5000.0, 900.0, 0.05)
    assert gate.reconciliation_fresh(limits)
    assert not gate.reconciliation_fresh(gate.risk_limits(state.filter(F.lit(False)), NOW))


def test_modes_are_enforced(spark):
    empty = spark.createDataFrame([], "decision_id string, intent_id string, security_id long, approved boolean, notional_usd double, created_at timestamp")
    with pytest.raises(ValueError, match="cannot stage"):
        gate.stageable(empty, empty, empty, "observe")
    with pytest.raises(ValueError, match="cannot send"):
        gate.submittable(empty, empty, "stage", LIMITS)


def test_tasks_do_not_grow_with_the_input(spark):
    """Behind the shuffle to securities a task sorts all that it reads: more rows make more tasks."""
    facts = spark.range(600_000).select(
        F.concat(F.lit("obs-"), F.xxhash64("id").cast("string")).alias("observation_id"), (F.col("id") % 50_000).alias("security_id"), F.lit(1).alias("metric_id"),
        F.rand(1).alias("value"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") / 50_000).cast("int")).alias("period_start"),
        F.date_add(F.lit("1990-04-01").cast("date"), (F.col("id") / 50_000).cast("int")).alias("period_end"), F.lit("1991-01-01").cast("timestamp").alias("available_at"),
        F.lit(0).cast("long").alias("quality_flags"), F.lit("flow").alias("metric_kind"), F.lit("fiscal_quarter").alias("period_semantics"), F.lit(101).alias("basis_id"),
        F.lit("selected").alias("observation_status"), F.lit(91).alias("duration_days"), F.lit("x").alias("dimensions_hash"))
    tasks = cut_lineage(ttm.period_shapes(facts)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in tasks) == 600_000
    assert max(r[1] for r in tasks) < 600_000 / 8
