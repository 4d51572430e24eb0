"""Scenario discounted-cash-flow valuation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow import vocab
from fundaflow.config import DEFAULT_SCENARIOS, SCENARIO_RANGES, RiskLimits, Scenario
from fundaflow.functions.flags import has_any
from fundaflow.functions.numbers import TINY, clamp, is_finite
from fundaflow.operators.select import is_fresh

# Confidence multiplier per statement bit.
CONFIDENCE_FACTORS = {
    "missing_cash": 0.85, "missing_debt": 0.85, "missing_operating_cash_flow": 0.55, "missing_capex": 0.70,
    "negative_fcf": 0.75, "non_comparable_period": 0.60, "amended_or_restated": 0.65, "low_confidence": 0.50,
}
SCORE_PENALTIES = {"negative_fcf": 0.50, "amended_or_restated": 0.50, "low_confidence": 0.25}
FORECAST_YEARS = 5


def usable_statements(statements: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    keep = (
        F.col("is_ttm")
        & (F.col("security_id") != 0)
        & (F.col("period_end") > F.lit("1970-01-01").cast("date"))
        & F.coalesce(F.unix_seconds("available_at") > 0, F.lit(False))
        & is_finite(F.col("revenue_usd")) & (F.col("revenue_usd") > 0)
        & is_finite(F.col("diluted_shares")) & (F.col("diluted_shares") > 0)
    )
    rows = statements.filter(keep)
    return rows if now is None else rows.filter(is_fresh(now, max_age_s))


def latest_two_statements(statements: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """Newest statement of each security (`age_rank` 1) and the newest of an older end (2).

    Of equal ends and availability the greatest snapshot id counts, or without ids the greatest content, so the
    choice does not depend on partitions.
    """
    rows = usable_statements(statements, now, max_age_s)
    first = [c for c in ("available_at", "snapshot_id") if c in rows.columns]
    rest = [c for c in rows.columns if c not in ("security_id", "period_end", *first)]
    per_end = rows.groupBy("security_id", "period_end").agg(F.max(F.struct(*first, *rest)).alias("s"))
    newest_first = W.partitionBy("security_id").orderBy(F.col("period_end").desc())
    ranked = per_end.withColumn("age_rank", F.row_number().over(newest_first)).filter("age_rank <= 2")
    return ranked.select("security_id", "period_end", "age_rank", *[F.col(f"s.{c}") for c in rows.columns if c not in ("security_id", "period_end")])


def check_scenarios(scenarios: Sequence[Scenario]) -> list[str]:
    """Names of broken rules; empty when the set may be used."""
    broken = []
    if not scenarios:
        broken.append("at least one valuation scenario is required")
    for s in scenarios:
        for name, (low, high) in SCENARIO_RANGES.items():
            if not low <= getattr(s, name) <= high:
                broken.append(f"invalid valuation scenario: {s.name}.{name}")
    return broken


def dcf_equity_value(revenue: Column, net_debt: Column, s: Scenario) -> Column:
    """Five discounted years of cash flow plus terminal value, less net debt."""
    flow, value, discount = revenue, None, 1.0
    for _ in range(FORECAST_YEARS):
        flow = flow * F.lit(1.0 + s.revenue_cagr_5y)
        discount *= 1.0 + s.discount_rate
        year = flow * F.lit(s.target_fcf_margin) / F.lit(discount)
        value = year if value is None else value + year
    terminal = flow * F.lit(s.target_fcf_margin) * F.lit(1.0 + s.terminal_revenue_growth) * F.lit(s.terminal_fcf_multiple)
    return value + terminal / F.lit(discount) - net_debt


def weighted_equity_value(revenue: Column, net_debt: Column, scenarios: Sequence[Scenario]) -> Column:
    """Probability-weighted mean over the scenarios; NULL when the weights vanish."""
    weight = sum(s.probability_weight for s in scenarios)
    if weight <= TINY:
        return F.lit(None).cast("double")
    total = None
    for s in scenarios:
        term = dcf_equity_value(revenue, net_debt, s) * F.lit(s.probability_weight)
        total = term if total is None else total + term
    return total / F.lit(weight)


def dcf(statements: DataFrame, scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS) -> DataFrame:
    """One row per statement and scenario, then the weighted value alongside.

    Scenarios are a short list of literals, so they are unrolled into the projection instead
    of being joined.
    """
    each = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.lit(s.probability_weight).alias("probability_weight"),
                 dcf_equity_value(F.col("revenue_usd"), F.col("net_debt_usd"), s).alias("equity_value_usd"))
        for s in scenarios
    ])
    weighted = weighted_equity_value(F.col("revenue_usd"), F.col("net_debt_usd"), scenarios)
    return statements.select("security_id", "period_end", weighted.alias("weighted_equity_usd"), F.inline(each))


def _product(flags: Column, factors: dict[str, float], start: Column) -> Column:
    for name, factor in factors.items():
        start = start * F.when(has_any(flags, vocab.STMT[name]), F.lit(factor)).otherwise(F.lit(1.0))
    return start


def statement_confidence(flags: Column, has_previous: Column) -> Column:
    start = F.when(has_previous, F.lit(0.90)).otherwise(F.lit(0.90) * F.lit(0.70))
    return clamp(_product(flags, CONFIDENCE_FACTORS, start), 0.0, 1.0)


def valuations(statements: DataFrame, securities: DataFrame,
               scenarios: Sequence[Scenario] = DEFAULT_SCENARIOS,
               now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """One valuation per security, valued or not."""
    pair = latest_two_statements(statements, now, max_age_s).groupBy("security_id").agg(
        F.max(F.when(F.col("age_rank") == 1, F.struct(
            "revenue_usd", "diluted_shares", "free_cash_flow_usd", "net_debt_usd", "quality_flags"))).alias("latest"),
        (F.max("age_rank") == 2).alias("has_previous"),
    )
    latest, price = F.col("latest"), F.col("price_usd")
    equity = weighted_equity_value(latest["revenue_usd"], latest["net_debt_usd"], scenarios)
    market_cap = price * latest["diluted_shares"]
    refused = (
        F.when(~F.col("investable"), F.lit("not investable"))
        .when(latest.isNull(), F.lit("missing usable statement"))
        .when(~is_finite(price) | (price <= 0), F.lit("missing market price"))
        .when(F.col("equity").isNull(), F.lit("zero scenario weight"))
    )
    valued = F.col("refused").isNull()

    def number(c: Column) -> Column:
        return F.when(valued, c).otherwise(F.lit(0.0))

    per_share = F.col("equity") / latest["diluted_shares"]
    return (
        securities.select("security_id", "investable", "price_usd", "adv_usd")
        .join(pair, "security_id", "left")
        .withColumn("equity", equity)
        .withColumn("refused", refused)
        .select(
            "security_id", "investable", "adv_usd",
            price.alias("current_price_usd"),
            number(per_share).alias("intrinsic_value_per_share_usd"),
            number(F.try_divide(per_share - price, price)).alias("expected_return_ratio"),
            number(market_cap).alias("market_cap_usd"),
            number(market_cap + latest["net_debt_usd"]).alias("enterprise_value_usd"),
            number(F.when(market_cap > TINY, latest["free_cash_flow_usd"] / market_cap).otherwise(0.0)).alias("fcf_yield_ratio"),
            number(latest["net_debt_usd"]).alias("net_debt_usd"),
            number(statement_confidence(latest["quality_flags"], F.col("has_previous"))).alias("confidence_ratio"),
            F.when(valued, latest["quality_flags"]).otherwise(F.lit(vocab.STMT["low_confidence"])).cast("long").alias("quality_flags"),
            "refused",
        )
        .withColumn(
            "reason",
            F.coalesce(
                "refused",
                F.when(
                    (F.col("expected_return_ratio") > 0.15) & (F.col("confidence_ratio") >= 0.50),
                    F.lit("positive valuation spread with sufficient confidence"),
                ).otherwise(F.lit("valuation spread or confidence below threshold")),
            ),
        )
        .drop("refused")
    )


def valuation_score() -> Column:
    """Score of a valuation row before the liquidity test."""
    ret, conf, debt, cap = (F.col(n) for n in ("expected_return_ratio", "confidence_ratio", "net_debt_usd", "market_cap_usd"))
    penalty = _product(F.col("quality_flags"), SCORE_PENALTIES, F.lit(1.0))
    leverage = F.when(
        (debt > 0) & (cap > TINY), F.lit(1.0) / (F.lit(1.0) + clamp(F.try_divide(debt, cap), 0.0, 3.0))
    ).otherwise(F.lit(1.0))
    usable = is_finite(ret) & is_finite(conf) & (ret > 0) & (conf >= 0.50)
    return F.when(usable, clamp(ret * conf * (penalty * leverage), 0.0, 2.0)).otherwise(F.lit(0.0))


def valuation_scores(rows: DataFrame, limits: RiskLimits) -> DataFrame:
    """Valuations with their liquidity-adjusted score."""
    liquid = is_finite(F.col("adv_usd")) & (F.col("adv_usd") >= limits.min_adv_usd)
    scored = rows.withColumn("score", F.when(liquid, valuation_score()).otherwise(F.lit(0.0)))
    return scored.withColumn("eligible", F.col("score") > 0)
