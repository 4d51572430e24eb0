"""Run parameters.  Small, fixed-size values that travel as literals in the plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class ModelConfig:
    target_gross_exposure_ratio: float = 0.50
    max_name_weight_ratio: float = 0.10
    min_expected_return_proxy: float = 0.02
    min_abs_order_notional_usd: float = 100.0
    max_forecast_abs_growth_ratio: float = 1.0
    max_fact_age_s: int = 0


@dataclass(frozen=True)
class Scenario:
    name: str
    probability_weight: float
    revenue_cagr_5y: float
    terminal_revenue_growth: float
    target_fcf_margin: float
    discount_rate: float
    terminal_fcf_multiple: float


# The default bear / base / bull assumption set.
DEFAULT_SCENARIOS = (
    Scenario("bear", 0.25, -0.02, 0.00, 0.06, 0.12, 10.0),
    Scenario("base", 0.50, 0.04, 0.02, 0.12, 0.10, 16.0),
    Scenario("bull", 0.25, 0.10, 0.03, 0.18, 0.09, 22.0),
)

# Accepted range of every scenario parameter.
SCENARIO_RANGES = {
    "revenue_cagr_5y": (-0.80, 1.00),
    "terminal_revenue_growth": (-0.20, 0.08),
    "target_fcf_margin": (-0.50, 0.60),
    "discount_rate": (0.03, 0.40),
    "terminal_fcf_multiple": (0.0, 60.0),
    "probability_weight": (0.0, 1.0),
}
# What the reference's fixed buffers and request pacing allow.  No operator has them as a default;
# pass them where its numbers are wanted.
REFERENCE_ANCHORS, REFERENCE_SCENARIOS = 12, 3
REFERENCE_FORM_LIMITS = {"annual": 4, "quarterly": 12, "other": 1}


@dataclass(frozen=True)
class RiskLimits:
    now: datetime
    portfolio_value_usd: float = 0.0
    cash_usd: float = 0.0
    max_name_weight_ratio: float = 0.05
    max_order_notional_usd: float = 10_000.0
    min_adv_usd: float = 1_000_000.0
    max_adv_participation_ratio: float = 0.01
    min_abs_order_notional_usd: float = 100.0
    broker_reconciled: bool = False
    reconciliation_checked_at: datetime | None = None
    max_reconciliation_age_s: int = 3600


@dataclass(frozen=True)
class FormLimits:
    """Newest filings per issuer and form group; None takes all, 0 leaves the group out."""

    annual: int | None = None
    quarterly: int | None = None
    other: int | None = None
    forms: str = field(default="10-K,10-K/A,10-Q,10-Q/A")
