"""Literal frames for small cases."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from fundaflow import vocab

FACT_SCHEMA = ("observation_id string, security_id long, metric_id int, value double, period_start date, period_end date, "
               "available_at timestamp, quality_flags long, metric_kind string, period_semantics string, basis_id int, "
               "observation_status string, duration_days int, dimensions_hash string")
SECURITY_SCHEMA = "security_id long, cik string, symbol string, investable boolean, price_usd double, adv_usd double, peer_group string, sector string, industry string"
BASIS = {1: 104, 2: 201, 3: 301, 4: 401, 5: 501, 6: 601, 7: 701, 8: 801}
_counter = [0]


def fact(security, metric, value, start, end, semantics="fiscal_quarter", lag=40, flags=0, basis=None, status="selected",
         kind=None, dims="total", available=None, ident=None):
    _counter[0] += 1
    start = date.fromisoformat(start) if isinstance(start, str) else start
    end = date.fromisoformat(end) if isinstance(end, str) else end
    days = 0 if semantics == "instant" else (end - start).days + 1
    when = available or datetime(end.year, end.month, end.day, tzinfo=timezone.utc) + timedelta(days=lag)
    return (ident or f"o{_counter[0]:06d}", security, metric, float(value), start, end, when, flags, kind or vocab.METRICS[metric][1],
            semantics, basis or BASIS[metric], status, days, dims)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)


def securities(spark, rows):
    full = [(i, f"{i:010d}", f"S{i}", inv, float(p), float(adv), "", "", "") for i, inv, p, adv in rows]
    return spark.createDataFrame(full, SECURITY_SCHEMA)


def positions(spark, rows=()):
    return spark.createDataFrame(
        [(i, 0.0, 0.0, float(w)) for i, w in rows],
        "security_id long, quantity_shares double, market_value_usd double, weight_ratio double")


STATEMENT_SCHEMA = ("security_id long, period_start date, period_end date, available_at timestamp, is_ttm boolean, revenue_usd double, "
                    "net_income_usd double, diluted_eps_usd double, diluted_shares double, operating_cash_flow_usd double, capex_usd double, "
                    "free_cash_flow_usd double, cash_usd double, debt_usd double, net_debt_usd double, quality_flags long")


def statement(security, end, revenue=1000e6, shares=100e6, net_debt=-200e6, flags=0, lag=45, fcf=100e6):
    end = date.fromisoformat(end)
    when = datetime(end.year, end.month, end.day, tzinfo=timezone.utc) + timedelta(days=lag)
    return (security, end - timedelta(days=364), end, when, True, float(revenue), 100e6, 1.0, float(shares), fcf + 20e6, 20e6, float(fcf),
            250e6, 250e6 + net_debt, float(net_debt), flags)


def statements(spark, rows):
    return spark.createDataFrame(rows, STATEMENT_SCHEMA)
