"""Growth, valuation, portfolio and risk queries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binding import testdata as t
from binding.registry import query
from binding.statement_queries import bound_statements
from binding.views import view
from fundaflow.config import DEFAULT_SCENARIOS
from fundaflow.operators import gate, growth, portfolio, valuation
from fundaflow.session import cut_lineage

view("v_pairs", """
WITH d AS (SELECT * FROM v_model_comparable WHERE metric_id IN (1, 2)
  QUALIFY row_number() OVER (PARTITION BY security_id, metric_id, period_end, available_at ORDER BY basis_id, observation_id) = 1),
r AS (SELECT *, dense_rank() OVER (PARTITION BY security_id, metric_id ORDER BY period_end DESC) AS age,
  row_number() OVER (PARTITION BY security_id, metric_id, period_end ORDER BY available_at) AS up,
  row_number() OVER (PARTITION BY security_id, metric_id, period_end ORDER BY available_at DESC) AS down FROM d),
n AS (SELECT * FROM r WHERE age = 1 AND down = 1), f AS (SELECT * FROM r WHERE age = 1 AND up = 1), p AS (SELECT * FROM r WHERE age = 2 AND down = 1),
b AS (SELECT security_id, metric_id, bit_or(quality_flags) AS quality_flags FROM d GROUP BY ALL)
SELECT n.security_id, n.metric_id, n.period_end AS latest_end, n.value AS latest_value, CASE WHEN ok THEN pv END AS previous_value,
       CASE WHEN ok THEN pe END AS previous_end, b.quality_flags
FROM n JOIN b USING (security_id, metric_id)
LEFT JOIN (SELECT f.security_id, f.metric_id, p.value AS pv, p.period_end AS pe, f.metric_kind = p.metric_kind AND f.period_semantics = p.period_semantics
             AND f.basis_id = p.basis_id AND f.dimensions_hash = p.dimensions_hash AND f.duration_days > 0 AND p.duration_days > 0
             AND abs(f.duration_days - p.duration_days) <= 7 AS ok
           FROM f JOIN p USING (security_id, metric_id)) x USING (security_id, metric_id)
""")


@query("latest_two_facts", "G1", "security_id:i metric_id:i latest_end:d latest_value:f previous_value:f previous_end:d quality_flags:i",
       "SELECT * FROM v_pairs")
def latest_two_facts(spark, d):
    return growth.latest_two(t.facts(spark, d))


view("v_growth", """
SELECT *, CASE WHEN abs(previous_value) > 1e-12 THEN greatest(-0.5::DOUBLE, least(0.5::DOUBLE, (latest_value - previous_value) / abs(previous_value))) END AS growth
FROM v_pairs
""")


@query("clamped_growth", "G2", "security_id:i metric_id:i growth:f", "SELECT * FROM v_growth")
def clamped_growth(spark, d):
    return growth.latest_two(t.facts(spark, d)).withColumn(
        "growth", growth.clamped_growth(F.col("latest_value"), F.col("previous_value"), t.MODEL.max_forecast_abs_growth_ratio))


view("v_forecasts", """
WITH g AS (SELECT security_id, max(growth) FILTER (metric_id = 1) AS rev, max(growth) FILTER (metric_id = 2) AS earn, bit_or(quality_flags) AS seen FROM v_growth GROUP BY 1),
j AS (SELECT s.security_id, s.investable, rev, earn,
        coalesce(seen, 0) | CASE WHEN rev IS NULL OR earn IS NULL THEN 32 ELSE 0 END | CASE WHEN rev IS NULL AND earn IS NULL THEN 128 ELSE 0 END AS flags,
        CASE WHEN rev IS NOT NULL AND earn IS NOT NULL THEN rev * 0.70::DOUBLE + earn * 0.30::DOUBLE WHEN rev IS NOT NULL THEN rev * 0.50::DOUBLE ELSE earn * 0.25::DOUBLE END AS expected,
        CASE WHEN rev IS NOT NULL AND earn IS NOT NULL THEN 0.80::DOUBLE WHEN rev IS NOT NULL THEN 0.45::DOUBLE ELSE 0.30::DOUBLE END AS base,
        s.investable AND (rev IS NOT NULL OR earn IS NOT NULL) AS has_growth
      FROM v_securities s LEFT JOIN g USING (security_id)),
k AS (SELECT security_id, investable, has_growth, CASE WHEN investable THEN coalesce(rev, 0) ELSE 0 END AS revenue_growth_ratio,
        CASE WHEN investable THEN coalesce(earn, 0) ELSE 0 END AS earnings_growth_ratio,
        CASE WHEN has_growth THEN greatest(-0.5::DOUBLE, least(0.5::DOUBLE, expected)) ELSE 0 END AS expected_return_proxy,
        CASE WHEN has_growth THEN CASE WHEN flags <> 0 THEN base * 0.70::DOUBLE ELSE base END ELSE 0 END AS confidence_ratio,
        CASE WHEN investable THEN flags ELSE 0 END AS quality_flags FROM j)
SELECT *, CASE WHEN NOT has_growth THEN 'not investable or insufficient facts'
  WHEN expected_return_proxy > 0.02 AND confidence_ratio >= 0.20 THEN 'positive deterministic baseline score' ELSE 'below model threshold' END AS reason,
  expected_return_proxy > 0.02 AND confidence_ratio >= 0.20 AND investable AS eligible,
  CASE WHEN expected_return_proxy > 0.02 AND confidence_ratio >= 0.20 AND investable THEN expected_return_proxy * confidence_ratio ELSE 0 END AS score
FROM k
""")
FORECAST = "security_id:i revenue_growth_ratio:f earnings_growth_ratio:f expected_return_proxy:f confidence_ratio:f quality_flags:i reason:s"


@query("growth_forecasts", "G3", FORECAST, "SELECT * FROM v_forecasts")
def growth_forecasts(spark, d):
    return growth.forecasts(t.facts(spark, d), t.securities(spark, d), t.MODEL, t.NOW)


def _targets_sql(scored: str, reason: str) -> str:
    return f"""
SELECT s.security_id, coalesce(weight_ratio, 0) AS current_weight_ratio, w AS target_weight_ratio, w - coalesce(weight_ratio, 0) AS delta_weight_ratio,
       CASE WHEN gets THEN '{reason}' ELSE 'zero target' END AS reason
FROM (SELECT security_id, gets, CASE WHEN gets THEN greatest(0, least(0.01::DOUBLE, 0.5::DOUBLE * score / total)) ELSE 0 END AS w
      FROM (SELECT *, investable AND total > 1e-12 AND eligible AS gets FROM {scored}, (SELECT CAST(sum(CAST(score AS DECIMAL(38,18))) AS DOUBLE) AS total FROM {scored}))) s
LEFT JOIN v_positions p USING (security_id)"""


def _intents_sql(targets: str) -> str:
    return f"""
SELECT *, CASE WHEN delta_weight_ratio > 0 THEN 'buy' ELSE 'sell' END AS side FROM (SELECT *, abs(delta_weight_ratio * 1000000.0::DOUBLE) AS notional_usd FROM {targets})
WHERE notional_usd >= 100"""


view("v_plan_targets", _targets_sql("v_forecasts", portfolio.FORECAST_REASON))
view("v_plan_intents", _intents_sql("v_plan_targets"))
INTENT = "security_id:i side:s notional_usd:f6 current_weight_ratio:f9 target_weight_ratio:f9 reason:s"


@query("growth_plan_intents", "G4", INTENT, "SELECT * FROM v_plan_intents")
def growth_plan_intents(spark, d):
    from fundaflow.plans.runs import plan_run

    run = plan_run(t.facts(spark, d), t.securities(spark, d), t.positions(spark, d), t.MODEL, t.LIMITS, "plan-1",
                   F.lit(t.INSERTED_AT).cast("timestamp"))
    return run["order_intents"]


view("v_usable_statements", """
SELECT * FROM v_statements WHERE is_ttm AND security_id <> 0 AND isfinite(revenue_usd) AND revenue_usd > 0 AND isfinite(diluted_shares) AND diluted_shares > 0
""")


@query("usable_statements", "H1", "security_id:i period_end:d revenue_usd:f", """
SELECT * FROM v_usable_statements WHERE epoch(TIMESTAMP '2002-03-31') - epoch(available_at) <= 400 * 86400
""")
def usable_statements(spark, d):
    return valuation.usable_statements(bound_statements(spark, d), t.NOW, 400 * 86400)


view("v_latest_two", """
SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC, available_at DESC) AS age_rank FROM v_usable_statements QUALIFY age_rank <= 2
""")


@query("latest_two_statements", "H2", "security_id:i period_end:d age_rank:i revenue_usd:f net_debt_usd:f quality_flags:i", "SELECT * FROM v_latest_two")
def latest_two_statements(spark, d):
    return valuation.latest_two_statements(bound_statements(spark, d))


def _dcf_sql(s, revenue="revenue_usd", net_debt="net_debt_usd") -> str:
    flow, terms, discount = revenue, [], 1.0
    for _ in range(5):
        flow = f"({flow} * {1.0 + s.revenue_cagr_5y!r}::DOUBLE)"
        discount *= 1.0 + s.discount_rate
        terms.append(f"{flow} * {s.target_fcf_margin!r}::DOUBLE / {discount!r}::DOUBLE")
    end = (f"{flow} * {s.target_fcf_margin!r}::DOUBLE * {1.0 + s.terminal_revenue_growth!r}::DOUBLE * {s.terminal_fcf_multiple!r}::DOUBLE"
           f" / {discount!r}::DOUBLE")
    return f"({' + '.join(terms)} + {end} - {net_debt})"


_WEIGHTED = "((" + " + ".join(f"{_dcf_sql(s)} * {s.probability_weight!r}::DOUBLE" for s in DEFAULT_SCENARIOS) + ") / 1.0::DOUBLE)"


@query("scenario_dcf", "H3", "security_id:i period_end:d scenario:s equity_value_usd:f weighted_equity_usd:f", "\nUNION ALL ".join(
    f"SELECT security_id, period_end, '{s.name}' AS scenario, {_dcf_sql(s)} AS equity_value_usd, {_WEIGHTED} AS weighted_equity_usd FROM v_usable_statements"
    for s in DEFAULT_SCENARIOS))
def scenario_dcf(spark, d):
    return valuation.dcf(valuation.usable_statements(bound_statements(spark, d)))


def _factors(flags: str, factors: dict[str, float], start: str) -> str:
    from fundaflow.vocab import STMT

    for name, factor in factors.items():
        start = f"({start} * CASE WHEN {flags} & {STMT[name]} <> 0 THEN {factor!r}::DOUBLE ELSE 1.0::DOUBLE END)"
    return start


view("v_valuations", f"""
WITH p AS (SELECT a.*, b.security_id IS NOT NULL AS has_previous FROM (SELECT * FROM v_latest_two WHERE age_rank = 1) a
           LEFT JOIN (SELECT security_id FROM v_latest_two WHERE age_rank = 2) b USING (security_id)),
j AS (SELECT s.security_id, s.investable, s.adv_usd, s.price_usd, p.* EXCLUDE (security_id), {_WEIGHTED} AS equity,
        CASE WHEN NOT s.investable THEN 'not investable' WHEN p.security_id IS NULL THEN 'missing usable statement' WHEN NOT price_usd > 0 THEN 'missing market price' END AS refused
      FROM v_securities s LEFT JOIN p USING (security_id)),
k AS (SELECT *, equity / diluted_shares AS per_share, price_usd * diluted_shares AS mcap,
        {_factors('quality_flags', valuation.CONFIDENCE_FACTORS, "CASE WHEN has_previous THEN 0.9::DOUBLE ELSE 0.9::DOUBLE * 0.7::DOUBLE END")} AS conf FROM j),
l AS (SELECT security_id, investable, adv_usd, price_usd AS current_price_usd, CASE WHEN refused IS NULL THEN per_share ELSE 0 END AS intrinsic_value_per_share_usd,
        CASE WHEN refused IS NULL THEN (per_share - price_usd) / price_usd ELSE 0 END AS expected_return_ratio,
        CASE WHEN refused IS NULL THEN mcap ELSE 0 END AS market_cap_usd, CASE WHEN refused IS NULL THEN mcap + net_debt_usd ELSE 0 END AS enterprise_value_usd,
        CASE WHEN refused IS NULL THEN free_cash_flow_usd / mcap ELSE 0 END AS fcf_yield_ratio, CASE WHEN refused IS NULL THEN net_debt_usd ELSE 0 END AS net_debt_usd,
        CASE WHEN refused IS NULL THEN conf ELSE 0 END AS confidence_ratio, CASE WHEN refused IS NULL THEN quality_flags ELSE 128 END AS quality_flags, refused FROM k)
SELECT *, coalesce(refused, CASE WHEN expected_return_ratio > 0.15 AND confidence_ratio >= 0.50 THEN 'positive valuation spread with sufficient confidence'
  ELSE 'valuation spread or confidence below threshold' END) AS reason FROM l
""")
VALUATION = ("security_id:i current_price_usd:f intrinsic_value_per_share_usd:f expected_return_ratio:f market_cap_usd:f enterprise_value_usd:f "
             "fcf_yield_ratio:f net_debt_usd:f confidence_ratio:f quality_flags:i reason:s")


def bound_valuations(spark, d):
    return valuation.valuations(bound_statements(spark, d), t.securities(spark, d))


@query("valuations", "H4", VALUATION, "SELECT * FROM v_valuations")
def valuations(spark, d):
    return bound_valuations(spark, d)


view("v_scores", f"""
SELECT *, score > 0 AS eligible FROM (SELECT *, CASE WHEN adv_usd >= 31000 AND expected_return_ratio > 0 AND confidence_ratio >= 0.5
  THEN greatest(0, least(2, expected_return_ratio * confidence_ratio * ({_factors('quality_flags', valuation.SCORE_PENALTIES, '1.0::DOUBLE')}
    * CASE WHEN net_debt_usd > 0 AND market_cap_usd > 1e-12 THEN 1.0::DOUBLE / (1.0::DOUBLE + greatest(0, least(3, net_debt_usd / market_cap_usd))) ELSE 1.0::DOUBLE END)))
  ELSE 0 END AS score FROM v_valuations)
""")


@query("valuation_scores", "H5", "security_id:i score:f9", "SELECT * FROM v_scores")
def valuation_scores(spark, d):
    return valuation.valuation_scores(bound_valuations(spark, d), t.LIMITS)


view("v_targets", _targets_sql("v_scores", portfolio.VALUE_REASON))
view("v_intents", _intents_sql("v_targets"))


def bound_targets(spark, d):
    return portfolio.targets(valuation.valuation_scores(bound_valuations(spark, d), t.LIMITS), t.positions(spark, d), t.MODEL)


@query("target_weights", "H6", "security_id:i current_weight_ratio:f9 target_weight_ratio:f9 delta_weight_ratio:f9 reason:s", "SELECT * FROM v_targets")
def target_weights(spark, d):
    return bound_targets(spark, d)


@query("order_intents", "H7", INTENT, "SELECT * FROM v_intents")
def order_intents(spark, d):
    return portfolio.intents(bound_targets(spark, d), t.MODEL, t.LIMITS)


@query("model_input_violations", "H8", "rule:s subject:s", """
SELECT 'security_id must be nonzero' AS rule, cik AS subject FROM v_securities WHERE security_id - 1 = 0
UNION ALL SELECT 'position weight out of range', CAST(security_id AS VARCHAR) FROM v_positions WHERE abs(weight_ratio * 300) > 10
UNION ALL SELECT 'max_name_weight_ratio out of range', 'settings'
UNION ALL SELECT 'invalid valuation scenario: base.discount_rate', 'settings'
""")
def model_input_violations(spark, d):
    shifted = t.securities(spark, d).withColumn("security_id", F.col("security_id") - 1)
    heavy = t.positions(spark, d).withColumn("weight_ratio", F.col("weight_ratio") * 300)
    bad = [replace(s, discount_rate=0.01) if s.name == "base" else s for s in DEFAULT_SCENARIOS]
    return portfolio.validate_model_inputs(shifted, heavy, replace(t.MODEL, max_name_weight_ratio=0.0), t.LIMITS, bad)


@query("value_run_intents", "H9", f"run_id:s {INTENT}", "SELECT 'value-1' AS run_id, * FROM v_intents")
def value_run_intents(spark, d):
    from fundaflow.plans.runs import value_run

    run = value_run(t.facts(spark, d), t.securities(spark, d), t.positions(spark, d), t.MODEL, t.LIMITS, "value-1",
                    F.lit(t.INSERTED_AT).cast("timestamp"))
    return run["order_intents"]


# ---- risk gate -------------------------------------------------------------------------------

def bound_intents(spark, d) -> DataFrame:
    """Intents of the valuation run, some bent so that every rejection reason occurs."""
    rows = portfolio.intents(bound_targets(spark, d), t.MODEL, t.LIMITS, "value-1",
                             F.lit("2002-03-31 00:00:00").cast("timestamp"))
    s = F.col("security_id")
    return cut_lineage(rows).select(
        F.concat(F.lit("intent-"), s.cast("string")).alias("intent_id"),
        F.when(s % 2 == 0, F.lit("run-even")).otherwise(F.lit("run-odd")).alias("run_id"),
        F.when(s % 23 == 5, s + 1_000_000).otherwise(s).alias("security_id"),
        F.when(s % 11 == 3, F.lit("none")).otherwise(F.col("side")).alias("side"),
        F.when(s % 13 == 6, F.col("notional_usd") * 0.001).when(s % 17 == 8, F.col("notional_usd") + 1e6)
        .otherwise(F.col("notional_usd")).alias("notional_usd"),
        "current_weight_ratio",
        F.when(s % 19 == 9, F.lit(0.5)).otherwise(F.col("target_weight_ratio")).alias("target_weight_ratio"),
        "reason",
        (F.col("created_at") + F.make_interval(mins=(s % 60).cast("int"))).alias("created_at"),
    )


view("v_bent_intents", """
SELECT 'intent-' || security_id AS intent_id, CASE WHEN security_id % 2 = 0 THEN 'run-even' ELSE 'run-odd' END AS run_id,
  CASE WHEN security_id % 23 = 5 THEN security_id + 1000000 ELSE security_id END AS security_id, CASE WHEN security_id % 11 = 3 THEN 'none' ELSE side END AS side,
  CASE WHEN security_id % 13 = 6 THEN notional_usd * 0.001::DOUBLE WHEN security_id % 17 = 8 THEN notional_usd + 1e6 ELSE notional_usd END AS notional_usd,
  current_weight_ratio, CASE WHEN security_id % 19 = 9 THEN 0.5 ELSE target_weight_ratio END AS target_weight_ratio, reason,
  TIMESTAMP '2002-03-31' + to_minutes(CAST(security_id % 60 AS INTEGER)) AS created_at
FROM v_intents
""")


def _gate_sql(label: str, fresh: bool, cash: str) -> str:
    return f"""
SELECT '{label}' AS variant, intent_id, i.security_id, side, notional_usd, i.run_id, created_at, CASE
  WHEN {str(not fresh).upper()} THEN 'broker reconciliation is missing or stale' WHEN s.security_id IS NULL THEN 'security not found'
  WHEN NOT investable THEN 'security not investable' WHEN side NOT IN ('buy', 'sell') THEN 'invalid order side'
  WHEN notional_usd < 100 THEN 'notional below minimum or invalid' WHEN notional_usd > 30000 THEN 'order notional exceeds hard limit'
  WHEN abs(target_weight_ratio) > 0.05 THEN 'target weight exceeds name limit' WHEN adv_usd < 31000 THEN 'liquidity below minimum ADV'
  WHEN notional_usd > adv_usd * 0.60 THEN 'order exceeds ADV participation limit'
  WHEN side = 'buy' AND (SELECT sum(notional_usd) FROM v_bent_intents WHERE side = 'buy' AND notional_usd > 0) > {cash} THEN 'aggregate buy notional exceeds cash'
  ELSE '{gate.APPROVED}' END AS decision_reason
FROM v_bent_intents i LEFT JOIN v_securities s ON s.security_id = i.security_id"""


view("v_decided", _gate_sql("fresh", True, "1e12"))


@query("risk_gate", "I3", "variant:s intent_id:s decision_reason:s approved:b",
       "SELECT *, decision_reason = '" + gate.APPROVED + "' AS approved FROM (" + "\nUNION ALL ".join(
           [_gate_sql("fresh", True, "1e12"), _gate_sql("stale", False, "1e12"), _gate_sql("no_cash", True, "1000")]) + ")")
def risk_gate(spark, d):
    rows, sec = bound_intents(spark, d), t.securities(spark, d)
    variants = {
        "fresh": t.LIMITS,
        "stale": replace(t.LIMITS, max_reconciliation_age_s=60),
        "no_cash": replace(t.LIMITS, cash_usd=1000.0),
    }
    return reduce(DataFrame.unionByName, [
        gate.risk_gate(rows, sec, limits).withColumn("variant", F.lit(name)) for name, limits in variants.items()])


@query("gate_from_broker_state", "I1", "books:s intent_id:s decision_reason:s cash_usd:f portfolio_value_usd:f reconciled:b", f"""
SELECT books, intent_id, decision_reason, cash_usd, portfolio_value_usd, reconciled FROM (
  SELECT variant AS books, intent_id, decision_reason FROM ({_gate_sql("fresh", True, "(SELECT sum(l_extendedprice) FROM lineitem)")} UNION ALL {_gate_sql("stale", False, "0")} UNION ALL {_gate_sql("poor", True, "1000")})
) JOIN (SELECT 'fresh' AS books, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS cash_usd, 1000000.0::DOUBLE AS portfolio_value_usd, TRUE AS reconciled FROM lineitem
  UNION ALL SELECT 'stale', CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE), 1000000.0::DOUBLE, TRUE FROM lineitem
  UNION ALL SELECT 'poor', 1000.0::DOUBLE, 1000000.0::DOUBLE, TRUE) USING (books)
""")
def gate_from_broker_state(spark, d):
    """Limits from stored books: cash as traded, checked half an hour or two hours ago; and an override of the cash."""
    rows, sec = bound_intents(spark, d), t.securities(spark, d)
    cash = t.table(spark, d, "lineitem").agg(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double").alias("cash_usd"))
    books = cash.select(F.lit(True).alias("reconciled"), F.lit(1_000_000.0).alias("portfolio_value_usd"), "cash_usd")
    bounds = {name: getattr(t.LIMITS, name) for name in ("max_name_weight_ratio", "max_order_notional_usd", "min_adv_usd", "max_adv_participation_ratio")}
    found = []
    for name, minutes, cash_usd in (("fresh", 30, 0.0), ("stale", 120, 0.0), ("poor", 30, 1000.0)):
        checked = books.withColumn("checked_at", F.lit(t.INSERTED_AT).cast("timestamp") - F.make_interval(mins=F.lit(minutes)))
        limits = gate.risk_limits(checked, t.NOW, cash_usd=cash_usd, **bounds)
        found.append(gate.risk_gate(rows, sec, limits).select(
            F.lit(name).alias("books"), "intent_id", "decision_reason", F.lit(limits.cash_usd).alias("cash_usd"),
            F.lit(limits.portfolio_value_usd).alias("portfolio_value_usd"), F.lit(limits.broker_reconciled).alias("reconciled")))
    return reduce(DataFrame.unionByName, found)


@query("reconciliation_status", "I2", "security_id:i is_fresh:b", """
SELECT security_id, (security_id % 5 <> 0) AND (security_id % 90) * 60 <= 3600 AS is_fresh FROM v_securities
""")
def reconciliation_status(spark, d):
    """One books check per issuer, from 0 to 89 minutes old."""
    s = F.col("security_id")
    books = t.securities(spark, d).select(
        "security_id", (s % 5 != 0).alias("reconciled"),
        (F.lit("2002-03-31 00:00:00").cast("timestamp") - F.make_interval(mins=(s % 90).cast("int"))).alias("checked_at"))
    return gate.reconciliation_status(books, F.lit("2002-03-31 00:00:00").cast("timestamp"), 3600)


def _decisions(spark, d) -> DataFrame:
    """Decisions taken on the even run only."""
    rows = bound_intents(spark, d)
    none = rows.filter(F.lit(False)).select("intent_id")
    return gate.gate_run(rows, none, t.securities(spark, d), t.LIMITS, F.lit("2002-03-31 02:00:00").cast("timestamp"), "run-even")


@query("pending_intents", "I4", "intent_id:s run_id:s", "SELECT * FROM v_bent_intents WHERE run_id = 'run-odd'")
def pending_intents(spark, d):
    return gate.pending_intents(bound_intents(spark, d), _decisions(spark, d))


@query("gate_run_decisions", "I7", "intent_id:s security_id:i approved:b reason:s notional_usd:f6",
       f"SELECT *, decision_reason = '{gate.APPROVED}' AS approved, decision_reason AS reason FROM v_decided WHERE run_id = 'run-even'")
def gate_run_decisions(spark, d):
    return _decisions(spark, d)


@query("stageable_orders", "I5", "intent_id:s security_id:i side:s notional_usd:f6",
       f"SELECT * FROM v_decided WHERE run_id = 'run-even' AND decision_reason = '{gate.APPROVED}' AND security_id % 3 <> 0")
def stageable_orders(spark, d):
    decisions = _decisions(spark, d)
    staged = decisions.filter(F.col("security_id") % 3 == 0).select("decision_id")
    return gate.stageable(decisions, bound_intents(spark, d), staged, "stage", run_id="run-even")


@query("submittable_orders", "I6", "intent_id:s security_id:i",
       f"SELECT * FROM v_decided WHERE decision_reason = '{gate.APPROVED}' AND security_id % 4 <> 0")
def submittable_orders(spark, d):
    """Orders of both runs, staged as a stream would stage them; a quarter is already submitted."""
    rows, moment = bound_intents(spark, d), F.lit("2002-03-31 02:00:00").cast("timestamp")
    decisions = gate.gate_run(rows, rows.filter(F.lit(False)).select("intent_id"), t.securities(spark, d), t.LIMITS, moment)
    staged = gate.stage(gate.stageable(decisions, rows, decisions.filter(F.lit(False)).select("decision_id"), "stage"), moment)
    events = staged.select(
        "staged_order_id",
        F.when(F.col("security_id") % 4 == 0, F.lit("mock_order_submitted")).otherwise(F.lit("acknowledged")).alias("event_type"))
    return gate.submittable(staged, events, "paper", t.LIMITS)
