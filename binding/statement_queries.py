"""Selection, trailing-twelve-month and statement queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from binding import testdata as t
from binding.registry import query
from binding.views import VIEWS, view
from fundaflow.config import REFERENCE_ANCHORS
from fundaflow.operators import select, statements, ttm

FACT = "security_id:i metric_id:i period_end:d"
POINT = f"{FACT} value:f period_start:d available_at:t quality_flags:i"


@query("usable_facts", "E1", "metric_id:i n:i total:f2",
       "SELECT metric_id, count(*) AS n, sum(CAST(round(value, 4) AS DECIMAL(38,4))) AS total FROM v_usable GROUP BY 1")
def usable_facts(spark, d):
    return select.usable(t.facts(spark, d)).groupBy("metric_id").agg(
        F.count("*").alias("n"), F.sum(F.round("value", 4).cast("decimal(38,4)")).alias("total")
    )


@query("fresh_facts", "E2", f"{FACT} observation_id:s", """
SELECT * FROM v_facts WHERE epoch(TIMESTAMP '2002-03-31') - epoch(available_at) <= 200 * 86400
""")
def fresh_facts(spark, d):
    return select.fresh(t.facts(spark, d), t.NOW, 200 * 86400)


@query("flow_classes", "E3", "flow_class:s metric_id:i n:i",
       "SELECT flow_class, metric_id, count(*) AS n FROM v_tagged GROUP BY ALL")
def flow_classes(spark, d):
    return select.tag_flow_class(select.usable(t.facts(spark, d))).groupBy("flow_class", "metric_id").agg(
        F.count("*").alias("n"))


view("v_points", """
SELECT * FROM v_usable WHERE (metric_id IN (7, 8) AND metric_kind = 'instant' AND period_semantics = 'instant')
   OR (metric_id = 4 AND metric_kind IN ('flow', 'per_share_flow') AND period_semantics IN ('fiscal_quarter', 'fiscal_ytd', 'fiscal_year'))
""")


@query("point_facts", "E4", f"{FACT} observation_id:s value:f", "SELECT * FROM v_points")
def point_facts(spark, d):
    return select.point_facts(t.facts(spark, d))


view("v_model_comparable", """
SELECT * FROM v_usable WHERE CASE WHEN metric_id IN (4, 7, 8) THEN metric_kind = 'instant' AND period_semantics = 'instant'
  ELSE metric_kind IN ('flow', 'per_share_flow') AND period_semantics = 'fiscal_quarter' AND duration_days BETWEEN 70 AND 110 END
""")


@query("model_comparable_facts", "E5", f"{FACT} observation_id:s value:f", "SELECT * FROM v_model_comparable")
def model_comparable_facts(spark, d):
    return select.model_comparable(t.facts(spark, d))


@query("comparable_successors", "E6", f"{FACT} previous_end:d is_comparable:b", """
SELECT security_id, metric_id, period_end, p.period_end AS previous_end,
       p.metric_kind = c.metric_kind AND p.period_semantics = c.period_semantics AND p.basis_id = c.basis_id AND p.dimensions_hash = c.dimensions_hash
       AND p.duration_days > 0 AND c.duration_days > 0 AND abs(p.duration_days - c.duration_days) <= 7 AS is_comparable
FROM (SELECT *, lag(observation_id) OVER (PARTITION BY security_id, metric_id ORDER BY period_end, available_at, basis_id, observation_id) AS previous_id FROM v_usable) c
JOIN (SELECT observation_id, period_end, metric_kind, period_semantics, basis_id, dimensions_hash, duration_days FROM v_usable) p ON p.observation_id = c.previous_id
""".replace("SELECT security_id, metric_id, period_end, p.", "SELECT c.security_id, c.metric_id, c.period_end, p.", 1))
def comparable_successors(spark, d):
    """Each fact against the one before it on the timeline of its metric."""
    w = t.W.partitionBy("security_id", "metric_id").orderBy("period_end", "available_at", "basis_id", "observation_id")
    rows = select.usable(t.facts(spark, d)).withColumn("this", select.period_struct())
    rows = rows.withColumn("before", F.lag("this").over(w)).withColumn("previous_end", F.lag("period_end").over(w))
    return rows.filter(F.col("before").isNotNull()).withColumn(
        "is_comparable", select.comparable(F.col("this"), F.col("before")))


view("v_anchors", """
SELECT security_id, period_end, row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) AS anchor_rank
FROM (SELECT DISTINCT f.security_id, f.period_end FROM v_tagged f JOIN v_securities s ON s.security_id = f.security_id
      WHERE s.investable AND metric_id = 1 AND flow_class IN ('quarter', 'annual'))
QUALIFY anchor_rank <= 12
""")


@query("statement_anchors", "F1", "security_id:i period_end:d anchor_rank:i", "SELECT * FROM v_anchors")
def statement_anchors(spark, d):
    return ttm.anchors(t.facts(spark, d), t.securities(spark, d), REFERENCE_ANCHORS)


view("v_ttm_annual", """
SELECT security_id, metric_id, period_end, value, period_start, available_at, quality_flags FROM v_tagged
WHERE flow_class = 'annual' AND metric_id IN (1, 2, 3, 5, 6)
QUALIFY row_number() OVER (PARTITION BY security_id, metric_id, period_end ORDER BY available_at DESC, basis_id, observation_id) = 1
""")


@query("ttm_annual", "F2", POINT, "SELECT * FROM v_ttm_annual")
def ttm_annual(spark, d):
    return ttm.ttm_annual(t.facts(spark, d))


# The oracle walks every quarter end and ranks the older ones by hand.
view("v_quarter_rows", """
SELECT * FROM v_tagged WHERE flow_class = 'quarter' AND metric_id IN (1, 2, 3, 5, 6)
QUALIFY row_number() OVER (PARTITION BY security_id, metric_id, period_end ORDER BY available_at DESC, basis_id, observation_id) = 1
""")
view("v_ttm_quarters", """
SELECT security_id, metric_id, anchor_day AS period_end,
       max(value) FILTER (r = 1) + max(value) FILTER (r = 2) + max(value) FILTER (r = 3) + max(value) FILTER (r = 4) AS value,
       min(period_start) AS period_start, max(available_at) AS available_at, bit_or(quality_flags) AS quality_flags
FROM (SELECT q.*, a.period_end AS anchor_day, a.metric_kind AS ak, a.period_semantics AS asem, a.basis_id AS ab, a.dimensions_hash AS ad, a.duration_days AS alen,
             row_number() OVER (PARTITION BY a.security_id, a.metric_id, a.period_end ORDER BY q.period_end DESC) AS r
      FROM v_quarter_rows a JOIN v_quarter_rows q ON q.security_id = a.security_id AND q.metric_id = a.metric_id AND q.period_end <= a.period_end)
WHERE r <= 4 GROUP BY ALL
HAVING count(*) = 4 AND bool_and(metric_kind = ak AND period_semantics = asem AND basis_id = ab AND dimensions_hash = ad AND abs(duration_days - alen) <= 7 AND duration_days > 0 AND alen > 0)
""")


@query("ttm_quarters", "F3", POINT, "SELECT * FROM v_ttm_quarters")
def ttm_quarters(spark, d):
    return ttm.ttm_quarters(t.facts(spark, d))


# Every current, annual and prior triple, best prior per pair, then best bridge per end.
view("v_ttm_bridge", """
SELECT security_id, metric_id, period_end, a_value + c_value - p_value AS value, a_start AS period_start, available AS available_at, flags AS quality_flags
FROM (
  SELECT c.security_id, c.metric_id, c.period_end, c.value AS c_value, a.value AS a_value, p.value AS p_value, a.period_start AS a_start,
         greatest(c.available_at, a.available_at, p.available_at) AS available, c.quality_flags | a.quality_flags | p.quality_flags | 16384 AS flags,
         c.available_at AS c_at, c.basis_id AS basis, c.observation_id AS c_id, a.period_end AS a_end, a.available_at AS a_at, a.observation_id AS a_id
  FROM v_tagged c
  JOIN v_tagged a ON a.security_id = c.security_id AND a.metric_id = c.metric_id AND a.metric_kind = c.metric_kind AND a.basis_id = c.basis_id
       AND a.dimensions_hash = c.dimensions_hash AND a.flow_class = 'annual' AND a.period_end < c.period_end AND abs(date_diff('day', c.period_start, a.period_end) + 1) <= 7
  JOIN v_tagged p ON p.security_id = c.security_id AND p.metric_id = c.metric_id AND p.metric_kind = c.metric_kind AND p.basis_id = c.basis_id
       AND p.dimensions_hash = c.dimensions_hash AND p.period_semantics = c.period_semantics AND abs(date_diff('day', p.period_start, a.period_start)) <= 7
       AND abs(p.duration_days - c.duration_days) <= 7 AND p.period_end < a.period_end
  WHERE c.flow_class IN ('quarter', 'ytd') AND c.metric_id IN (1, 2, 3, 5, 6)
  QUALIFY row_number() OVER (PARTITION BY c.observation_id, a.observation_id ORDER BY p.available_at DESC, p.basis_id, p.observation_id) = 1
)
QUALIFY row_number() OVER (PARTITION BY security_id, metric_id, period_end ORDER BY available DESC, c_at, basis, c_id, a_end, a_at, a_id) = 1
""")


@query("ttm_bridge", "F4", POINT, "SELECT * FROM v_ttm_bridge")
def ttm_bridge(spark, d):
    return ttm.ttm_bridge(t.facts(spark, d))


view("v_flow_ttm", """
SELECT * FROM (SELECT 'annual' AS flow_source, 1 AS o, * FROM v_ttm_annual UNION ALL SELECT 'quarters', 2, * FROM v_ttm_quarters UNION ALL SELECT 'bridge', 3, * FROM v_ttm_bridge)
QUALIFY row_number() OVER (PARTITION BY security_id, metric_id, period_end ORDER BY o) = 1
""")


@query("flow_ttm", "F5", f"{POINT} flow_source:s", "SELECT * FROM v_flow_ttm")
def flow_ttm(spark, d):
    return ttm.flow_ttm(t.facts(spark, d))


view("v_latest_point", """
SELECT p.security_id, p.metric_id, a.period_end AS anchor_day, p.period_end, p.value, p.period_start, p.available_at, p.quality_flags
FROM v_anchors a JOIN v_points p ON p.security_id = a.security_id AND p.period_end <= a.period_end
QUALIFY row_number() OVER (PARTITION BY p.security_id, p.metric_id, a.period_end ORDER BY p.period_end DESC, p.available_at DESC, p.basis_id, p.observation_id) = 1
""")


@query("latest_point", "F6", f"{POINT} anchor_day:d", "SELECT * FROM v_latest_point")
def latest_point(spark, d):
    facts = t.facts(spark, d)
    return ttm.latest_point(facts, ttm.anchors(facts, t.securities(spark, d), REFERENCE_ANCHORS))


def _obs_bits(flags: str) -> str:
    return (f"(CASE WHEN {flags} & 12 <> 0 THEN 64 ELSE 0 END | CASE WHEN {flags} & 16384 <> 0 THEN 1024 ELSE 0 END"
            f" | CASE WHEN {flags} & {32 | 128 | 1024 | 2048 | 4096 | 32768} <> 0 THEN 128 ELSE 0 END"
            f" | CASE WHEN {flags} & {1024 | 2048 | 4096 | 32768} <> 0 THEN 32 ELSE 0 END)")


view("v_parts", """
SELECT a.security_id, a.period_end, metric_id, f.value, f.period_start, f.available_at, f.quality_flags
FROM v_anchors a JOIN v_flow_ttm f ON f.security_id = a.security_id AND f.period_end = a.period_end
UNION ALL SELECT security_id, anchor_day, metric_id, value, period_start, available_at, quality_flags FROM v_latest_point
""")
_V = {m: f"max(value) FILTER (metric_id = {m})" for m in range(1, 9)}
view("v_statements", f"""
SELECT security_id, coalesce(r_start, period_end) AS period_start, period_end, available_at, TRUE AS is_ttm,
       coalesce(rev, 0) AS revenue_usd, coalesce(ni, 0) AS net_income_usd, coalesce(eps, 0) AS diluted_eps_usd, coalesce(sh, 0) AS diluted_shares,
       coalesce(ocf, 0) AS operating_cash_flow_usd, coalesce(capex, 0) AS capex_usd, coalesce(ocf - capex, 0) AS free_cash_flow_usd,
       coalesce(cash, 0) AS cash_usd, coalesce(debt, 0) AS debt_usd, coalesce(debt, 0) - coalesce(cash, 0) AS net_debt_usd,
       {_obs_bits('seen')} | CASE WHEN rev IS NULL OR rev <= 0 THEN 129 ELSE 0 END | CASE WHEN sh IS NULL OR sh <= 0 THEN 130 ELSE 0 END
       | CASE WHEN ocf IS NULL THEN 384 ELSE 0 END | CASE WHEN capex IS NULL THEN 640 ELSE 0 END | CASE WHEN cash IS NULL THEN 4 ELSE 0 END
       | CASE WHEN debt IS NULL THEN 8 ELSE 0 END | CASE WHEN ocf - capex < 0 THEN 16 ELSE 0 END AS quality_flags
FROM (SELECT security_id, period_end, max(available_at) AS available_at, bit_or(quality_flags) AS seen, max(period_start) FILTER (metric_id = 1) AS r_start,
             {_V[1]} AS rev, {_V[2]} AS ni, {_V[3]} AS eps, {_V[4]} AS sh, {_V[5]} AS ocf, {_V[6]} AS capex, {_V[7]} AS cash, {_V[8]} AS debt
      FROM v_parts GROUP BY ALL)
WHERE rev IS NOT NULL OR ni IS NOT NULL OR ocf IS NOT NULL
""")

STATEMENT = ("security_id:i period_start:d period_end:d available_at:t is_ttm:b revenue_usd:f net_income_usd:f diluted_eps_usd:f diluted_shares:f "
             "operating_cash_flow_usd:f capex_usd:f free_cash_flow_usd:f cash_usd:f debt_usd:f net_debt_usd:f quality_flags:i")


def bound_statements(spark, d, max_anchors: int | None = REFERENCE_ANCHORS):
    return statements.build_statements(t.facts(spark, d), t.securities(spark, d), t.NOW, max_anchors=max_anchors)


@query("ttm_statements", "F7", STATEMENT, "SELECT * FROM v_statements")
def ttm_statements(spark, d):
    return bound_statements(spark, d)


@query("statement_quality_counts", "F8", "quality_flags:i n:i",
       "SELECT quality_flags, count(*) AS n FROM v_statements GROUP BY 1")
def statement_quality_counts(spark, d):
    return bound_statements(spark, d).groupBy("quality_flags").agg(F.count("*").alias("n"))


_AMOUNTS = ["revenue_usd", "net_income_usd", "diluted_eps_usd", "diluted_shares", "operating_cash_flow_usd",
            "capex_usd", "free_cash_flow_usd", "cash_usd", "debt_usd", "net_debt_usd"]
_HASHED = " || '|' || ".join(
    ["'security_id=' || security_id", "'period_start=' || CAST(period_start AS VARCHAR)", "'period_end=' || CAST(period_end AS VARCHAR)",
     "'available_at=' || CAST(epoch(available_at) AS BIGINT)", "'is_ttm=1'"]
    + [f"'{a}=' || CAST(CAST({a} AS DECIMAL(38,6)) AS VARCHAR) || CASE WHEN CAST(CAST({a} AS DECIMAL(38,6)) AS DOUBLE) = {a} THEN '' ELSE '~' || CAST({a} AS VARCHAR) END" for a in _AMOUNTS]
    + ["'quality_flags=' || quality_flags", "'version=1'"])
view("v_snapshots", f"""
SELECT *, 'stmt-' || sha256('security_id=' || security_id || '|period_end=' || CAST(period_end AS VARCHAR) || '|available_at=' || CAST(epoch(available_at) AS BIGINT) || '|source_hash=' || source_hash) AS snapshot_id,
       TIMESTAMP '2002-03-31 00:00:00' AS inserted_at
FROM (SELECT *, sha256({_HASHED}) AS source_hash FROM v_statements)
""")


def bound_snapshots(spark, d, max_anchors: int | None = REFERENCE_ANCHORS):
    return statements.statement_snapshots(bound_statements(spark, d, max_anchors), F.lit(t.INSERTED_AT).cast("timestamp"))


# The same on every anchor: each view of the chain by another name, the first without its limit.
_CHAIN = ("v_anchors", "v_latest_point", "v_parts", "v_statements", "v_snapshots")
for _name in _CHAIN:
    _sql = VIEWS[_name].removesuffix("QUALIFY anchor_rank <= 12")
    view(f"{_name}_all", re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"\1_all", _sql))


@query("statement_snapshots", "F9", "security_id:i period_end:d source_hash:s snapshot_id:s", "SELECT * FROM v_snapshots_all")
def statement_snapshots(spark, d):
    """Snapshots on every anchor; the queries that work on statements take the reference's number of them."""
    return bound_snapshots(spark, d, None)


@query("statement_diagnostics", "F10", "securities:i investable:i facts:i statements:i", """
SELECT (SELECT count(*) FROM v_securities) AS securities, (SELECT count(*) FROM v_securities WHERE investable) AS investable,
       (SELECT count(*) FROM v_facts) AS facts, (SELECT count(*) FROM v_statements) AS statements
""")
def statement_diagnostics(spark, d):
    return statements.statement_diagnostics(t.facts(spark, d), t.securities(spark, d), bound_statements(spark, d))
