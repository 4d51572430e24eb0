"""SQL twins of the domain tables, and the composer that turns them into one statement."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def compose(sql: str) -> str:
    """Prefix a statement with the views it mentions, dependencies first."""
    ordered: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in sorted(set(re.findall(r"\bv_\w+\b", text))):
            if name in VIEWS and name not in ordered and name not in trail:
                visit(VIEWS[name], (*trail, name))
                ordered.append(name)

    visit(sql, ())
    if not ordered:
        return sql.strip()
    body = ",\n".join(f"{name} AS (\n{VIEWS[name]}\n)" for name in ordered)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {body},\n{text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {body},\n{text[len('WITH '):]}"
    return f"WITH {body}\n{text}"


REV = "CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))"
CIK = "lpad(CAST(k + 1 AS VARCHAR), 10, '0')"

view("v_quarterly", f"""
SELECT l_suppkey AS k, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, sum({REV}) AS rev
FROM lineitem GROUP BY ALL
""")

view("v_securities", f"""
SELECT k + 1 AS security_id, {CIK} AS cik, 'S' || lpad(CAST(k AS VARCHAR), 6, '0') AS symbol,
       k % 10 <> 9 AS investable, CAST(k % 97 + 10 AS DOUBLE) / 10.0::DOUBLE AS price_usd, coalesce(adv, 0.0) AS adv_usd,
       CASE WHEN k % 13 = 4 THEN '' ELSE trim(lower(regexp_replace(n_name, '[^0-9A-Za-z]+', '_', 'g')), '_') END AS peer_group,
       trim(lower(regexp_replace(r_name, '[^0-9A-Za-z]+', '_', 'g')), '_') AS sector,
       CASE WHEN k % 6 = 0 THEN '' ELSE 'industry_' || CAST(k % 6 AS VARCHAR) END AS industry,
       TIMESTAMP '2002-03-31 00:00:00' AS updated_at
FROM (SELECT s_suppkey AS k, s_nationkey FROM supplier) s
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_suppkey, CAST(sum({REV}) AS DOUBLE) / 1000.0 AS adv FROM lineitem GROUP BY 1) a ON l_suppkey = k
""")

view("v_positions", """
SELECT s_suppkey + 1 AS security_id, CAST(100 * (s_suppkey % 5) AS DOUBLE) AS quantity_shares,
       CAST(10000 * (s_suppkey % 5) AS DOUBLE) AS market_value_usd, CAST(s_suppkey % 5 AS DOUBLE) / 100.0 AS weight_ratio
FROM supplier WHERE s_suppkey % 4 = 0
""")

view("v_flow_periods", """
SELECT k, sem, start, finish, sum(rev) AS rev FROM (
  SELECT k, rev, 'fiscal_quarter' AS sem, q AS start, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS finish
  FROM v_quarterly WHERE k % 3 = 0
  UNION ALL
  SELECT k, rev, 'fiscal_quarter', q, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)
  FROM v_quarterly WHERE k % 3 = 1 AND quarter(q) = 1
  UNION ALL
  SELECT k, rev, 'fiscal_ytd', make_date(year(q), 1, 1), make_date(year(q), 6, 30)
  FROM v_quarterly WHERE k % 3 = 1 AND quarter(q) <= 2
  UNION ALL
  SELECT k, rev, 'fiscal_ytd', make_date(year(q), 1, 1), make_date(year(q), 9, 30)
  FROM v_quarterly WHERE k % 3 = 1 AND quarter(q) <= 3
  UNION ALL
  SELECT k, rev, 'fiscal_year', make_date(year(q), 1, 1), make_date(year(q), 12, 31)
  FROM v_quarterly WHERE k % 3 <> 0
) GROUP BY ALL
""")

view("v_reported", """
SELECT k, sem, start, finish, 1 AS metric_id, CASE WHEN k % 31 = 5 AND year(finish) >= 1999 THEN 101 ELSE 104 END AS basis_id, CAST(rev AS DOUBLE) AS v FROM v_flow_periods
UNION ALL SELECT k, sem, start, finish, 2, 201, CAST(rev * (k % 7 - 1) AS DOUBLE) / 100.0 FROM v_flow_periods WHERE k % 37 <> 8
UNION ALL SELECT k, sem, start, finish, 3, 301, CAST(rev * (k % 7 - 1) AS DOUBLE) / 100.0 / CAST(1000000 + 1000 * (k % 50) AS DOUBLE) FROM v_flow_periods WHERE k % 37 <> 8
UNION ALL SELECT k, sem, start, finish, 4, 401, CAST(1000000 + 1000 * (k % 50) AS DOUBLE) FROM v_flow_periods WHERE k % 41 <> 7
UNION ALL SELECT k, sem, start, finish, 5, 501, CAST(rev * (k % 5 + 12) AS DOUBLE) / 100.0 FROM v_flow_periods WHERE k % 17 <> 3
UNION ALL SELECT k, sem, start, finish, 6, 601, CAST(rev * (CASE WHEN k % 19 = 4 THEN 20 ELSE k % 4 + 3 END) AS DOUBLE) / 100.0 FROM v_flow_periods WHERE k % 23 <> 6
UNION ALL SELECT k, sem, start, finish, 9, 901, CAST(rev * 40 AS DOUBLE) / 100.0 FROM v_flow_periods
UNION ALL SELECT k, 'instant', NULL, finish, 7, 701, CAST(cum * 5 AS DOUBLE) / 100.0 FROM v_running
UNION ALL SELECT k, 'instant', NULL, finish, 8, 801, CAST(cum * (k % 9) AS DOUBLE) / 100.0 FROM v_running WHERE k % 11 <> 2
""")

view("v_running", """
SELECT k, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS finish, sum(rev) OVER (PARTITION BY k ORDER BY q) AS cum
FROM v_quarterly WHERE k % 7 <> 0
""")

view("v_numbered", "SELECT *, k + year(finish) * 4 + quarter(finish) AS n FROM v_reported")

view("v_versions", """
SELECT *, 1 AS ver, v AS value, 45 AS lag_days, 'selected' AS observation_status, CASE WHEN n % 61 = 0 THEN 128 ELSE 0 END AS quality_flags, 'consolidated_total' AS dimensional_scope FROM v_numbered
UNION ALL SELECT *, 2, v * 1.01::DOUBLE, 155, 'selected', 4, 'consolidated_total' FROM v_numbered WHERE n % 11 = 0
UNION ALL SELECT *, 3, v * 3.0::DOUBLE, 50, 'rejected', 0, 'consolidated_total' FROM v_numbered WHERE n % 29 = 0
UNION ALL SELECT *, 4, v * 5.0::DOUBLE, 200, 'selected', 131072, 'consolidated_total' FROM v_numbered WHERE n % 43 = 0
UNION ALL SELECT *, 5, v * 0.5::DOUBLE, 45, 'derived', 65536, 'segment' FROM v_numbered WHERE n % 53 = 0
""")

METRIC_CASES = {
    "name": "CASE metric_id WHEN 1 THEN 'revenue' WHEN 2 THEN 'net_income' WHEN 3 THEN 'eps_diluted' WHEN 4 THEN 'diluted_shares' WHEN 5 THEN 'operating_cash_flow' WHEN 6 THEN 'capex' WHEN 7 THEN 'cash' WHEN 8 THEN 'debt' WHEN 9 THEN 'gross_profit' END",
    "kind": "CASE WHEN metric_id = 3 THEN 'per_share_flow' WHEN metric_id IN (7, 8) THEN 'instant' ELSE 'flow' END",
    "unit": "CASE metric_id WHEN 3 THEN 'USD/shares' WHEN 4 THEN 'shares' ELSE 'USD' END",
}

view("v_observations", f"""
SELECT concat_ws('-', 'obs', k, metric_id, sem, finish, ver) AS observation_id, k + 1 AS security_id, {CIK} AS cik,
       metric_id, {METRIC_CASES['name']} AS metric_name, {METRIC_CASES['kind']} AS metric_kind, {METRIC_CASES['unit']} AS unit_signature,
       basis_id, concat_ws('-', 'period', k, sem, finish) AS period_id, sem AS period_semantics,
       start AS raw_start_date, CASE WHEN sem <> 'instant' THEN finish END AS raw_end_date,
       CASE WHEN sem = 'instant' THEN finish END AS raw_instant_date,
       CASE WHEN sem = 'instant' THEN 0 ELSE date_diff('day', start, finish) + 1 END AS duration_days,
       year(finish) AS fiscal_year, CASE WHEN sem = 'fiscal_year' THEN 'FY' ELSE 'Q' || quarter(finish) END AS fiscal_period,
       value, sha256(CASE WHEN dimensional_scope = 'segment' THEN 'segment' ELSE '{{}}' END) AS dimensions_hash,
       dimensional_scope, observation_status, quality_flags,
       concat_ws('-', {CIK}, strftime(finish, '%y'), lpad(CAST(quarter(finish) AS VARCHAR), 6, '0')) AS accession_number,
       CAST(finish AS TIMESTAMP) + to_days(CAST(lag_days AS INTEGER)) AS available_at
FROM v_versions
""")

view("v_periods", """
SELECT period_id, cik, period_semantics, duration_days, fiscal_year, fiscal_period, raw_start_date, raw_end_date, raw_instant_date,
       min(accession_number) AS accession_number, CASE WHEN period_semantics = 'instant' THEN 'instant' ELSE 'duration' END AS period_kind
FROM v_observations GROUP BY ALL
""")

view("v_facts", """
SELECT observation_id, o.security_id, metric_id, value, coalesce(p.raw_start_date, p.raw_instant_date) AS period_start,
       coalesce(p.raw_end_date, p.raw_instant_date) AS period_end, available_at, quality_flags, metric_kind, o.period_semantics,
       basis_id, observation_status, o.duration_days, dimensions_hash
FROM v_observations o JOIN v_periods p USING (period_id)
WHERE observation_status IN ('selected', 'derived') AND dimensional_scope = 'consolidated_total'
""")

view("v_usable", """
SELECT * FROM v_facts
WHERE isfinite(value) AND period_end > DATE '1970-01-01' AND available_at > TIMESTAMP '1970-01-01'
  AND observation_status IN ('selected', 'derived') AND quality_flags & 131072 = 0
""")

view("v_tagged", """
SELECT *, CASE WHEN metric_kind NOT IN ('flow', 'per_share_flow') THEN NULL
  WHEN period_semantics = 'fiscal_quarter' AND duration_days BETWEEN 70 AND 110 THEN 'quarter'
  WHEN period_semantics = 'fiscal_year' AND duration_days BETWEEN 330 AND 380 THEN 'annual'
  WHEN period_semantics = 'fiscal_ytd' AND duration_days BETWEEN 130 AND 300 THEN 'ytd' END AS flow_class
FROM v_usable
""")
