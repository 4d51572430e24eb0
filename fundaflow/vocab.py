"""Fixed values of the domain: names, codes, bit positions and defaults.

Everything in this file is a fixed value that results depend on.
"""

from __future__ import annotations

# metric id -> (name, kind, default unit)
METRICS = {
    1: ("revenue", "flow", "USD"),
    2: ("net_income", "flow", "USD"),
    3: ("eps_diluted", "per_share_flow", "USD/shares"),
    4: ("diluted_shares", "flow", "shares"),
    5: ("operating_cash_flow", "flow", "USD"),
    6: ("capex", "flow", "USD"),
    7: ("cash", "instant", "USD"),
    8: ("debt", "instant", "USD"),
    9: ("gross_profit", "flow", "USD"),
    10: ("operating_income", "flow", "USD"),
    11: ("research_and_development", "flow", "USD"),
    12: ("stock_based_compensation", "flow", "USD"),
    13: ("interest_expense", "flow", "USD"),
    14: ("buybacks", "flow", "USD"),
}
METRIC_ID = {name: i for i, (name, _, _) in METRICS.items()}

METRIC_KINDS = ["unknown", "flow", "instant", "per_share_flow", "ratio", "derived"]
PERIOD_SEMANTICS = [
    "unknown", "fiscal_quarter", "fiscal_ytd", "fiscal_year", "ttm",
    "instant", "stub", "transition", "irregular",
]
OBSERVATION_STATUSES = ["unknown", "selected", "derived", "rejected", "superseded"]
ORDER_SIDES = ["none", "buy", "sell"]

# us-gaap concept -> (metric id, basis id, priority, unit)
CONCEPTS = [
    ("RevenueFromContractWithCustomerExcludingAssessedTax", 1, 101, 1, "USD"),
    ("RevenueFromContractWithCustomerIncludingAssessedTax", 1, 102, 2, "USD"),
    ("SalesRevenueNet", 1, 103, 3, "USD"),
    ("Revenues", 1, 104, 4, "USD"),
    ("NetIncomeLoss", 2, 201, 1, "USD"),
    ("ProfitLoss", 2, 201, 2, "USD"),
    ("EarningsPerShareDiluted", 3, 301, 1, "USD/shares"),
    ("WeightedAverageNumberOfDilutedSharesOutstanding", 4, 401, 1, "shares"),
    ("NetCashProvidedByUsedInOperatingActivities", 5, 501, 1, "USD"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", 6, 601, 1, "USD"),
    ("CashAndCashEquivalentsAtCarryingValue", 7, 701, 1, "USD"),
    ("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", 7, 701, 2, "USD"),
    ("LongTermDebtAndFinanceLeaseObligationsCurrent", 8, 801, 1, "USD"),
    ("LongTermDebtCurrent", 8, 801, 2, "USD"),
    ("LongTermDebtNoncurrent", 8, 801, 3, "USD"),
    ("GrossProfit", 9, 901, 1, "USD"),
    ("OperatingIncomeLoss", 10, 1001, 1, "USD"),
    ("ResearchAndDevelopmentExpense", 11, 1101, 1, "USD"),
    ("ShareBasedCompensation", 12, 1201, 1, "USD"),
    ("AllocatedShareBasedCompensationExpense", 12, 1202, 2, "USD"),
    ("InterestExpenseNonoperating", 13, 1301, 1, "USD"),
    ("InterestExpense", 13, 1302, 2, "USD"),
    ("InterestExpenseDebt", 13, 1303, 3, "USD"),
    ("PaymentsForRepurchaseOfCommonStock", 14, 1401, 1, "USD"),
    ("StockRepurchasedAndRetiredDuringPeriodValue", 14, 1402, 2, "USD"),
    ("StockRepurchasedDuringPeriodValue", 14, 1403, 3, "USD"),
]

# observation quality bits
OBS_AMENDED = 1 << 2
OBS_RESTATED = 1 << 3
OBS_MISSING_COMPARABLE = 1 << 5
OBS_LOW_CONFIDENCE = 1 << 7
OBS_STUB = 1 << 10
OBS_IRREGULAR = 1 << 11
OBS_DURATION_MISMATCH = 1 << 12
OBS_DERIVED = 1 << 14
OBS_BASIS_TRANSITION = 1 << 15
OBS_DIMENSIONAL = 1 << 16
OBS_AMBIGUOUS = 1 << 17

OBS_NON_COMPARABLE_SET = OBS_DURATION_MISMATCH | OBS_BASIS_TRANSITION | OBS_STUB | OBS_IRREGULAR
OBS_LOW_CONFIDENCE_SET = OBS_LOW_CONFIDENCE | OBS_MISSING_COMPARABLE | OBS_NON_COMPARABLE_SET

# statement quality bits, in bit order
STATEMENT_FLAGS = [
    "missing_revenue", "missing_shares", "missing_cash", "missing_debt",
    "negative_fcf", "non_comparable_period", "amended_or_restated", "low_confidence",
    "missing_operating_cash_flow", "missing_capex", "derived_ttm",
]
STMT = {name: 1 << i for i, name in enumerate(STATEMENT_FLAGS)}

# feature quality bits, in bit order
FEATURE_FLAGS = [
    "missing_previous", "non_comparable_previous", "missing_revenue",
    "missing_fcf", "missing_shares", "statement_flagged",
]
FEAT = {name: 1 << i for i, name in enumerate(FEATURE_FLAGS)}

# sha256 of the empty member set "{}"
TOTAL_DIMENSIONS_JSON = "{}"
CONSOLIDATED = "consolidated_total"
USABLE_STATUSES = ("selected", "derived")

ARCHIVE_BASE_URL = "https://www.sec.gov/Archives/edgar/data"

STAGE_MODES = ("stage", "paper", "live_limited", "live")
SUBMIT_MODES = ("paper", "live_limited", "live")
ALL_MODES = ("halted", "observe", "shadow", "stage", "paper", "live_limited", "live")
SUBMITTED_EVENT = "mock_order_submitted"
STAGING_ALGORITHM = "cmd.stage.v1"

AUTHORITY_PRODUCT_TYPES = (
    "order_intent_set.v1", "risk_decision_set.v1", "staged_order_set.v1",
    "broker_event_set.v1", "reconciliation_snapshot.v1",
)
COMMAND_OUTPUT = "command_output.v1"
