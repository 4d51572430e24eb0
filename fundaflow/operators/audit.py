"""Integrity audits.  Every audit returns violating rows as (rule, subject, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow import vocab
from fundaflow.operators.select import FLOW_KINDS


def _rows(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_rows(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows failing any of the rules, one output row per broken rule.

    `rules` maps a rule id to the condition that must hold; NULL counts as failing.  All rules
    of a table are evaluated in one scan.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]))
    return df.select(F.col(key).cast("string").alias("subject"), F.explode(broken).alias("rule")).select(
        "rule", "subject", F.lit("rule does not hold").alias("detail"))


def not_blank(name: str) -> Column:
    return F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != "")


def audit_required(df: DataFrame, table: str, key: str, required: Sequence[str],
                   enums: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Required columns are present and enum columns hold a listed value."""
    rules = {f"{table}.{c}.required": not_blank(c) for c in required}
    rules |= {f"{table}.{c}.enum": F.col(c).isin(list(values)) for c, values in (enums or {}).items()}
    return check_rows(df, key, rules)


def audit_hashes(df: DataFrame, table: str, key: str, hash_columns: Sequence[str],
                 json_columns: Sequence[str] = (), version_column: str | None = None) -> DataFrame:
    """Hashes have 64 characters, payloads parse, versions are 1."""
    rules = {f"{table}.{c}.hash_length": F.length(c) == 64 for c in hash_columns}
    rules |= {f"{table}.{c}.json": F.try_parse_json(c).isNotNull() for c in json_columns}
    if version_column:
        rules[f"{table}.{version_column}.version"] = F.col(version_column) == 1
    return check_rows(df, key, rules)


def audit_reference(child: DataFrame, child_key: str, column: str, parent: DataFrame, parent_column: str,
                    rule: str) -> DataFrame:
    """Child rows whose reference is set but names no parent row."""
    parents = parent.select(F.col(parent_column).alias(column))
    lost = child.filter(F.col(column).isNotNull()).join(parents, column, "left_anti")
    return _rows(lost, rule, F.col(child_key), F.col(column))


# Fixed values: (child table, child key, column, parent table, parent column)
REFERENCES = (
    ("feature_rows", "row_hash", "feature_snapshot_id", "feature_snapshots", "feature_snapshot_id"),
    ("feature_rows", "row_hash", "source_statement_snapshot_id", "statement_snapshots", "snapshot_id"),
    ("target_weights", "security_id", "run_id", "model_runs", "run_id"),
    ("order_intents", "intent_id", "run_id", "model_runs", "run_id"),
    ("valuations", "security_id", "run_id", "model_runs", "run_id"),
    ("risk_decisions", "decision_id", "intent_id", "order_intents", "intent_id"),
    ("staged_orders", "staged_order_id", "decision_id", "approved_decisions", "decision_id"),
    ("staged_orders", "staged_order_id", "intent_id", "order_intents", "intent_id"),
    ("broker_events", "broker_event_id", "staged_order_id", "staged_orders", "staged_order_id"),
)


def audit_references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every declared reference whose two tables are given.  Staged orders need an approved decision."""
    known = dict(tables)
    if "risk_decisions" in known:
        known["approved_decisions"] = known["risk_decisions"].filter("approved")
    return union([
        audit_reference(known[child], key, column, known[parent], parent_column, f"{child}.{column}.reference")
        for child, key, column, parent, parent_column in REFERENCES if child in known and parent in known
    ])


def audit_observations(observations: DataFrame) -> DataFrame:
    """Flows last at least a day; selected observations are consolidated totals."""
    return check_rows(observations, "observation_id", {
        "observations.flow_duration": ~F.col("metric_kind").isin(*FLOW_KINDS) | (F.col("duration_days") > 0),
        "observations.selected_scope": (F.col("observation_status") != "selected") | (F.col("dimensional_scope") == vocab.CONSOLIDATED),
    })


def audit_periods(periods: DataFrame) -> DataFrame:
    """An instant has its date, a duration both of its dates."""
    instant = (F.col("period_kind") == "instant") & F.col("raw_instant_date").isNotNull()
    duration = (F.col("period_kind") == "duration") & F.col("raw_start_date").isNotNull() & F.col("raw_end_date").isNotNull()
    return check_rows(periods, "period_id", {"periods.dates": instant | duration})


def audit_event_payloads(events: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Numeric payload fields against (event type, JSON path, `eq` or `ge`, value)."""

    def field(path: str) -> Column:
        return F.get_json_object("payload_json", path).try_cast("double")

    checks = {}
    for event_type, path, op, value in rules:
        holds = (field(path) == value) if op == "eq" else (field(path) >= value)
        checks[f"events.{event_type}.{path}.{op}"] = (F.col("event_type") != event_type) | holds
    return check_rows(events, "event_id", checks)


def audit_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Declared keys that occur more than once; counts combine on the map side."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    subject = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return _rows(repeated, f"{table}.{'_'.join(keys)}.unique", subject, F.col("n"))


def audit_payload_hash(df: DataFrame, table: str, key: str, payload: str = "payload_json", digest: str = "payload_sha256") -> DataFrame:
    """Stored hashes that differ from the hash of the stored payload."""
    wrong = df.filter(~F.sha2(payload, 256).eqNullSafe(F.col(digest)))
    return _rows(wrong, f"{table}.{digest}.recomputed", F.col(key), F.col(digest))
