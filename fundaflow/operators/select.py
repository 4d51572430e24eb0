"""Which facts an operator may read, and when two facts may be compared."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow import vocab
from fundaflow.functions.dates import ANNUAL_DAYS, YTD_DAYS, as_utc, is_quarter_like
from fundaflow.functions.flags import has_any
from fundaflow.functions.numbers import is_finite

FLOW_KINDS = ("flow", "per_share_flow")
FLOW_IDENTITY = ["security_id", "metric_id", "metric_kind", "basis_id", "dimensions_hash"]
DAY_TOLERANCE = 7
CASH, DEBT, SHARES = (vocab.METRIC_ID[n] for n in ("cash", "debt", "diluted_shares"))


def trusted() -> Column:
    """Status is usable and no competing candidate was flagged."""
    return F.col("observation_status").isin(*vocab.USABLE_STATUSES) & ~has_any(
        F.col("quality_flags"), vocab.OBS_AMBIGUOUS
    )


def is_usable() -> Column:
    return (
        is_finite(F.col("value"))
        & (F.col("period_end") > F.lit("1970-01-01").cast("date"))
        & F.col("available_at").isNotNull()
        & (F.unix_seconds("available_at") > 0)
        & trusted()
    )


def usable(facts: DataFrame) -> DataFrame:
    return facts.filter(is_usable())


def is_fresh(now: datetime, max_age_s: int) -> Column:
    """Age test only: facts that become available after `now` pass (negative age)."""
    if max_age_s <= 0:
        return F.lit(True)
    age = F.unix_seconds(as_utc(now)) - F.unix_seconds("available_at")
    return F.coalesce(age <= max_age_s, F.lit(True))


def fresh(facts: DataFrame, now: datetime, max_age_s: int) -> DataFrame:
    return facts.filter(is_fresh(now, max_age_s))


def flow_class() -> Column:
    """quarter / annual / ytd for flows of the right length, else NULL."""
    semantics, days = F.col("period_semantics"), F.col("duration_days")
    label = (
        F.when((semantics == "fiscal_quarter") & is_quarter_like(days), F.lit("quarter"))
        .when((semantics == "fiscal_year") & days.between(*ANNUAL_DAYS), F.lit("annual"))
        .when((semantics == "fiscal_ytd") & days.between(*YTD_DAYS), F.lit("ytd"))
    )
    return F.when(F.col("metric_kind").isin(*FLOW_KINDS), label)


def tag_flow_class(facts: DataFrame) -> DataFrame:
    return facts.withColumn("flow_class", flow_class())


def is_point() -> Column:
    """Balance metrics must be instants; share counts may come from any reported flow period."""
    balance = F.col("metric_id").isin(CASH, DEBT) & (F.col("metric_kind") == "instant") & (
        F.col("period_semantics") == "instant"
    )
    shares = (
        (F.col("metric_id") == SHARES)
        & F.col("metric_kind").isin(*FLOW_KINDS)
        & F.col("period_semantics").isin("fiscal_quarter", "fiscal_ytd", "fiscal_year")
    )
    return balance | shares


def point_facts(facts: DataFrame) -> DataFrame:
    return usable(facts).filter(is_point())


def is_model_comparable() -> Column:
    """Fact shape the growth model accepts."""
    needs_duration = ~F.col("metric_id").isin(SHARES, CASH, DEBT)
    flow = (
        F.col("metric_kind").isin(*FLOW_KINDS)
        & (F.col("period_semantics") == "fiscal_quarter")
        & is_quarter_like(F.col("duration_days"))
    )
    instant = (F.col("metric_kind") == "instant") & (F.col("period_semantics") == "instant")
    return trusted() & F.when(needs_duration, flow).otherwise(instant)


def model_comparable(facts: DataFrame) -> DataFrame:
    return usable(facts).filter(is_model_comparable())


def close_days(a: Column, b: Column, tolerance: int = DAY_TOLERANCE) -> Column:
    return F.abs(a - b) <= tolerance


def comparable(left: Column, right: Column) -> Column:
    """Two period structs of one metric may be compared: same make-up, similar known length."""
    same = (
        (left["metric_kind"] == right["metric_kind"])
        & (left["period_semantics"] == right["period_semantics"])
        & (left["basis_id"] == right["basis_id"])
        & (left["dimensions_hash"] == right["dimensions_hash"])
    )
    known = (left["duration_days"] > 0) & (right["duration_days"] > 0)
    return F.coalesce(
        same & known & close_days(left["duration_days"], right["duration_days"]), F.lit(False)
    )


def period_struct() -> Column:
    return F.struct("metric_kind", "period_semantics", "basis_id", "dimensions_hash", "duration_days")
