"""Domain tables as DataFrames over the provided parquet tables.

Issuers come from suppliers, filed amounts from line items per supplier and quarter.  All
money stays decimal until it is published as a double, so both engines see equal inputs.
`views.py` repeats every rule in SQL.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow import vocab
from fundaflow.config import ModelConfig, RiskLimits
from fundaflow.functions.text import slug

NOW = datetime(2002, 3, 31)
AS_OF = datetime(2000, 6, 30)
INSERTED_AT = "2002-03-31 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def revenue_column() -> Column:
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    return price * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """(k, q, rev): supplier key, first day of the ship quarter, discounted amount."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("k"), F.trunc("l_shipdate", "quarter").alias("q"))
        .agg(F.sum(revenue_column()).alias("rev"))
    )


def cik_of(k: Column) -> Column:
    return F.lpad((k + 1).cast("string"), 10, "0")


def securities(spark: SparkSession, d: str) -> DataFrame:
    adv = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        (F.sum(revenue_column()).cast("double") / 1000.0).alias("adv_usd")
    )
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    k = F.col("s_suppkey")
    return (
        table(spark, d, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(adv, "s_suppkey", "left")
        .select(
            (k + 1).alias("security_id"),
            cik_of(k).alias("cik"),
            F.concat(F.lit("S"), F.lpad(k.cast("string"), 6, "0")).alias("symbol"),
            (k % 10 != 9).alias("investable"),
            ((k % 97 + 10).cast("double") / 10.0).alias("price_usd"),
            F.coalesce("adv_usd", F.lit(0.0)).alias("adv_usd"),
            F.when(k % 13 == 4, F.lit("")).otherwise(slug(F.col("n_name"))).alias("peer_group"),
            slug(F.col("r_name")).alias("sector"),
            F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("industry_"), (k % 6).cast("string"))).alias("industry"),
            F.lit(INSERTED_AT).cast("timestamp").alias("updated_at"),
        )
    )


MODEL = ModelConfig(
    target_gross_exposure_ratio=0.50, max_name_weight_ratio=0.01, min_expected_return_proxy=0.02,
    min_abs_order_notional_usd=100.0, max_forecast_abs_growth_ratio=0.50,
)
LIMITS = RiskLimits(
    now=NOW, portfolio_value_usd=1_000_000.0, cash_usd=1e12, max_name_weight_ratio=0.05,
    max_order_notional_usd=30_000.0, min_adv_usd=31_000.0, max_adv_participation_ratio=0.60,
    broker_reconciled=True, reconciliation_checked_at=NOW - timedelta(minutes=30),
)


def positions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").filter(k % 4 == 0).select(
        (k + 1).alias("security_id"),
        (100 * (k % 5)).cast("double").alias("quantity_shares"),
        (10000 * (k % 5)).cast("double").alias("market_value_usd"),
        ((k % 5).cast("double") / 100.0).alias("weight_ratio"),
        F.lit(INSERTED_AT).cast("timestamp").alias("updated_at"),
    )


def reported_periods(spark: SparkSession, d: str) -> DataFrame:
    """(k, sem, start, finish, rev, cum): what each issuer reports, by reporter style k mod 3.

    `rev` is the amount of a flow period, `cum` the running amount of a balance date.
    """
    k, q, n = F.col("k"), F.col("q"), F.quarter("q")
    year_start = F.trunc("q", "year")

    def until(months: int, start: Column = year_start) -> Column:
        return F.date_sub(F.add_months(start, months), 1)

    def period(semantics: str, start: Column, finish: Column) -> Column:
        return F.struct(F.lit(semantics).alias("sem"), start.alias("start"), finish.alias("finish"))

    year = period("fiscal_year", year_start, until(12))
    balance = F.when(k % 7 != 0, period("instant", F.lit(None).cast("date"), until(3, q)))
    flows = F.array(
        F.when(k % 3 == 0, period("fiscal_quarter", q, until(3, q))),
        F.when((k % 3 == 1) & (n == 1), period("fiscal_quarter", year_start, until(3))),
        F.when((k % 3 == 1) & (n <= 2), period("fiscal_ytd", year_start, until(6))),
        F.when((k % 3 == 1) & (n <= 3), period("fiscal_ytd", year_start, until(9))),
        F.when(k % 3 != 0, year),
        balance,
    )
    running = W.partitionBy("k").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    return (
        quarterly(spark, d)
        .withColumn("cum", F.sum("rev").over(running))
        .select("k", "rev", "cum", F.inline(F.array_compact(flows)))
        .groupBy("k", "sem", "start", "finish")
        .agg(F.sum("rev").alias("rev"), F.max("cum").alias("cum"))
    )


def _measures(k: Column, rev: Column, finish: Column) -> Column:
    def pct(factor: Column) -> Column:
        return (rev * factor).cast("double") / 100.0

    shares = (1_000_000 + 1000 * (k % 50)).cast("double")

    def m(metric_id: int, basis: Column, value: Column, keep: Column) -> Column:
        return F.when(
            keep,
            F.struct(F.lit(metric_id).alias("metric_id"), basis.cast("int").alias("basis_id"), value.alias("v")),
        )

    transition = (k % 31 == 5) & (F.year(finish) >= 1999)
    return F.array_compact(
        F.array(
            m(1, F.when(transition, 101).otherwise(104), rev.cast("double"), F.lit(True)),
            m(2, F.lit(201), pct(k % 7 - 1), k % 37 != 8),
            m(3, F.lit(301), pct(k % 7 - 1) / shares, k % 37 != 8),
            m(4, F.lit(401), shares, k % 41 != 7),
            m(5, F.lit(501), pct(k % 5 + 12), k % 17 != 3),
            m(6, F.lit(601), pct(F.when(k % 19 == 4, 20).otherwise(k % 4 + 3)), k % 23 != 6),
            m(9, F.lit(901), pct(F.lit(40)), F.lit(True)),
        )
    )


def _instants(k: Column, cum: Column) -> Column:
    def m(metric_id: int, basis: int, factor: Column, keep: Column) -> Column:
        return F.when(
            keep,
            F.struct(F.lit(metric_id).alias("metric_id"), F.lit(basis).alias("basis_id"),
                     ((cum * factor).cast("double") / 100.0).alias("v")),
        )

    return F.array_compact(F.array(m(7, 701, F.lit(5), F.lit(True)), m(8, 801, k % 9, k % 11 != 2)))


def _versions(n: Column, v: Column) -> Column:
    """Original, restated, rejected, ambiguous and segment variants of one reported value."""

    def variant(number: int, value: Column, days: int, status: str, flags: Column, scope: str) -> Column:
        dims = vocab.TOTAL_DIMENSIONS_JSON if scope == vocab.CONSOLIDATED else "segment"
        return F.struct(
            F.lit(number).alias("ver"), value.alias("value"), F.lit(days).alias("lag_days"),
            F.lit(status).alias("observation_status"), flags.cast("long").alias("quality_flags"),
            F.lit(scope).alias("dimensional_scope"), F.sha2(F.lit(dims), 256).alias("dimensions_hash"),
        )

    total = vocab.CONSOLIDATED
    return F.array_compact(
        F.array(
            variant(1, v, 45, "selected", F.when(n % 61 == 0, 128).otherwise(0), total),
            F.when(n % 11 == 0, variant(2, v * 1.01, 155, "selected", F.lit(4), total)),
            F.when(n % 29 == 0, variant(3, v * 3.0, 50, "rejected", F.lit(0), total)),
            F.when(n % 43 == 0, variant(4, v * 5.0, 200, "selected", F.lit(131072), total)),
            F.when(n % 53 == 0, variant(5, v * 0.5, 45, "derived", F.lit(65536), "segment")),
        )
    )


def wide_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations with their period dates still attached."""
    k = F.col("k")
    n = k + F.year("finish") * 4 + F.quarter("finish")
    measured = F.when(F.col("sem") == "instant", _instants(k, F.col("cum"))).otherwise(
        _measures(k, F.col("rev"), F.col("finish")))
    every = (
        reported_periods(spark, d)
        .select("k", "sem", "start", "finish", F.inline(measured))
        .select("k", "sem", "start", "finish", "metric_id", "basis_id", F.inline(_versions(n, F.col("v"))))
    )
    finish, start = F.col("finish"), F.col("start")
    names, kinds, units = (F.array(*[F.lit(vocab.METRICS[i][j]) for i in range(1, 10)]) for j in range(3))
    filed = F.date_add(finish, F.col("lag_days"))
    return every.select(
        F.concat_ws("-", F.lit("obs"), "k", "metric_id", "sem", finish.cast("string"), "ver").alias("observation_id"),
        (k + 1).alias("security_id"),
        cik_of(k).alias("cik"),
        "metric_id",
        F.get(names, F.col("metric_id") - 1).alias("metric_name"),
        F.get(kinds, F.col("metric_id") - 1).alias("metric_kind"),
        F.get(units, F.col("metric_id") - 1).alias("unit_signature"),
        "basis_id",
        F.concat_ws("-", F.lit("period"), "k", "sem", finish.cast("string")).alias("period_id"),
        F.col("sem").alias("period_semantics"),
        start.alias("raw_start_date"),
        F.when(F.col("sem") != "instant", finish).alias("raw_end_date"),
        F.when(F.col("sem") == "instant", finish).alias("raw_instant_date"),
        F.when(F.col("sem") == "instant", F.lit(0)).otherwise(F.datediff(finish, start) + 1).alias("duration_days"),
        F.year(finish).alias("fiscal_year"),
        F.when(F.col("sem") == "fiscal_year", F.lit("FY")).otherwise(F.concat(F.lit("Q"), F.quarter(finish).cast("string"))).alias("fiscal_period"),
        "value",
        "dimensions_hash",
        "dimensional_scope",
        "observation_status",
        "quality_flags",
        F.concat_ws("-", cik_of(k), F.date_format(finish, "yy"), F.lpad(F.quarter(finish).cast("string"), 6, "0")).alias("accession_number"),
        filed.cast("timestamp").alias("available_at"),
    )


PERIOD_COLUMNS = ["raw_start_date", "raw_end_date", "raw_instant_date"]


def observations(spark: SparkSession, d: str) -> DataFrame:
    return wide_observations(spark, d).drop(*PERIOD_COLUMNS)


def reporting_periods(spark: SparkSession, d: str) -> DataFrame:
    return (
        wide_observations(spark, d)
        .groupBy("period_id", "cik", "period_semantics", "duration_days", "fiscal_year", "fiscal_period", *PERIOD_COLUMNS)
        .agg(F.min("accession_number").alias("accession_number"))
        .withColumn("period_kind", F.when(F.col("period_semantics") == "instant", F.lit("instant")).otherwise(F.lit("duration")))
    )


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Same rows as loading the facts from the two stored tables, without the join."""
    rows = wide_observations(spark, d).filter(
        F.col("observation_status").isin(*vocab.USABLE_STATUSES) & (F.col("dimensional_scope") == vocab.CONSOLIDATED)
    )
    return rows.select(
        "observation_id", "security_id", "metric_id", "value",
        F.coalesce("raw_start_date", "raw_instant_date").alias("period_start"),
        F.coalesce("raw_end_date", "raw_instant_date").alias("period_end"),
        "available_at", "quality_flags", "metric_kind", "period_semantics", "basis_id",
        "observation_status", "duration_days", "dimensions_hash",
    )
