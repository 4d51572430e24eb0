"""Growth forecast from the newest two comparable quarters of revenue and earnings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow import vocab
from fundaflow.config import ModelConfig
from fundaflow.functions.flags import bit_if
from fundaflow.functions.numbers import TINY, clamp, is_finite
from fundaflow.operators.select import comparable, is_fresh, is_model_comparable, is_usable

REVENUE, EARNINGS = vocab.METRIC_ID["revenue"], vocab.METRIC_ID["net_income"]


def latest_two(facts: DataFrame, metrics: tuple[int, ...] = (REVENUE, EARNINGS),
               now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """Newest value per security and metric, and the value of the period end before it.

    Facts are read in (end, available, basis, id) order.  Per end the first and the last
    fact are kept; the previous value is the last fact of the preceding end and counts only
    if the first fact of the newest end may be compared with it.  Quality bits accumulate
    over the whole history.
    """
    rows = facts.filter(is_usable() & is_model_comparable() & F.col("metric_id").isin(*metrics))
    if now is not None:
        rows = rows.filter(is_fresh(now, max_age_s))
    moment = F.unix_micros("available_at")
    version = [
        "value", "quality_flags", "metric_kind", "period_semantics", "basis_id", "dimensions_hash", "duration_days",
    ]
    # facts sharing end and availability count once, then one row per end: both combine on the map side and
    # are spread over more than the security, so an issuer with very many restatements is small before it is
    # gathered; the windows by security need no further exchange
    distinct_versions = (
        rows.groupBy("security_id", "metric_id", "period_end", "available_at")
        .agg(F.min(F.struct("basis_id", "observation_id", F.struct(*version).alias("fact"))).alias("chosen"))
        .select("security_id", "metric_id", "period_end", moment.alias("moment"), "chosen.fact")
    )
    ends = distinct_versions.groupBy("security_id", "metric_id", "period_end").agg(
        F.min_by("fact", "moment").alias("first"),
        F.max_by("fact", "moment").alias("last"),
        F.bit_or("fact.quality_flags").alias("flags"),
    ).repartition("security_id")
    newest_first = W.partitionBy("security_id", "metric_id").orderBy(F.col("period_end").desc())
    previous = F.struct("last", "period_end")
    pairs = (
        ends.withColumn("before", F.lead(previous).over(newest_first))
        .groupBy("security_id", "metric_id")
        .agg(
            F.max_by(F.struct("first", "last", "before"), "period_end").alias("top"),
            F.max("period_end").alias("latest_end"),
            F.bit_or("flags").alias("quality_flags"),
        )
    )
    kept = F.coalesce(comparable(F.col("top.first"), F.col("top.before.last")), F.lit(False))
    return pairs.select(
        "security_id", "metric_id", "latest_end",
        F.col("top.last.value").alias("latest_value"),
        F.when(kept, F.col("top.before.last.value")).alias("previous_value"),
        F.when(kept, F.col("top.before.period_end")).alias("previous_end"),
        "quality_flags",
    )


def clamped_growth(latest: Column, previous: Column, cap: float) -> Column:
    """(latest - previous) / |previous| within +-cap; NULL when there is no usable base."""
    base = F.abs(previous)
    growth = F.try_divide(latest - previous, base)
    usable = is_finite(latest) & is_finite(previous) & (base > TINY)
    return F.when(usable & is_finite(growth), clamp(growth, -cap, cap))


def forecasts(facts: DataFrame, securities: DataFrame, config: ModelConfig,
              now: datetime | None = None) -> DataFrame:
    """One forecast row per security."""
    cap = config.max_forecast_abs_growth_ratio
    pairs = latest_two(facts, now=now, max_age_s=config.max_fact_age_s).withColumn(
        "growth", clamped_growth(F.col("latest_value"), F.col("previous_value"), cap)
    )

    def of_metric(metric_id: int) -> Column:
        return F.max(F.when(F.col("metric_id") == metric_id, F.col("growth")))

    growth = pairs.groupBy("security_id").agg(
        of_metric(REVENUE).alias("revenue"),
        of_metric(EARNINGS).alias("earnings"),
        F.bit_or("quality_flags").alias("seen"),
    )
    rev, earn, listed = F.col("revenue"), F.col("earnings"), F.col("investable")
    both, neither = rev.isNotNull() & earn.isNotNull(), rev.isNull() & earn.isNull()
    seen = F.coalesce("seen", F.lit(0).cast("long"))
    flags = seen.bitwiseOR(bit_if(~both, vocab.OBS_MISSING_COMPARABLE)).bitwiseOR(
        bit_if(neither, vocab.OBS_LOW_CONFIDENCE)
    )
    expected = F.when(both, rev * 0.70 + earn * 0.30).when(rev.isNotNull(), rev * 0.50).otherwise(earn * 0.25)
    base = F.when(both, F.lit(0.80)).when(rev.isNotNull(), F.lit(0.45)).otherwise(F.lit(0.30))
    return (
        securities.join(growth, "security_id", "left")
        .withColumn("flags", flags)
        .select(
            "security_id", "investable",
            F.when(listed, F.coalesce(rev, F.lit(0.0))).otherwise(F.lit(0.0)).alias("revenue_growth_ratio"),
            F.when(listed, F.coalesce(earn, F.lit(0.0))).otherwise(F.lit(0.0)).alias("earnings_growth_ratio"),
            F.when(listed & ~neither, clamp(expected, -cap, cap)).otherwise(F.lit(0.0)).alias("expected_return_proxy"),
            F.when(listed & ~neither, clamp(F.when(F.col("flags") != 0, base * 0.70).otherwise(base), 0.0, 1.0))
            .otherwise(F.lit(0.0)).alias("confidence_ratio"),
            F.when(listed, F.col("flags")).otherwise(F.lit(0).cast("long")).alias("quality_flags"),
            (listed & ~neither).alias("has_growth"),
        )
        .withColumn("is_positive", is_positive(config))
        .withColumn(
            "reason",
            F.when(~F.col("has_growth"), F.lit("not investable or insufficient facts"))
            .when(F.col("is_positive"), F.lit("positive deterministic baseline score"))
            .otherwise(F.lit("below model threshold")),
        )
        .drop("has_growth", "is_positive")
    )


def is_positive(config: ModelConfig) -> Column:
    return (F.col("expected_return_proxy") > config.min_expected_return_proxy) & (F.col("confidence_ratio") >= 0.20)


def forecast_scores(rows: DataFrame, config: ModelConfig) -> DataFrame:
    """Forecasts with the score the portfolio step distributes exposure by."""
    eligible = F.col("investable") & is_positive(config)
    score = F.when(eligible, F.col("expected_return_proxy") * F.col("confidence_ratio")).otherwise(F.lit(0.0))
    return rows.withColumn("score", score).withColumn("eligible", eligible)
