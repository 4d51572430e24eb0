"""Reporting aggregates and the daily report table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow import vocab
from fundaflow.functions.flags import flag_names, has_any
from fundaflow.functions.text import unclassified


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counted = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def peer_counts(securities: DataFrame) -> DataFrame:
    return (
        securities.groupBy(unclassified(F.col("peer_group")).alias("peer_group"))
        .agg(F.count("*").alias("security_count"))
        .orderBy(F.col("security_count").desc(), "peer_group")
    )


def metric_coverage(observations: DataFrame) -> DataFrame:
    """Securities and rows per metric.  Rows are counted per security first, which combines on
    the map side and needs no distinct over the raw rows."""
    per_security = (
        observations.filter(F.col("observation_status").isin(*vocab.USABLE_STATUSES))
        .groupBy("metric_name", "security_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_security.groupBy("metric_name")
        .agg(F.count("*").alias("security_count"), F.sum("n").alias("observation_count"))
        .orderBy("metric_name")
    )


def latest_feature_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(
        F.col("created_at").desc(), F.col("as_of_time").desc(), F.col("feature_snapshot_id").desc()
    ).limit(1)


def _rows_of_latest(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    newest = latest_feature_snapshot(snapshots).select("feature_snapshot_id")
    return rows.join(F.broadcast(newest), "feature_snapshot_id", "left_semi")


def feature_quality(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    flags = F.col("feature_quality_flags")
    return _rows_of_latest(snapshots, rows).agg(
        F.count("*").alias("row_count"),
        F.count_if(flags != 0).alias("flagged"),
        *[F.count_if(has_any(flags, bit)).alias(name) for name, bit in vocab.FEAT.items()],
    )


def feature_top(snapshots: DataFrame, rows: DataFrame, n: int = 10) -> DataFrame:
    """First rows by peer group and symbol, rendered."""
    return (
        _rows_of_latest(snapshots, rows)
        .orderBy("peer_group", "symbol")
        .limit(n)
        .select(
            "symbol", "peer_group", "period_end",
            F.format_string("%.0f", "revenue_ttm_usd").alias("revenue_ttm_usd"),
            F.format_string("%.2f%%", F.col("revenue_growth_yoy_ratio") * 100).alias("revenue_yoy"),
            F.format_string("%.2f%%", F.col("net_margin_ratio") * 100).alias("net_margin"),
            F.format_string("%.0f", "free_cash_flow_ttm_usd").alias("fcf_usd"),
            F.format_string("%.2f", "net_debt_to_revenue_ratio").alias("net_debt_to_revenue"),
            flag_names(F.col("feature_quality_flags"), vocab.FEATURE_FLAGS).alias("flags"),
        )
    )


def latest_statements(statements: DataFrame) -> DataFrame:
    """Newest statement per security by end, availability and insertion."""
    order = W.partitionBy("security_id").orderBy(
        F.col("period_end").desc(), F.col("available_at").desc(), F.col("inserted_at").desc(), F.col("snapshot_id").desc()
    )
    return statements.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def statement_quality_summary(statements: DataFrame) -> DataFrame:
    flags = F.col("quality_flags")
    return latest_statements(statements).agg(
        F.count("*").alias("latest_snapshots"),
        F.count_if(F.col("free_cash_flow_usd") != 0).alias("latest_nonzero_fcf"),
        F.count_if(flags != 0).alias("latest_flagged"),
        *[F.count_if(has_any(flags, vocab.STMT[name])).alias(name)
          for name in ("missing_operating_cash_flow", "missing_capex", "derived_ttm")],
    )


def flagged_statements(statements: DataFrame, securities: DataFrame, n: int = 10) -> DataFrame:
    return (
        latest_statements(statements)
        .filter(F.col("quality_flags") != 0)
        .join(securities.select("security_id", "symbol"), "security_id")
        .orderBy(F.col("period_end").desc(), "symbol")
        .limit(n)
        .select(
            "symbol", "period_end", "quality_flags",
            F.format_string("%.0f", "free_cash_flow_usd").alias("fcf_usd"),
            flag_names(F.col("quality_flags"), vocab.STATEMENT_FLAGS).alias("names"),
        )
    )


def _section(df: DataFrame, section: str, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))


def _one_row(df: DataFrame, section: str) -> DataFrame:
    """A one-row frame turned into one item per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in df.columns])
    return df.select(F.lit(section).alias("section"), F.inline(pairs))


def daily_report(data: Mapping[str, DataFrame], execution: Mapping[str, DataFrame], securities: DataFrame,
                 observations: DataFrame, snapshots: DataFrame, feature_rows: DataFrame, statements: DataFrame,
                 mode: str, date: str) -> DataFrame:
    """Every report section as (section, item, value)."""
    spark = securities.sparkSession
    state = spark.createDataFrame([("state", "date", date), ("state", "trading_mode", mode)],
                                  "section string, item string, value string")
    top = feature_top(snapshots, feature_rows)
    flagged = flagged_statements(statements, securities)
    coverage = metric_coverage(observations)
    newest = latest_feature_snapshot(snapshots)
    parts = [
        state,
        _section(table_counts(data), "data", F.col("table_name"), F.col("row_count")),
        _section(peer_counts(securities), "peer_groups", F.col("peer_group"), F.col("security_count")),
        _section(coverage, "canonical_metrics", F.col("metric_name"),
                 F.concat(F.lit("securities="), "security_count", F.lit(" observations="), "observation_count")),
        _section(newest, "features", F.lit("latest"),
                 F.concat(F.lit("name="), "name", F.lit(" version="), "feature_version", F.lit(" securities="), "security_count")),
        _one_row(feature_quality(snapshots, feature_rows), "features"),
        _section(top, "feature_rows", F.col("symbol"),
                 F.concat_ws(" ", "peer_group", F.col("period_end").cast("string"), "revenue_ttm_usd", "revenue_yoy",
                             "net_margin", "fcf_usd", "net_debt_to_revenue", "flags")),
        _section(table_counts(execution), "model/execution", F.col("table_name"), F.col("row_count")),
        _one_row(statement_quality_summary(statements), "statement_quality"),
        _section(flagged, "flagged_statements", F.col("symbol"),
                 F.concat_ws(" ", F.col("period_end").cast("string"), "fcf_usd", F.col("quality_flags").cast("string"), "names")),
    ]
    return reduce(DataFrame.unionByName, parts)
