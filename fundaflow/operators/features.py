"""Point-in-time feature rows and immutable feature snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow import vocab
from fundaflow.functions.dates import as_utc
from fundaflow.functions.flags import bit_if, combine, has_any
from fundaflow.functions.ids import content_hash, set_digest, stable_id
from fundaflow.functions.numbers import is_finite, safe_ratio
from fundaflow.functions.text import unclassified

FEATURE_VERSION = "feature_snapshot.v1"
PRIOR_TARGET_DAYS, PRIOR_TOLERANCE_DAYS = 365, 75
COMPARABLE_GAP = (290, 440)
SOURCE_COLUMNS = [
    "snapshot_id", "security_id", "period_end", "available_at", "revenue_usd", "net_income_usd", "diluted_shares",
    "operating_cash_flow_usd", "capex_usd", "free_cash_flow_usd", "cash_usd", "debt_usd", "net_debt_usd",
    "quality_flags", "source_hash",
]


def known_statements(statements: DataFrame, as_of: datetime) -> DataFrame:
    return statements.filter(F.col("is_ttm") & (F.col("available_at") <= as_utc(as_of)))


def newest_per_end(statements: DataFrame) -> DataFrame:
    """Newest version of each security and period end, combined on the map side."""
    order = F.struct("available_at", "inserted_at", "snapshot_id")
    return statements.groupBy("security_id", "period_end").agg(
        F.max_by(F.struct(*SOURCE_COLUMNS), order).alias("statement")
    )


def latest_as_of(statements: DataFrame, securities: DataFrame, as_of: datetime,
                 universe: DataFrame | None = None) -> DataFrame:
    """Newest known statement of each investable security, optionally of universe members only."""
    newest = (
        newest_per_end(known_statements(statements, as_of))
        .groupBy("security_id")
        .agg(F.max_by("statement", "period_end").alias("latest"))
    )
    return _of_universe(newest, securities, universe)


def _of_universe(rows: DataFrame, securities: DataFrame, universe: DataFrame | None) -> DataFrame:
    """Rows of investable securities with their names, of universe members only if one is given."""
    listed = securities.filter("investable").select(
        "security_id", "symbol",
        unclassified(F.col("peer_group")).alias("peer_group"),
        unclassified(F.col("sector")).alias("sector"),
        unclassified(F.col("industry")).alias("industry"),
    )
    rows = rows.join(listed, "security_id")
    return rows if universe is None else rows.join(universe.select("security_id").distinct(), "security_id", "left_semi")


def prior_year(latest: DataFrame, statements: DataFrame, as_of: datetime) -> DataFrame:
    """Adds `previous`: the known older statement closest to a year before the latest one.

    An end within the tolerance of 365 days beats any other; then the smaller distance, then
    the newer end.  Statements are reduced to one row per security and end before the join,
    and the latest side has one row per security, so the join cannot multiply rows.
    """
    older = newest_per_end(known_statements(statements, as_of))
    gap = F.datediff(F.col("latest.period_end"), F.col("period_end"))
    distance = F.abs(gap - PRIOR_TARGET_DAYS)
    rank = F.struct(
        F.when(distance <= PRIOR_TOLERANCE_DAYS, 0).otherwise(1).alias("outside"),
        distance.alias("distance"),
        (-F.unix_date("period_end")).alias("age"),
    )
    best = (
        older.join(latest.select("security_id", "latest"), "security_id")
        .filter(F.col("period_end") < F.col("latest.period_end"))
        .groupBy("security_id")
        .agg(F.min_by("statement", rank).alias("previous"))
    )
    return latest.join(best, "security_id", "left")


def latest_with_prior(statements: DataFrame, securities: DataFrame, as_of: datetime, universe: DataFrame | None = None) -> DataFrame:
    """latest_as_of() and prior_year() in one pass over the statements.

    They are reduced to one row per security and end once; latest and prior then come from one
    window and one aggregate by security, which share an exchange.
    """
    ends = newest_per_end(known_statements(statements, as_of))
    newest = F.max("period_end").over(W.partitionBy("security_id"))
    distance = F.abs(F.datediff("latest_end", "period_end") - PRIOR_TARGET_DAYS)
    rank = F.struct(F.when(distance <= PRIOR_TOLERANCE_DAYS, 0).otherwise(1).alias("outside"), distance.alias("distance"), (-F.unix_date("period_end")).alias("age"))
    older = F.col("period_end") < F.col("latest_end")
    both = ends.withColumn("latest_end", newest).groupBy("security_id").agg(
        F.max_by("statement", "period_end").alias("latest"), F.min_by(F.when(older, F.col("statement")), F.when(older, rank)).alias("previous"))
    return _of_universe(both, securities, universe)


def feature_flags() -> Column:
    """Six feature bits of a row holding `latest` and `previous`."""
    f, latest, previous = vocab.FEAT, F.col("latest"), F.col("previous")
    return combine(
        bit_if(previous.isNull(), f["missing_previous"]),
        bit_if(previous.isNotNull() & ~previous_is_comparable(), f["non_comparable_previous"]),
        bit_if(~is_finite(latest["revenue_usd"]) | (latest["revenue_usd"] <= 0), f["missing_revenue"]),
        bit_if(
            has_any(latest["quality_flags"], vocab.STMT["missing_operating_cash_flow"] | vocab.STMT["missing_capex"]),
            f["missing_fcf"],
        ),
        bit_if(~is_finite(latest["diluted_shares"]) | (latest["diluted_shares"] <= 0), f["missing_shares"]),
        bit_if(merged_statement_flags() != 0, f["statement_flagged"]),
    )


def previous_is_comparable() -> Column:
    gap = F.datediff(F.col("latest.period_end"), F.col("previous.period_end"))
    return F.coalesce(gap.between(*COMPARABLE_GAP), F.lit(False))


def merged_statement_flags() -> Column:
    return F.col("latest.quality_flags").bitwiseOR(F.coalesce("previous.quality_flags", F.lit(0).cast("long")))


def feature_rows(paired: DataFrame) -> DataFrame:
    """Growth, margins and leverage of each latest statement."""
    latest, previous = F.col("latest"), F.col("previous")
    base = F.abs(previous["revenue_usd"])
    growth = F.when(
        previous_is_comparable() & is_finite(previous["revenue_usd"]) & (base > 1.0),
        F.try_divide(latest["revenue_usd"] - previous["revenue_usd"], base),
    ).otherwise(F.lit(0.0))
    rows = paired.select(
        "security_id", "symbol", "peer_group", "sector", "industry",
        latest["period_end"].alias("period_end"),
        latest["available_at"].alias("available_at"),
        latest["revenue_usd"].alias("revenue_ttm_usd"),
        growth.alias("revenue_growth_yoy_ratio"),
        safe_ratio(latest["net_income_usd"], latest["revenue_usd"]).alias("net_margin_ratio"),
        latest["operating_cash_flow_usd"].alias("operating_cash_flow_ttm_usd"),
        latest["capex_usd"].alias("capex_ttm_usd"),
        latest["free_cash_flow_usd"].alias("free_cash_flow_ttm_usd"),
        safe_ratio(latest["free_cash_flow_usd"], latest["revenue_usd"]).alias("fcf_margin_ratio"),
        latest["cash_usd"].alias("cash_usd"),
        latest["debt_usd"].alias("debt_usd"),
        latest["net_debt_usd"].alias("net_debt_usd"),
        safe_ratio(latest["net_debt_usd"], latest["revenue_usd"]).alias("net_debt_to_revenue_ratio"),
        latest["diluted_shares"].alias("diluted_shares"),
        merged_statement_flags().alias("statement_quality_flags"),
        feature_flags().alias("feature_quality_flags"),
        latest["snapshot_id"].alias("source_statement_snapshot_id"),
        previous["snapshot_id"].alias("previous_statement_snapshot_id"),
        latest["source_hash"].alias("latest_source_hash"),
        previous["source_hash"].alias("previous_source_hash"),
    )
    # ratios follow from the hashed amounts, so the row is identified by amounts, bits and sources
    row_hash = content_hash(
        security_id=(F.col("security_id"), "int"),
        symbol=F.col("symbol"),
        period_end=(F.col("period_end"), "date"),
        available_at=(F.col("available_at"), "time"),
        statement_quality_flags=(F.col("statement_quality_flags"), "int"),
        feature_quality_flags=(F.col("feature_quality_flags"), "int"),
        source=F.col("source_statement_snapshot_id"),
        previous=F.col("previous_statement_snapshot_id"),
    )
    return rows.withColumn("row_hash", row_hash)


def feature_snapshot(rows: DataFrame, name: str, as_of: datetime, universe_id: str | None,
                     created_at: Column) -> DataFrame:
    """The snapshot header: input hash over all sources, id, row and flag counts.

    The input hash is order-free and combines on the map side: all bits of the hashes of the
    rows' sources enter a set digest, which is hashed once.
    """
    source = content_hash(
        security_id=(F.col("security_id"), "int"),
        latest=F.col("source_statement_snapshot_id"), latest_hash=F.col("latest_source_hash"),
        previous=F.col("previous_statement_snapshot_id"), previous_hash=F.col("previous_source_hash"),
    )
    flagged = (F.col("feature_quality_flags") != 0) | (F.col("statement_quality_flags") != 0)
    digest = rows.agg(
        F.count("*").alias("security_count"),
        F.count_if(flagged).alias("flagged_count"),
        set_digest(source).alias("sources"),
    )
    input_hash = content_hash(sources=F.col("sources"))
    return digest.select(
        F.lit(name).alias("name"),
        F.lit(universe_id).cast("string").alias("universe_snapshot_id"),
        as_utc(as_of).alias("as_of_time"),
        F.lit(FEATURE_VERSION).alias("feature_version"),
        input_hash.alias("input_statement_hash"),
        "security_count", "flagged_count",
        created_at.alias("created_at"),
    ).withColumn(
        "feature_snapshot_id",
        stable_id(
            "feat",
            name=F.col("name"),
            as_of_time=(F.col("as_of_time"), "time"),
            feature_version=F.col("feature_version"),
            universe_snapshot_id=F.col("universe_snapshot_id"),
            input_statement_hash=F.col("input_statement_hash"),
        ),
    )
