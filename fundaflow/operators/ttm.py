"""Trailing-twelve-month values per security, metric and period end.

Plan shape.  Facts are first reduced to one row per *period shape* (security, metric,
identity, dates) keeping its earliest and its newest version.  That aggregation combines on
the map side, so a security with very many restated rows reaches the shuffle already small.
The shapes are then partitioned by security once; every later window and aggregation is keyed
by security_id plus more columns, so it runs in place without another exchange.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fundaflow import vocab
from fundaflow.operators.select import (
    DAY_TOLERANCE,
    FLOW_KINDS,
    close_days,
    comparable,
    flow_class,
    is_fresh,
    is_point,
    is_usable,
)

FLOW_METRICS = [vocab.METRIC_ID[n] for n in ("revenue", "net_income", "eps_diluted", "operating_cash_flow", "capex")]
POINT_METRICS = [vocab.METRIC_ID[n] for n in ("diluted_shares", "cash", "debt")]
REVENUE = vocab.METRIC_ID["revenue"]

SHAPE = [
    "security_id", "metric_id", "metric_kind", "basis_id", "dimensions_hash",
    "period_semantics", "period_start", "period_end", "duration_days",
]
VERSION_TYPE = "struct<order_key:bigint,observation_id:string,value:double,quality_flags:bigint,available_at:timestamp>"
ANNUAL_TYPE = f"struct<end_day:int,start_day:int,oldest:{VERSION_TYPE},newest:{VERSION_TYPE}>"


def period_shapes(facts: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """One row per distinct period shape of the usable facts.

    `newest` is the latest available version and `oldest` the earliest, the smaller
    observation id winning ties.
    """
    moment = F.unix_micros("available_at")
    rows = facts.filter(is_usable()).filter(F.col("metric_id").isin(FLOW_METRICS + POINT_METRICS))
    if now is not None:
        rows = rows.filter(is_fresh(now, max_age_s))
    version = ["observation_id", "value", "quality_flags", "available_at"]
    return (
        rows.groupBy(*SHAPE)
        .agg(
            F.min(F.struct((-moment).alias("order_key"), *version)).alias("newest"),
            F.min(F.struct(moment.alias("order_key"), *version)).alias("oldest"),
        )
        .repartition("security_id")
        .withColumn("flow_class", flow_class())
    )


def _by_newest() -> list[Column]:
    """Leading order keys shared by every "latest available wins" choice."""
    return [
        F.col("newest.order_key").alias("order_key"),
        F.col("basis_id").alias("basis_order"),
        F.col("newest.observation_id").alias("id_order"),
    ]


def _point_fields() -> list[Column]:
    return [
        F.col("newest.value").alias("value"),
        F.coalesce("period_start", "period_end").alias("period_start"),
        F.col("newest.available_at").alias("available_at"),
        F.col("newest.quality_flags").alias("quality_flags"),
    ]


def _with_bridges(shapes: DataFrame) -> DataFrame:
    """Adds, to each quarter or year-to-date shape, its best annual + current - prior bridge.

    Two sliding day-range windows find partners: annual shapes ending the day before the
    current start (+-7 days), then, per such annual, shapes starting with it (+-7 days).  A
    frame spans 15 calendar days of one metric and identity, so it stays small whatever the
    number of rows.  Output: all input rows plus one `pair` row per current and annual shape.
    """
    identity = ["security_id", "metric_id", "metric_kind", "basis_id", "dimensions_hash"]
    start_day, end_day = F.unix_date("period_start"), F.unix_date("period_end")
    is_current = F.coalesce(F.col("flow_class").isin("quarter", "ytd"), F.lit(False))

    annual = F.when(
        F.col("flow_class") == "annual",
        F.struct(
            end_day.alias("end_day"), start_day.alias("start_day"), "oldest", "newest",
        ),
    )
    key = F.when(F.col("flow_class") == "annual", end_day + 1).otherwise(start_day)
    near = W.partitionBy(*identity).orderBy("near_day").rangeBetween(-DAY_TOLERANCE, DAY_TOLERANCE)
    partners = F.filter(
        F.collect_list(annual).over(near), lambda a: (a["end_day"] < end_day) & a["start_day"].isNotNull()
    )
    # one row for the shape itself (annual_pair NULL) and one per matching annual
    no_pair = F.array(F.lit(None).cast(ANNUAL_TYPE))
    met = shapes.withColumn("near_day", key).withColumn("annuals", F.when(is_current, partners))
    paired = met.select(
        *[c for c in shapes.columns],
        F.explode(F.concat(no_pair, F.coalesce("annuals", F.array().cast(f"array<{ANNUAL_TYPE}>")))).alias("annual_pair"),
    )

    candidate = F.when(
        F.col("annual_pair").isNull() & F.col("metric_kind").isin(*FLOW_KINDS),
        F.struct(
            F.col("newest.order_key").alias("order_key"),
            F.col("newest.observation_id").alias("observation_id"),
            F.col("newest.value").alias("value"),
            F.col("newest.available_at").alias("available_at"),
            F.col("newest.quality_flags").alias("quality_flags"),
            end_day.alias("end_day"),
            F.col("duration_days").alias("days"),
        ),
    )
    prior_key = F.when(F.col("annual_pair").isNull(), start_day).otherwise(F.col("annual_pair.start_day"))
    around = (
        W.partitionBy(*identity, "period_semantics")
        .orderBy("prior_day")
        .rangeBetween(-DAY_TOLERANCE, DAY_TOLERANCE)
    )
    found = F.filter(
        F.collect_list(candidate).over(around),
        lambda p: (p["end_day"] < F.col("annual_pair.end_day")) & close_days(p["days"], F.col("duration_days")),
    )
    with_prior = paired.withColumn("prior_day", prior_key).withColumn(
        "prior", F.when(F.col("annual_pair").isNotNull(), F.array_min(found)))

    def bridge(current: str, year: str) -> Column:
        c, a, p = F.col(current), F.col("annual_pair")[year], F.col("prior")
        available = F.greatest(c["available_at"], a["available_at"], p["available_at"])
        flags = (
            c["quality_flags"].bitwiseOR(a["quality_flags"]).bitwiseOR(p["quality_flags"])
            .bitwiseOR(F.lit(vocab.OBS_DERIVED).cast("long"))
        )
        return F.struct(
            (-F.unix_micros(available)).alias("order_key"),
            F.unix_micros(c["available_at"]).alias("current_order"),
            F.col("basis_id").alias("basis_order"),
            c["observation_id"].alias("current_id"),
            F.col("annual_pair.end_day").alias("annual_end"),
            F.unix_micros(a["available_at"]).alias("annual_order"),
            a["observation_id"].alias("annual_id"),
            (a["value"] + c["value"] - p["value"]).alias("value"),
            F.date_from_unix_date("annual_pair.start_day").alias("period_start"),
            available.alias("available_at"),
            flags.alias("quality_flags"),
        )

    # Only the earliest and the newest version of a shape can win: the bridge with the
    # greatest availability, then the earliest current, then the earliest annual.
    versions = F.array(*[bridge(c, y) for c in ("oldest", "newest") for y in ("oldest", "newest")])
    return with_prior.withColumn(
        "bridge", F.when(F.col("prior").isNotNull(), F.array_min(versions))
    )


def metric_ladder(shapes: DataFrame) -> DataFrame:
    """One row per security, metric and period end with every candidate value on it."""
    itself = F.col("annual_pair").isNull()
    annual = F.struct(*_by_newest(), *_point_fields())
    quarter = F.struct(
        *_by_newest(), *_point_fields(),
        "metric_kind", "period_semantics", "basis_id", "dimensions_hash", "duration_days",
        F.col("period_start").alias("raw_start"),
    )
    ladder = _with_bridges(shapes).groupBy("security_id", "metric_id", "period_end").agg(
        F.min(F.when(itself & (F.col("flow_class") == "annual"), annual)).alias("annual"),
        F.min(F.when(itself & (F.col("flow_class") == "quarter"), quarter)).alias("quarter"),
        F.min(F.when(itself & is_point(), annual)).alias("point"),
        F.min("bridge").alias("bridge"),
    )
    return ladder.withColumn("four_quarters", _four_quarters())


def _four_quarters() -> Column:
    """Newest four quarter ends of the metric, each comparable to the newest one."""
    w = W.partitionBy("security_id", "metric_id", F.col("quarter").isNotNull()).orderBy(F.col("period_end").desc())
    q = [F.col("quarter")] + [F.lead("quarter", i).over(w) for i in (1, 2, 3)]
    all_comparable = comparable(q[0], q[1]) & comparable(q[0], q[2]) & comparable(q[0], q[3])
    flags = q[0]["quality_flags"]
    for other in q[1:]:
        flags = flags.bitwiseOR(other["quality_flags"])
    return F.when(
        q[0].isNotNull() & all_comparable,
        F.struct(
            (q[0]["value"] + q[1]["value"] + q[2]["value"] + q[3]["value"]).alias("value"),
            F.least(*[x["raw_start"] for x in q]).alias("period_start"),
            F.greatest(*[x["available_at"] for x in q]).alias("available_at"),
            flags.alias("quality_flags"),
        ),
    )


def _as_point(name: str) -> Column:
    c = F.col(name)
    return F.when(
        c.isNotNull(),
        F.struct(c["value"].alias("value"), c["period_start"].alias("period_start"),
                 c["available_at"].alias("available_at"), c["quality_flags"].alias("quality_flags")),
    )


def _flows_only(ladder: DataFrame, name: str) -> DataFrame:
    return ladder.filter(F.col("metric_id").isin(FLOW_METRICS) & F.col(name).isNotNull()).select(
        "security_id", "metric_id", "period_end", f"{name}.value", f"{name}.period_start",
        f"{name}.available_at", f"{name}.quality_flags",
    )


def ttm_annual(facts: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """Latest available annual fact per period end."""
    shapes = period_shapes(facts, now, max_age_s).filter(F.col("flow_class") == "annual")
    chosen = shapes.groupBy("security_id", "metric_id", "period_end").agg(
        F.min(F.struct(*_by_newest(), *_point_fields())).alias("annual")
    )
    return _flows_only(chosen, "annual")


def ttm_quarters(facts: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """Sum of the newest four comparable quarters ending on each quarter end."""
    shapes = period_shapes(facts, now, max_age_s).filter(F.col("flow_class") == "quarter")
    quarter = F.struct(
        *_by_newest(), *_point_fields(),
        "metric_kind", "period_semantics", "basis_id", "dimensions_hash", "duration_days",
        F.col("period_start").alias("raw_start"),
    )
    chosen = shapes.groupBy("security_id", "metric_id", "period_end").agg(F.min(quarter).alias("quarter"))
    return _flows_only(chosen.withColumn("four_quarters", _four_quarters()), "four_quarters")


def ttm_bridge(facts: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """Annual + current year-to-date - prior year-to-date per period end."""
    shapes = period_shapes(facts, now, max_age_s).filter(F.col("metric_id").isin(FLOW_METRICS))
    chosen = (
        _with_bridges(shapes)
        .filter(F.col("bridge").isNotNull())
        .groupBy("security_id", "metric_id", "period_end")
        .agg(F.min("bridge").alias("bridge"))
    )
    return _flows_only(chosen, "bridge")


def _cascade(ladder: DataFrame) -> DataFrame:
    source = (
        F.when(F.col("annual").isNotNull(), F.lit("annual"))
        .when(F.col("four_quarters").isNotNull(), F.lit("quarters"))
        .when(F.col("bridge").isNotNull(), F.lit("bridge"))
    )
    value = F.coalesce(_as_point("annual"), _as_point("four_quarters"), _as_point("bridge"))
    return ladder.withColumns({"flow": value, "flow_source": source})


def flow_ttm(facts: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """Annual fact, else four quarters, else the year-to-date bridge."""
    ladder = _cascade(metric_ladder(period_shapes(facts, now, max_age_s)))
    return ladder.filter(F.col("metric_id").isin(FLOW_METRICS) & F.col("flow").isNotNull()).select(
        "security_id", "metric_id", "period_end", "flow_source", "flow.*"
    )


def statement_timeline(facts: DataFrame, now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """One row per security and period end: five flows, three as-of points, anchor mark.

    Points are carried forward from the newest period end at or before the row.
    """
    ladder = _cascade(metric_ladder(period_shapes(facts, now, max_age_s)))

    def of_metric(metric_id: int, name: str) -> Column:
        return F.max(F.when(F.col("metric_id") == metric_id, F.col(name)))

    names = {m: vocab.METRICS[m][0] for m in FLOW_METRICS + POINT_METRICS}
    has_period = F.col("annual").isNotNull() | F.col("quarter").isNotNull()
    pivot = ladder.withColumn("point", _as_point("point")).groupBy("security_id", "period_end").agg(
        F.coalesce(F.bool_or((F.col("metric_id") == REVENUE) & has_period), F.lit(False)).alias("is_anchor"),
        *[of_metric(m, "flow").alias(names[m]) for m in FLOW_METRICS],
        *[of_metric(m, "point").alias(names[m]) for m in POINT_METRICS],
    )
    upto = W.partitionBy("security_id").orderBy("period_end").rowsBetween(W.unboundedPreceding, 0)
    return pivot.withColumns({names[m]: F.last(names[m], ignorenulls=True).over(upto) for m in POINT_METRICS})


def _newest_anchors(timeline: DataFrame, n: int | None) -> DataFrame:
    w = W.partitionBy("security_id").orderBy(F.col("period_end").desc())
    ranked = timeline.withColumn("anchor_rank", F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col("anchor_rank") <= n)


def anchors(facts: DataFrame, securities: DataFrame, n: int | None = None,
            now: datetime | None = None, max_age_s: int = 0) -> DataFrame:
    """Period ends with quarterly or annual revenue per investable security, the newest first; the newest `n` if given."""
    revenue = facts.filter(is_usable() & (F.col("metric_id") == REVENUE) & flow_class().isin("quarter", "annual"))
    if now is not None:
        revenue = revenue.filter(is_fresh(now, max_age_s))
    ends = revenue.select("security_id", "period_end").distinct()
    listed = securities.filter("investable").select("security_id")
    return _newest_anchors(ends.join(listed, "security_id", "left_semi"), n)


def latest_point(facts: DataFrame, anchor_days: DataFrame, now: datetime | None = None,
                 max_age_s: int = 0) -> DataFrame:
    """As-of lookup: newest point of each metric at or before each anchor.

    Points and anchors share one timeline per security and metric; the answer is the last
    non-null point seen so far, so no point-anchor pairs are formed.
    """
    shapes = period_shapes(facts, now, max_age_s).filter(is_point())
    points = shapes.groupBy("security_id", "metric_id", "period_end").agg(
        F.min(F.struct(*_by_newest(), *_point_fields(), "period_end")).alias("point")
    )
    asked = anchor_days.select(
        "security_id",
        F.explode(F.array(*[F.lit(m) for m in POINT_METRICS])).alias("metric_id"),
        "period_end",
        F.lit(True).alias("asked"),
    ).distinct()
    line = points.unionByName(asked, allowMissingColumns=True)
    # an anchor sees the points of its own day
    w = (
        W.partitionBy("security_id", "metric_id")
        .orderBy("period_end", F.col("asked").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        line.withColumn("point", F.last("point", ignorenulls=True).over(w))
        .filter(F.col("asked") & F.col("point").isNotNull())
        .select(
            "security_id", "metric_id", F.col("period_end").alias("anchor_day"),
            F.col("point.period_end").alias("period_end"), "point.value", "point.period_start",
            "point.available_at", "point.quality_flags",
        )
    )
