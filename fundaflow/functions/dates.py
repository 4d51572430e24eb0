"""Instants, period lengths and fiscal labels."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}([Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2}))?$"
QUARTER_DAYS = (70, 110)
ANNUAL_DAYS = (330, 380)
YTD_DAYS = (130, 300)


def as_utc(moment: datetime) -> Column:
    """A timestamp literal; naive datetimes are taken as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(moment.timestamp() * 1_000_000)))


def parse_instant(c: Column) -> Column:
    """RFC 3339 text or a plain date, cut to whole seconds; anything else is NULL (unknown)."""
    text = F.trim(c)
    return F.when(
        text.rlike(INSTANT_PATTERN), F.date_trunc("second", F.try_to_timestamp(F.upper(text)))
    )


def parse_day(c: Column) -> Column:
    """Strict YYYY-MM-DD, else NULL."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def epoch_day(c: Column) -> Column:
    return F.coalesce(F.unix_date(parse_day(c)), F.lit(0))


def epoch_second(c: Column) -> Column:
    return F.coalesce(F.unix_seconds(parse_instant(c)), F.lit(0))


def day_text(day: Column) -> Column:
    return F.when(day > 0, F.date_from_unix_date(day.cast("int")).cast("string")).otherwise(F.lit(""))


def second_text(second: Column) -> Column:
    stamp = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return F.when(second > 0, stamp).otherwise(F.lit(""))


def duration_days(start: Column, end: Column) -> Column:
    """Both days counted; 0 when either text is not a date."""
    return F.coalesce(F.datediff(parse_day(end), parse_day(start)) + 1, F.lit(0))


def next_date(end: Column) -> Column:
    return F.date_add(parse_day(end), 1).cast("string")


def is_quarter_like(days: Column) -> Column:
    return days.between(*QUARTER_DAYS)


def is_fiscal_ytd(days: Column, quarter: Column) -> Column:
    return (quarter > 1) & days.between(quarter * QUARTER_DAYS[0], quarter * QUARTER_DAYS[1])


def period_length_class(days: Column) -> Column:
    return (
        F.when(days == 0, F.lit("instant"))
        .when(is_quarter_like(days), F.lit("13w"))
        .when(days.between(*ANNUAL_DAYS), F.lit("year"))
        .otherwise(F.lit("irregular"))
    )


def calendar_quarter(day_text_col: Column) -> Column:
    """Quarter of the month in characters 6-7 of the text, 0 when there is none."""
    month = F.substring(day_text_col, 6, 2).try_cast("int")
    return F.coalesce(F.floor((month - 1) / 3).cast("int") + 1, F.lit(0))


def comparable_fiscal_year(end: Column, document_end: Column, fiscal_year: Column) -> Column:
    """Fiscal year of a period whose end, moved by whole years, lands on the document end.

    The rebuilt date is parsed, so a 29 February without counterpart gives NULL.
    """
    e, d = parse_day(end), parse_day(document_end)
    years = F.year(d) - F.year(e)
    moved = parse_day(F.concat(F.date_format(d, "yyyy"), F.date_format(e, "-MM-dd")))
    return F.when(years.between(0, 10) & (F.abs(F.datediff(moved, d)) <= 10), fiscal_year - years)


def fiscal_period(c: Column) -> Column:
    label = F.upper(F.trim(c))
    return F.when(label.rlike("^Q?[1-4]$"), F.concat(F.lit("Q"), F.right(label, F.lit(1)))).otherwise(label)


def fiscal_ordinal(c: Column) -> Column:
    label = F.upper(F.trim(c))
    return F.when(label.rlike("^Q?[1-4]$"), F.right(label, F.lit(1)).cast("int"))


def available_at(filed_at: Column, accepted_at: Column) -> Column:
    """The later of the two knowledge times, whichever are known."""
    return F.greatest(filed_at, accepted_at)
