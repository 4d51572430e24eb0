"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
NBSP = "\u00a0"


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    """Bound a finite value; callers test for NaN first."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(c, lo), hi)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d when both are finite and the denominator exceeds one unit, else 0."""
    return F.when(is_finite(n) & is_finite(d) & (F.abs(d) > 1.0), F.try_divide(n, d)).otherwise(F.lit(0.0))


def parse_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def scaled_number(text: Column, scale: Column) -> Column:
    """Thousands separators dropped, parentheses negate, times ten to the scale; NULL if not a number."""
    clean = F.replace(F.replace(F.trim(text), F.lit(","), F.lit("")), F.lit(NBSP), F.lit(""))
    bracketed = clean.startswith("(") & clean.endswith(")")
    body = F.when(bracketed, F.regexp_replace(clean, r"^\(+|\)+$", "")).otherwise(clean)
    number = parse_number(body)
    power = F.coalesce(F.trim(scale).try_cast("int"), F.lit(0))
    return F.when(bracketed, -number).otherwise(number) * F.pow(F.lit(10.0), power)


def integer_text(text: Column) -> Column:
    """Whole number; a text with a decimal point is cut towards zero."""
    clean = F.trim(text)
    return F.when(clean.contains("."), parse_number(clean).try_cast("int")).when(
        clean.rlike(r"^[+-]?\d+$"), clean.try_cast("int")
    )


def trimmed_decimal(c: Column) -> Column:
    """Six decimals, ties to even, without trailing zeros; non-finite values print as 0."""
    fixed = F.coalesce(F.bround(c.try_cast("decimal(38,15)"), 6).cast("decimal(38,6)").cast("string"), F.format_string("%.6f", c))
    text = F.regexp_replace(fixed, r"\.?0+$", "")
    return F.when(is_finite(c), text).otherwise(F.lit("0"))


def exact_sum(c: Column) -> Column:
    """Sum of doubles that does not depend on the order in which partitions arrive.

    Whole parts and fractions are summed apart, in fixed point: whole parts without any loss up to 1e38, fractions
    to twenty digits.  Beyond that range, and for values that are not finite, it is the plain sum of doubles.
    """
    fraction = c % F.lit(1.0)
    whole = F.try_sum((c - fraction).try_cast("decimal(38,0)"))
    fits = F.count(c) == F.count((c - fraction).try_cast("decimal(38,0)"))
    exact = whole.cast("double") + F.try_sum(fraction.try_cast("decimal(38,20)")).cast("double")
    return F.when(fits, F.coalesce(exact, F.sum(c))).otherwise(F.sum(c))
