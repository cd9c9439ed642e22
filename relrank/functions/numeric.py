"""Numeric helpers shared by features, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 9
REPORT_DIGITS = 6


def finite_or_zero(c: Column) -> Column:
    """Double value of the column; unparsable, NaN and infinite become zero."""
    number = c.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(usable, number).otherwise(F.lit(0.0))


def score(c: Column) -> Column:
    """Scores are rounded before they are ordered, so that ties do not depend on summation order."""
    return F.round(c, SCORE_DIGITS)


def report(c: Column) -> Column:
    return F.round(c, REPORT_DIGITS)


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * ratio(part, whole), 2)
