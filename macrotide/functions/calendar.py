"""US federal business days as rules on date columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Holidays on a day of a month (month, day, first year) and on the n-th weekday of one
#: (month, weekday from Monday 0, first and last possible day, first year).
FIXED = [(1, 1, 1), (6, 19, 2021), (7, 4, 1), (11, 11, 1), (12, 25, 1)]
FLOATING = [(1, 0, 15, 21, 1986), (2, 0, 15, 21, 1971), (5, 0, 25, 31, 1971), (9, 0, 1, 7, 1), (10, 0, 8, 14, 1970), (11, 3, 22, 28, 1)]


def is_holiday(day: Column) -> Column:
    """Whether a weekday is a holiday or the day it is observed on (Saturday: the Friday before, Sunday: the Monday after)."""
    weekday = F.weekday(day)

    def falls(d: Column, month: int, number: int, since: int) -> Column:
        return (F.month(d) == month) & (F.dayofmonth(d) == number) & (F.year(d) >= since)

    found = F.lit(False)
    for month, number, since in FIXED:
        found = found | falls(day, month, number, since)
        found = found | ((weekday == 4) & falls(F.date_add(day, 1), month, number, since))
        found = found | ((weekday == 0) & falls(F.date_sub(day, 1), month, number, since))
    for month, on, lo, hi, since in FLOATING:
        found = found | ((weekday == on) & (F.month(day) == month) & F.dayofmonth(day).between(lo, hi) & (F.year(day) >= since))
    return found


def business_days(bounds: DataFrame) -> DataFrame:
    """(date) for the business days from ``first`` to ``last`` of a one-row table."""
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.filter((F.weekday("date") < 5) & ~is_holiday(F.col("date")))


def business_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(date) for the business days of a range given as ISO dates."""
    return business_days(spark.range(1).select(F.lit(start).cast("date").alias("first"), F.lit(end).cast("date").alias("last")))


def holiday_sql(d: str) -> str:
    """The rule of ``is_holiday`` in DuckDB's SQL."""

    def falls(x, month, number, since):
        return f"(month({x}) = {month} AND day({x}) = {number} AND year({x}) >= {since})"

    parts = []
    for month, number, since in FIXED:
        parts += [falls(d, month, number, since), f"(isodow({d}) = 5 AND {falls(f'({d} + 1)', month, number, since)})", f"(isodow({d}) = 1 AND {falls(f'({d} - 1)', month, number, since)})"]
    for month, on, lo, hi, since in FLOATING:
        parts.append(f"(isodow({d}) = {on + 1} AND month({d}) = {month} AND day({d}) BETWEEN {lo} AND {hi} AND year({d}) >= {since})")
    return "(" + " OR ".join(parts) + ")"
