"""Business-day calendar, gap filling and coverage.

A day holds one price per key after cleaning, so the window over one key never holds more rows
than the calendar has business days (about 260 a year, ``MAX_CALENDAR_DAYS`` at most).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.values import as_column, is_business_day, percent_filled

MAX_CALENDAR_DAYS = 200_000  # 547 years; the size bound of everything keyed by date alone


def check_bounds(start: str, end: str) -> tuple[Column, Column]:
    days = (Date.fromisoformat(end) - Date.fromisoformat(start)).days + 1
    if not 0 < days <= MAX_CALENDAR_DAYS:
        raise ValueError(f"calendar {start}..{end} has {days} days, 1..{MAX_CALENDAR_DAYS} allowed")
    return F.lit(start).cast("date"), F.lit(end).cast("date")


def business_day_count(start: str, end: str) -> int:
    first, last = Date.fromisoformat(start), Date.fromisoformat(end)
    days = (last - first).days + 1
    weeks, rest = divmod(days, 7)
    return weeks * 5 + sum((first + timedelta(i)).weekday() < 5 for i in range(rest))


def business_days(lo: Column | str, hi: Column | str) -> Column:
    """Array of the weekdays from ``lo`` to ``hi``, both included."""
    return F.filter(F.sequence(as_column(lo), as_column(hi)), lambda d: F.weekday(d) < 5)


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    lo, hi = check_bounds(start, end)
    return spark.range(1).select(F.explode(business_days(lo, hi)).alias("d"))


def calendar_reindex(series: DataFrame, start: str, end: str,
                     keys: Sequence[str] = ("market",), value: str = "price") -> DataFrame:
    """Every key on every business day, with its value or NULL: the fill without any filling,
    so no join of all keys with all days and no second pass over the series."""
    return fill_calendar(series, start, end, keys, value, interior=False, leading=False,
                         trailing=False).drop("is_filled")


def fill_calendar(series: DataFrame, start: str, end: str, keys: Sequence[str] = ("market",),
                  value: str = "price", interior: bool = True, leading: bool = True,
                  trailing: bool = True) -> DataFrame:
    """Put a clean sparse series on the business-day calendar and fill the gaps.

    * interior: straight line by calendar days between the known neighbours,
    * leading: the first known value, trailing: the last known value.

    Each known row already carries its next neighbour (one ``lead``), so it generates the days
    up to that neighbour itself: one shuffle and one sort of the sparse rows, no join with the
    calendar and no search for the neighbours of a gap.  Values on days outside the calendar
    take no part.
    """
    lo, hi = check_bounds(start, end)
    inside = F.col("d").between(lo, hi) & is_business_day("d")
    w = Window.partitionBy(*keys).orderBy("d")
    known = series.filter(inside & F.col(value).isNotNull()).select(
        *keys, F.col("d").alias("known_d"), F.col(value).alias("v"),
        F.lag("d").over(w).isNull().alias("first"),
        F.lead("d").over(w).alias("next_d"), F.lead(value).over(w).alias("next_v"))
    since = F.when(F.col("first"), lo).otherwise(F.col("known_d"))
    until = F.coalesce(F.date_sub("next_d", 1), hi)
    days = known.withColumn("d", F.explode(F.when(since <= until, business_days(since, until))))
    after = F.datediff("d", "known_d")
    line = F.col("v") + (F.col("next_v") - F.col("v")) * after / F.datediff("next_d", "known_d")
    filled = (F.when(after == 0, F.col("v"))
              .when(after < 0, F.col("v") if leading else None)
              .when(F.col("next_d").isNull(), F.col("v") if trailing else None)
              .otherwise(line if interior else None))
    return days.select(*keys, "d", filled.alias(value), (after != 0).alias("is_filled"))


def observed_in_range(series: DataFrame, start: str, end: str) -> DataFrame:
    """Observed days that are in the calendar, by semi join with it."""
    days = calendar(series.sparkSession, start, end)
    return series.join(F.broadcast(days), "d", "left_semi")  # at most MAX_CALENDAR_DAYS dates


def index_intersection(series: DataFrame, start: str, end: str) -> DataFrame:
    """The distinct dates that are both observed and in the calendar."""
    return series.select("d").intersect(calendar(series.sparkSession, start, end))


def coverage_stats(series: DataFrame, start: str, end: str,
                   keys: Sequence[str] = ("market",)) -> DataFrame:
    """First and last observed day, and how much of the calendar had to be filled.

    ``series`` is the clean sparse series, so the counts need no calendar rows.
    """
    lo, hi = check_bounds(start, end)
    total = F.lit(business_day_count(start, end)).cast("bigint")
    inside = F.col("d").between(lo, hi)
    return series.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("d"))).alias("earliest"),
        F.max(F.when(inside, F.col("d"))).alias("latest"),
        F.count(F.when(inside, 1)).alias("observed_bd"),
    ).select(*keys, "earliest", "latest", total.alias("total_bd"), "observed_bd",
             (total - F.col("observed_bd")).alias("filled_bd"),
             percent_filled(total - F.col("observed_bd"), total).alias("pct_filled"))
