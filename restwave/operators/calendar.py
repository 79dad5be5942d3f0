"""Daily calendars: means per day, gap filling, date ranges and request chunks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restwave.functions import nan_to_null

ONE_DAY = "interval 1 day"


def check_range(start: dt.date, end: dt.date) -> None:
    if start > end:
        raise ValueError(f"start date {start} is after end date {end}")


def daily_mean(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("user_id",),
               date: str = "date") -> DataFrame:
    """Mean of all measurements of a day, missing ones skipped.

    The averages combine on the map side, so a user with very many readings costs one row per
    day and task in the shuffle.
    """
    return (df.where(F.col(date).isNotNull())
            .groupBy(*keys, date)
            .agg(*[F.avg(nan_to_null(F.col(v).cast("double"))).alias(v) for v in values]))


def fill_calendar(df: DataFrame, keys: Sequence[str] = ("user_id",), date: str = "date") -> DataFrame:
    """One row per day between a series' first and last date; added days are null.

    Each row is stretched to the day before its successor. The input holds one row per day and
    key, so a window partition is bounded by the length of the calendar.
    """
    values = [c for c in df.columns if c not in (*keys, date)]
    following = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    last = F.greatest(F.col(date), F.date_sub(F.coalesce(following, F.date_add(date, 1)), 1))
    spread = df.withColumn("_last", last).select(
        *keys, F.col(date).alias("_first"), *values,
        F.explode(F.sequence(F.col(date), F.col("_last"), F.expr(ONE_DAY))).alias("_day"))
    own = F.col("_day") == F.col("_first")
    return spread.select(*keys, F.col("_day").alias(date),
                         *[F.when(own, F.col(v)).alias(v) for v in values])


def date_calendar(owners: DataFrame, start: dt.date, end: dt.date, date: str = "date") -> DataFrame:
    """Every owner row with every date of an inclusive range."""
    check_range(start, end)
    return owners.select("*", F.explode(
        F.sequence(F.lit(start), F.lit(end), F.expr(ONE_DAY))).alias(date))


def distinct_dates(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    return df.select(*keys, date).distinct().orderBy(*keys, date)


def range_chunks(df: DataFrame, start: Column | str, end: Column | str, days: int) -> DataFrame:
    """Split each row's inclusive date range into consecutive chunks of at most `days` days."""
    if days < 1:
        raise ValueError("a chunk needs at least one day")
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    begins = F.explode(F.sequence(start, end, F.expr(f"interval {days} days")))
    return (df.withColumn("_end", end)
            .select("*", begins.alias("chunk_start"))
            .withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("_end")))
            .drop("_end"))
