"""Load status of days: what is done, what is missing, what to store for empty days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restwave.functions import end_of_day

# Fixed values.
FETCHED = "fetched"
NO_DATA = "no_data"
DENIED = "denied"
UNKNOWN = "unknown"
# Our own: a reload was asked for and its result has not landed.
RELOAD = "reload"
PENDING = "pending"

TERMINAL = (FETCHED, NO_DATA)
DAY = ("user_id", "query_date")


def high_water(stored: DataFrame, keys: Sequence[str] = ("user_id",), date: str = "date") -> DataFrame:
    """Latest stored date per key, the inclusive restart point of the next load."""
    return stored.groupBy(*keys).agg(F.max(date).alias("last_date"))


def terminal_dates(status: DataFrame, keys: Sequence[str] = DAY,
                   column: str = "pull_status") -> DataFrame:
    """Days that need no further load, one row each whatever the number of stored rows."""
    done = F.bool_or(F.coalesce(F.col(column).isin(*TERMINAL), F.lit(False)))
    return status.groupBy(*keys).agg(done.alias("_done")).where("_done").drop("_done")


def dates_to_load(calendar: DataFrame, status: DataFrame, keys: Sequence[str] = DAY,
                  column: str = "pull_status") -> DataFrame:
    return calendar.join(terminal_dates(status, keys, column), list(keys), "left_anti")


def all_zero_days(df: DataFrame, value: str, keys: Sequence[str] = DAY) -> DataFrame:
    """Whether every value of a day is zero; a missing value is not."""
    zero = F.coalesce(F.col(value) == F.lit(0), F.lit(False))
    return df.groupBy(*keys).agg(F.bool_and(zero).alias("all_zero"))


def _day_outcome() -> Column:
    """Of the statuses of a day: fetched, denied, no_data in that order, else null."""
    has = lambda s: F.bool_or(F.col("status") == s)
    return F.when(has(FETCHED), FETCHED).when(has(DENIED), DENIED).when(has(NO_DATA), NO_DATA)


def with_status(rows: DataFrame, status: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Status of each row's day: fetched, denied, no_data in that order, else unknown."""
    found = status.groupBy(*keys).agg(_day_outcome().alias("pull_status"))
    return (rows.join(found, list(keys), "left")
            .withColumn("pull_status", F.coalesce("pull_status", F.lit(UNKNOWN))))


def empty_dates(status: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Distinct days with no data or a denied answer."""
    return status.where(F.col("status").isin(NO_DATA, DENIED)).select(*keys).distinct()


def with_placeholders(data: DataFrame, status: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Add an end-of-day row with null measures for each empty day that has no data rows."""
    empty = status.groupBy(*keys).agg(_day_outcome().alias("pull_status"), F.bool_or(
        F.col("status").isin(NO_DATA, DENIED)).alias("_empty")).where("_empty").drop("_empty")
    missing = empty.join(data.select(*keys).distinct(), list(keys), "left_anti")
    stubs = missing.withColumn("date_time_utc", end_of_day("query_date"))
    return data.unionByName(stubs, allowMissingColumns=True)


def status_tally(status: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Count and sorted dates per status and `by`; a list is bounded by one user's calendar."""
    return status.groupBy(*by, "status").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("query_date")).alias("dates"))
