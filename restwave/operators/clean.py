"""Cleaning of the six daily tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restwave.functions import clock_hours, nan_to_null, seconds_to_hours, zero_to_null

# Columns treated by each rule.
BOOKKEEPING = ("id", "date_pulled")
ZERO_IS_MISSING = ("body_fat", "bmi", "fat_mass")
SLEEP_DURATIONS = ("total_sleep_time", "rem_time", "deep_time", "light_time", "awake_time")
STRESS_DURATIONS = ("high_stress_duration", "low_stress_duration", "rest_stress_duration")
SLEEP_COLUMNS = ("date", "resting_hr", "sleep_score", "total_sleep_time", "rem_time", "deep_time",
                 "light_time", "awake_time", "sleep_start_time", "sleep_end_time", "hrv_7d_average")


def drop_bookkeeping(df: DataFrame, columns: Sequence[str] = BOOKKEEPING) -> DataFrame:
    """Drop stored-row bookkeeping; a missing column is an error rather than a silent no-op."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*columns).withColumn("date", F.to_date("date"))


def nulls_for_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: zero_to_null(c) for c in columns})


def hours_for_seconds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: seconds_to_hours(c) for c in columns})


def sleep_clock(df: DataFrame, start_ms: str = "local_sleep_start_time",
                end_ms: str = "local_sleep_time_end", date: str = "date") -> DataFrame:
    """Bed and wake time in hours; bed time counts from midnight of the evening before."""
    return df.withColumns({"sleep_start_time": clock_hours(start_ms, date, shift_days=1),
                           "sleep_end_time": clock_hours(end_ms, date)})


def clean_health_stats(df: DataFrame) -> DataFrame:
    return nulls_for_zero(drop_bookkeeping(df), ZERO_IS_MISSING)


def clean_sleep(df: DataFrame) -> DataFrame:
    slept = sleep_clock(hours_for_seconds(drop_bookkeeping(df), SLEEP_DURATIONS))
    owner = ["user_id"] if "user_id" in df.columns else []
    return slept.select(*owner, *SLEEP_COLUMNS)


def clean_stress(df: DataFrame) -> DataFrame:
    return hours_for_seconds(drop_bookkeeping(df), STRESS_DURATIONS)


CLEANERS = {
    "health_stats": clean_health_stats,
    "sleep": clean_sleep,
    "steps": drop_bookkeeping,
    "stress": clean_stress,
    "heart_rate": drop_bookkeeping,
    "body_battery": drop_bookkeeping,
}


def clean_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean the six tables; all six must be given."""
    missing = [name for name in CLEANERS if name not in tables]
    if missing:
        raise ValueError(f"tables not found: {missing}")
    return {name: clean(tables[name]) for name, clean in CLEANERS.items()}


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """Read-side rule: a NaN in any double column is a missing value."""
    doubles = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[nan_to_null(c).alias(c) if c in doubles else F.col(c) for c in df.columns])
