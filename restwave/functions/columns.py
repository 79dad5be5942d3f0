"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
POUNDS_PER_GRAM = 0.00220462
SECONDS_PER_HOUR = 3600.0
BENCH_EXERCISE = "BENCH_PRESS"
BENCH_LIMIT = 66
RM_INTERCEPT = 1.0278
RM_SLOPE = 0.0278

_MS_PER_DAY = 86_400_000
_US_PER_DAY = 86_400_000_000
_FIRST_MS, _LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN is a missing value here, but Spark aggregates would propagate it."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(0.0))


def seconds_to_hours(c: Column | str) -> Column:
    return _col(c) / F.lit(SECONDS_PER_HOUR)


def grams_to_pounds(c: Column | str) -> Column:
    return _col(c) * F.lit(POUNDS_PER_GRAM)


def clock_hours(epoch_ms: Column | str, date: Column | str, shift_days: int = 0) -> Column:
    """Hours from midnight of `date` to a wall-clock epoch, plus whole days.

    The epoch already encodes local wall-clock time, so this is date arithmetic; a time-zone
    conversion would be wrong.
    """
    midnight = F.unix_date(_col(date)).cast("bigint") * F.lit(_MS_PER_DAY)
    return (_col(epoch_ms) - midnight) / F.lit(3_600_000.0) + F.lit(24.0 * shift_days)


def epoch_ms_to_utc(c: Column | str) -> Column:
    """Null outside the years 1 to 9999, NaN and infinity included."""
    ms = _col(c).try_cast("bigint")
    return F.when(ms.between(_FIRST_MS, _LAST_MS), F.timestamp_millis(ms))


def text_to_utc(c: Column | str) -> Column:
    """Timestamp text, with an offset or `Z` or else read as UTC (the session zone, see
    `session.use_utc`); unreadable text becomes null."""
    return F.try_to_timestamp(_col(c))


def end_of_day(date: Column | str) -> Column:
    """The last microsecond of a date, as a UTC instant."""
    days = F.unix_date(_col(date)).cast("bigint") + F.lit(1)
    return F.timestamp_micros(days * F.lit(_US_PER_DAY) - F.lit(1))


def month_of(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def corrected_weight(exercise: Column | str, weight: Column | str) -> Column:
    """Light bench presses are logged per arm: count both."""
    exercise, weight = _col(exercise), _col(weight)
    per_arm = (exercise == F.lit(BENCH_EXERCISE)) & (weight < F.lit(BENCH_LIMIT))
    return F.when(per_arm, weight * F.lit(2.0)).otherwise(weight)


def one_rep_max(weight: Column | str, reps: Column | str) -> Column:
    return F.try_divide(_col(weight), F.lit(RM_INTERCEPT) - F.lit(RM_SLOPE) * _col(reps))
