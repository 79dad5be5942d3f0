"""Kernel smoothing by date distance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restwave.functions import nan_to_null, parse_smooth_name, smooth_name
from restwave.operators.banded import REACH, WINDOW_BUDGET, Kernel, banded_columns, banded_means, boxcar_distance, gaussian_distance
from restwave.schemas import BANDWIDTHS, KERNELS, SMOOTHED_COLUMNS

SERIES_KEYS = ("user_id", "metric", "series")
ALIASES = {"simple": "boxcar"}


def kernel_names(kernels: Sequence[str]) -> list[str]:
    names = [ALIASES.get(k, k) for k in kernels]
    for n in names:
        if n not in KERNELS:
            raise ValueError(f"unknown kernel {n!r}")
    return list(dict.fromkeys(names))


def date_kernels(kernels: Sequence[str] = KERNELS, bandwidths: Sequence[int] = BANDWIDTHS,
                 reach: float = REACH) -> list[Kernel]:
    """Kernels over day distances, by name and then by bandwidth."""
    return [gaussian_distance(b, reach) if k == "gaussian" else boxcar_distance(b)
            for k in kernel_names(kernels) for b in bandwidths]


def boxcar_means(df: DataFrame, bandwidths: Sequence[int], keys: Sequence[str] = SERIES_KEYS,
                 date: str = "date", value: str = "value") -> DataFrame:
    """Plain mean of the values at most half a bandwidth of days away."""
    days = Window.partitionBy(*keys).orderBy("_day")
    y = nan_to_null(F.col(value).cast("double"))
    means = [F.avg(y).over(days.rangeBetween(-(b // 2), b // 2)).alias(f"_b{b}") for b in bandwidths]
    cells = [F.struct(F.lit("boxcar").alias("kernel"), F.lit(b).alias("bandwidth"),
                      F.col(f"_b{b}").alias("value")) for b in bandwidths]
    return (df.withColumn("_day", F.unix_date(date)).select(*keys, date, *means)
            .select(*keys, date, F.inline(F.array(*cells))))


def kernel_smooth(df: DataFrame, kernels: Sequence[str] = KERNELS,
                  bandwidths: Sequence[int] = BANDWIDTHS, keys: Sequence[str] = SERIES_KEYS,
                  date: str = "date", value: str = "value", reach: float = REACH,
                  how: str = "auto") -> DataFrame:
    """Smoothed values at every date of every series, long form.

    gaussian: weights exp(-d^2 / 2 bw^2) over distances up to `reach` bandwidths, by default all
    whose weight is not zero. boxcar: equal weights over distances up to bw / 2. Every input row
    gives a row for each kernel and bandwidth; readings of one date count one by one.
    """
    names = kernel_names(kernels)
    gaussian = [gaussian_distance(b, reach) for b in bandwidths] if "gaussian" in names else []
    boxcar = [boxcar_distance(b) for b in bandwidths] if "boxcar" in names else []
    narrow = sum(k.hi - k.lo + 1 for k in boxcar) <= WINDOW_BUDGET
    # Boxcars join a block pass that runs anyway; narrow ones alone are ordinary range windows.
    windowed = boxcar and (how == "pairs" or (how == "auto" and narrow and not gaussian))
    banded = gaussian if windowed else gaussian + boxcar
    if how == "auto" and boxcar:
        how = "blocks"
    parts = []
    if banded:
        dated = df.select(*keys, F.unix_date(date).alias("_day"), value)
        parts.append(banded_means(dated, keys, "_day", value, banded, how)
                     .withColumn(date, F.date_from_unix_date("_day"))
                     .select(*keys, date, "kernel", "bandwidth", "value"))
    if windowed:
        parts.append(boxcar_means(df, bandwidths, keys, date, value))
    return reduce(DataFrame.unionByName, parts)


def to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("user_id",),
            date: str = "date") -> DataFrame:
    """One row per (keys, date, series); unpivoted before smoothing so the plan stays narrow."""
    cells = [F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*keys, date, F.inline(F.array(*cells)))


def long_series(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All declared series of all given tables as one long frame; other tables are skipped."""
    parts = [to_long(df, SMOOTHED_COLUMNS[name]).withColumn("metric", F.lit(name))
             for name, df in tables.items() if name in SMOOTHED_COLUMNS]
    if not parts:
        raise ValueError("none of the tables has smoothed columns")
    return reduce(DataFrame.unionByName, parts).select("user_id", "metric", "series", "date", "value")


def smooth_all(tables: Mapping[str, DataFrame], kernels: Sequence[str] = KERNELS,
               bandwidths: Sequence[int] = BANDWIDTHS) -> DataFrame:
    """Smooth every declared series of every table in a single pass."""
    return kernel_smooth(long_series(tables), kernels, bandwidths)


def align_to_dates(spine: DataFrame, smoothed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep every source date, with its smoothed values where there are any."""
    return spine.join(smoothed, list(on), "left")


def wide(smoothed: DataFrame, columns: Sequence[str], kernels: Sequence[str] = KERNELS,
         bandwidths: Sequence[int] = BANDWIDTHS, keys: Sequence[str] = ("user_id",),
         date: str = "date") -> DataFrame:
    """Wide export of one metric: a column per (series, kernel, bandwidth).

    Partitioned by row key first, both steps of the pivot stay local: otherwise each name of a
    row could reach the second step as a wide row of its own.
    """
    names = [smooth_name(c, k, b) for c in columns for k in kernel_names(kernels) for b in bandwidths]
    name = F.concat_ws("_", "series", "kernel", F.col("bandwidth").cast("string"))
    return (smoothed.select(*keys, date, name.alias("_name"), "value").repartition(*keys, date)
            .groupBy(*keys, date).pivot("_name", names).agg(F.first("value")))


def smooth_wide(df: DataFrame, columns: Sequence[str], kernels: Sequence[str] = KERNELS,
                bandwidths: Sequence[int] = BANDWIDTHS, keys: Sequence[str] = ("user_id",),
                date: str = "date", reach: float = REACH) -> DataFrame:
    """Wide export of a wide table: a column per (series, kernel, bandwidth), a row per input row.

    The same values as `wide` of `kernel_smooth`, without the long rows and the pivot between them.
    """
    dated = df.select(*keys, F.unix_date(date).alias("_day"), *columns)
    out = banded_columns(dated, keys, "_day", columns, date_kernels(kernels, bandwidths, reach), smooth_name)
    return out.select(*keys, F.date_from_unix_date("_day").alias(date), *out.columns[len(keys) + 1:])


def trim_bandwidths(smoothed: DataFrame, low: int, high: int) -> DataFrame:
    """Keep bandwidths within an inclusive range, long form."""
    return smoothed.where(F.col("bandwidth").between(low, high))


def trim_wide(df: DataFrame, low: int, high: int, keys: Sequence[str] = ("user_id",),
              date: str = "date") -> DataFrame:
    """As `trim_bandwidths` for a wide export."""
    kept = [c for c in df.columns if c not in (*keys, date) and low <= parse_smooth_name(c)[2] <= high]
    return df.select(*keys, date, *kept)
