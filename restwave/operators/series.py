"""Published dashboard series: which columns, on which axis, with which smooth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restwave.operators.smooth import align_to_dates, to_long, trim_bandwidths
from restwave.schemas import DEFAULT_SMOOTH, SERIES_VIEWS, SeriesView


def label_series(long: DataFrame, views: tuple[SeriesView, ...]) -> DataFrame:
    """Attach axis, axis label and legend to long rows; constants, so no join."""
    def pick(attribute: str):
        pairs = [x for v in views for x in (F.lit(v.series), F.lit(getattr(v, attribute)))]
        return F.create_map(*pairs)[F.col("series")].alias(attribute)

    return long.select("*", pick("axis"), pick("axis_label"), pick("legend"))


def series_mart(df: DataFrame, smoothed: DataFrame, views: tuple[SeriesView, ...],
                low: int = 1, high: int = 150) -> DataFrame:
    """Raw values of the viewed series, each with its smooths in the bandwidth range.

    `df` is a cleaned wide table, `smoothed` the long smooths of the same metric. A date without
    any smooth keeps one row with null smooth columns.
    """
    names = [v.series for v in views]
    raw = label_series(to_long(df, names), views)
    smooth = (trim_bandwidths(smoothed, low, high).where(F.col("series").isin(names))
              .select("user_id", "series", "date", "kernel", "bandwidth",
                      F.col("value").alias("smooth")))
    kernel, bandwidth = DEFAULT_SMOOTH
    default = (F.col("kernel") == F.lit(kernel)) & (F.col("bandwidth") == F.lit(bandwidth))
    return (align_to_dates(raw, smooth, ["user_id", "series", "date"])
            .withColumn("is_default", F.coalesce(default, F.lit(False))))


def metric_series(metric: str, df: DataFrame, smoothed: DataFrame, low: int = 1,
                  high: int = 150) -> DataFrame:
    """The mart of a named metric."""
    if metric not in SERIES_VIEWS:
        raise ValueError(f"unknown metric {metric!r}")
    if "metric" in smoothed.columns:
        smoothed = smoothed.where(F.col("metric") == F.lit(metric))
    return series_mart(df, smoothed, SERIES_VIEWS[metric], low, high)
