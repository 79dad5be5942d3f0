"""Moving averages over centred row windows, and their stored form."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restwave.functions import nan_to_null
from restwave.operators.banded import WINDOW_BUDGET, Kernel, banded_means, gaussian_rows, simple_rows
from restwave.operators.smooth import to_long
from restwave.schemas import ROW_WIDTHS


def numbered(df: DataFrame, value: str, keys: Sequence[str], date: str) -> DataFrame:
    """Rows with their place in date order. Rows are numbered before nulls are set aside: an
    empty row still holds its place."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    return df.select(*keys, date, value, place.alias("_row"))


def _banded_rows(df: DataFrame, value: str, kernels: Sequence[Kernel], keys: Sequence[str],
                 date: str, how: str) -> DataFrame:
    means = banded_means(numbered(df, value, keys, date), keys, "_row", value, kernels, how, carry=[date])
    return means.select(*keys, date, "kernel", "bandwidth", "value")


def simple_row_means(df: DataFrame, value: str, widths: Sequence[int] = ROW_WIDTHS,
                     keys: Sequence[str] = ("user_id",), date: str = "date",
                     how: str = "auto") -> DataFrame:
    """Mean of the non-null cells in `width` rows centred on each row, in date order.

    Narrow widths share one window specification: one exchange and one sort. A sliding frame is
    summed anew for each row, so many wide ones are banded means instead. A window partition is
    one series, whose length the calendar bounds.
    """
    if how == "auto":
        how = "window" if sum(widths) <= WINDOW_BUDGET else "blocks"
    if how != "window":
        return _banded_rows(df, value, [simple_rows(w) for w in widths], keys, date, how)
    rows = Window.partitionBy(*keys).orderBy(date)
    y = nan_to_null(F.col(value).cast("double"))
    means = [F.avg(y).over(rows.rowsBetween(-(w // 2), (w - 1) // 2)).alias(f"_w{w}") for w in widths]
    cells = [F.struct(F.lit("simple").alias("kernel"), F.lit(w).alias("bandwidth"),
                      F.col(f"_w{w}").alias("value")) for w in widths]
    return df.select(*keys, date, *means).select(*keys, date, F.inline(F.array(*cells)))


def gaussian_row_means(df: DataFrame, value: str, widths: Sequence[int] = ROW_WIDTHS,
                       keys: Sequence[str] = ("user_id",), date: str = "date",
                       how: str = "auto") -> DataFrame:
    """As `simple_row_means` with gaussian weights (std = width / 2)."""
    return _banded_rows(df, value, [gaussian_rows(w) for w in widths], keys, date, how)


def row_means(df: DataFrame, value: str, widths: Sequence[int] = ROW_WIDTHS,
              keys: Sequence[str] = ("user_id",), date: str = "date") -> DataFrame:
    """Simple and gaussian row means together, in one pass."""
    kernels = [simple_rows(w) for w in widths] + [gaussian_rows(w) for w in widths]
    return _banded_rows(df, value, kernels, keys, date, "auto")


def source_version(df: DataFrame) -> str:
    """An order-free checksum of a frame's rows, as the identity of a stored result."""
    row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(
        F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return f"{row.n}-{row.s or 0}"


def stored_row_means(df: DataFrame, series: Sequence[str], uri: str,
                     widths: Sequence[int] = ROW_WIDTHS, keys: Sequence[str] = ("user_id",),
                     date: str = "date") -> DataFrame:
    """Row means of several columns, kept at `uri` and computed once per content and widths."""
    spark = df.sparkSession
    version = source_version(df.select(*keys, date, *series))
    request = hashlib.sha256(repr((tuple(widths), tuple(series), tuple(keys))).encode()).hexdigest()[:16]
    target = f"{uri.rstrip('/')}/{version}-{request}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        # Unpivoted first, all columns share one numbering and one exchange.
        long = to_long(df, series, keys, date)
        (row_means(long, "value", widths, (*keys, "series"), date)
         .select(*keys, date, "kernel", "bandwidth", "value", "series").write.mode("overwrite").parquet(target))
    return spark.read.parquet(target)
