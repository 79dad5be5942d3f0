"""Frames as parquet or CSV under one base URI (local, s3a, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv")
#: Rows of one file of a sorted export at most.
ROWS_PER_FILE = 5_000_000


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    return fmt


def base_uri(environment: str = "local", local_dir: str | None = None, bucket: str | None = None,
             prefix: str = "") -> str:
    """Base URI of a local folder or of an object-store bucket with a key prefix."""
    if environment == "local":
        if not local_dir:
            raise ValueError("a local store needs a folder")
        return local_dir if ":" in local_dir else f"file:{local_dir}"
    if not bucket:
        raise ValueError("an object store needs a bucket")
    return f"s3a://{bucket}/{prefix}".rstrip("/")


class FrameStore:
    """Reads and writes frames by relative name; a write replaces its target."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    def uri(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (),
              order_by: tuple[str, ...] = ()) -> None:
        """Write a frame, on request in a total order (a range exchange)."""
        check_format(fmt)
        if order_by:
            df = df.orderBy(*order_by)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if fmt == "csv":
            writer.option("header", True).csv(self.uri(name))
        else:
            writer.parquet(self.uri(name))

    def read(self, name: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
        check_format(fmt)
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        if fmt == "parquet":
            return reader.parquet(self.uri(name))
        # Inference costs a second pass over the text, so it is the fallback.
        return reader.option("header", True).option("inferSchema", schema is None).csv(self.uri(name))

    def write_each(self, frames: dict[str, DataFrame], folder: str) -> None:
        for name, df in frames.items():
            self.write(df, f"{folder}/{name}.parquet")

    def write_sorted(self, df: DataFrame, name: str, keys: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> None:
        """Write parquet files that follow each other in one total order (ascending, nulls first), and their manifest.

        Rows are range partitioned by sampled bounds, so file order is sort order. The manifest `<name>.manifest`
        has of each file its number, rows, the place of its first row and the least and greatest keys. It names the
        files of this write, so one that a failed write left behind fails to read rather than mislead.
        """
        if not keys:
            raise ValueError("a sorted export needs keys")
        df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).write.mode("overwrite").option(
            "maxRecordsPerFile", rows_per_file).parquet(self.uri(name))
        key = F.struct(*[F.col(k) for k in keys])
        files = self.read(name, schema=df.schema).groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
        # numbers, not names: names of more than 99,999 parts don't sort
        part, piece = (F.regexp_extract("file_name", p, 1).cast("int") for p in (r"^part-(\d+)", r"-c(\d+)[^-]*$"))
        order = Window.orderBy(part, piece)  # one row for each file
        manifest = files.withColumn("file", F.row_number().over(order) - 1).withColumn(
            "first_row", F.sum("rows").over(order) - F.col("rows"))
        self.write(manifest.select("file", "file_name", "first_row", "rows", "low", "high"), f"{name}.manifest")

    def manifest(self, name: str) -> DataFrame:
        """The files of a sorted export, in order by `file`."""
        return self.read(f"{name}.manifest")

    def read_sorted(self, name: str, low=None, high=None) -> DataFrame:
        """A sorted export with each row's `file` and `row` (its place in the whole order, from 0).

        low and high bound the first key, both included; only files whose keys reach into the bounds are opened,
        and rows whose first key is null are left out. A stored column named file or row raises.
        """
        whole = self.read(name)
        if {"file", "row"} & {c.lower() for c in whole.columns}:
            raise ValueError("a stored column has the name of a place")
        manifest = self.manifest(name)
        first = manifest.schema["low"].dataType.names[0]
        inside = F.lit(True)
        if low is not None:
            manifest = manifest.where(F.col("high")[first] >= F.lit(low))
            inside &= F.col(first) >= F.lit(low)
        if high is not None:
            # files that begin with nulls may go on with small keys
            manifest = manifest.where(F.coalesce(F.col("low")[first] <= F.lit(high), F.lit(True)))
            inside &= F.col(first) <= F.lit(high)
        names = [r[0] for r in manifest.select("file_name").collect()]  # one name for each file in the bounds
        rows = self.spark.read.schema(whole.schema).parquet(*[self.uri(f"{name}/{n}") for n in names]) if names else whole.where(F.lit(False))
        placed = rows.where(inside).select(*[F.col("`" + c.replace("`", "``") + "`") for c in whole.columns],
                                           F.col("_metadata.file_name").alias("_file_name"), F.col("_metadata.row_index").alias("_index"))
        found = manifest.select(F.col("file_name").alias("_file_name"), "file", "first_row")
        return placed.join(found, "_file_name").withColumn("row", F.col("first_row") + F.col("_index")).select(
            *[F.col("`" + c.replace("`", "``") + "`") for c in whole.columns], "file", "row")
