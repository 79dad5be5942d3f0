"""Stored smooths that recompute only what a change can reach."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.functions import nan_to_null
from restwave.operators.banded import Kernel, banded_means
from restwave.operators.smooth import SERIES_KEYS
from restwave.session import use_utc
from restwave.sources.snapshots import Manifest, Snapshots, new_commit

PARTITION = "part"
ROWS, UNITS = "rows", "units"
#: Units of a list up to which Spark may send it to all executors; files of repeated keys look far smaller than they are.
BROADCAST_UNITS = 100_000


class SmoothStore:
    """Smooths of long series under `root`, kept in units of (series, block of `step` days).

    Each unit has a checksum of its source rows. `refresh` compares the checksums with those of a new
    state of the source and recomputes the units within a kernel's reach of one that has changed; new,
    changed and removed days are all changes. Kernels count days, so row windows fit where the calendar has
    no gaps. A gaussian that reaches all days makes every change reach its whole series, but no other one.

    Rows and checksums of a block of days lie in partitions of one versioned set and are published together:
    readers see the state before or after a refresh, and of two that touch the same blocks one fails.
    The number of blocks is bounded by the calendar.
    """

    def __init__(self, spark: SparkSession, root: str, kernels: Sequence[Kernel], keys: Sequence[str] = SERIES_KEYS,
                 date: str = "date", value: str = "value", step: int = 128):
        if not kernels or step < 1:
            raise ValueError("a smooth store needs kernels and blocks of at least one day")
        self.spark = use_utc(spark)
        self.kernels, self.keys, self.date, self.value, self.step = list(kernels), list(keys), date, value, step
        self.lo, self.hi = min(k.lo for k in kernels), max(k.hi for k in kernels)
        self.files = Snapshots(spark, root, PARTITION)

    # --- layout ---

    def _key_fields(self, df: DataFrame) -> list[T.StructField]:
        return [df.schema[k] for k in self.keys]

    def _row_schema(self, fields: Sequence[T.StructField]) -> T.StructType:
        return T.StructType([*fields, T.StructField(self.date, T.DateType()), T.StructField("kernel", T.StringType()),
                             T.StructField("bandwidth", T.IntegerType()), T.StructField("value", T.DoubleType()),
                             T.StructField("_block", T.LongType())])

    def _unit_schema(self, fields: Sequence[T.StructField]) -> T.StructType:
        return T.StructType([*fields, T.StructField("_block", T.LongType()), T.StructField("_sum", T.LongType())])

    @staticmethod
    def _values(manifest: Manifest, kind: str, blocks: Iterable[int] | None = None) -> list[str]:
        if blocks is None:
            return [v for v in manifest.parts if v.startswith(f"{kind}_")]
        return [f"{kind}_{b}" for b in blocks]

    def read(self, key_types: str = "user_id string, metric string, series string", version: int | None = None) -> DataFrame:
        """keys, date, kernel, bandwidth, value of all units; `key_types` is the DDL of the keys."""
        manifest = self.files.manifest(version) or Manifest(0)
        schema = self._row_schema(T.StructType.fromDDL(key_types).fields)
        return self.files.read(schema, manifest, self._values(manifest, ROWS)).drop("_block")

    # --- units ---

    def _blocks(self, first: Column, last: Column) -> Column:
        """The blocks that a range of days touches."""
        return F.explode(F.sequence(F.floor(first / F.lit(self.step)), F.floor(last / F.lit(self.step))))

    def _same(self, df: DataFrame, other: DataFrame) -> list[Column]:
        return [df[k].eqNullSafe(other[f"_o_{k}"]) for k in self.keys] + [df["_block"] == other["_o__block"]]

    @staticmethod
    def _listed(units: DataFrame, count: int) -> DataFrame:
        """A list of about `count` units as a side of a join: a long one is sorted and merged, not gathered on the driver."""
        return units if count <= BROADCAST_UNITS else units.hint("merge")

    @staticmethod
    def _renamed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(f"_o_{c}") for c in df.columns])

    def _units(self, source: DataFrame) -> DataFrame:
        """A checksum for each unit of the source, free of order, combined before the exchange."""
        request = repr((self.kernels, self.step))
        h = F.xxhash64(F.lit(request), "_day", "_y").cast("decimal(38,0)")
        return source.groupBy(*self.keys, "_block").agg(F.xxhash64(F.sum(h), F.count(F.lit(1))).alias("_sum"))

    def _stale(self, units: DataFrame, before: DataFrame) -> DataFrame:
        """keys, _block and `_gone` of the units to recompute or (if gone) to remove."""
        old = self._renamed(before)
        both = units.join(old, self._same(units, old), "full").where(~units["_sum"].eqNullSafe(old["_o__sum"]))
        changed = both.select(*[F.coalesce(k, f"_o_{k}").alias(k) for k in self.keys], F.coalesce("_block", "_o__block").alias("_block"),
                              units["_sum"].isNull().alias("_gone"))
        start, end = F.col("_block") * self.step, (F.col("_block") + 1) * self.step - 1
        reached = changed.select(*self.keys, self._blocks(start - self.hi, end - self.lo).alias("_block")).distinct()
        here = self._renamed(units.select(*self.keys, "_block")).hint("merge")
        # What a change reaches and still has source rows, and what has none any more.
        return (reached.join(here, self._same(reached, here), "left_semi").withColumn("_gone", F.lit(False))
                .unionByName(changed.where("_gone")))

    def refresh(self, df: DataFrame) -> int:
        """Bring the store to the state of `df` (keys, date, value); returns the number of units touched.

        `df` is the whole source. Null keys are keys, NaN is null, several readings of a day count one by one;
        rows without a date are left out. An unchanged source writes nothing.
        """
        fields, commit = self._key_fields(df), new_commit()
        self.files.create()
        base = self.files.manifest()
        day = F.unix_date(self.date)
        source = df.where(F.col(self.date).isNotNull()).select(
            *self.keys, day.alias("_day"), nan_to_null(F.col(self.value).cast("double")).alias("_y"),
            F.floor(day / F.lit(self.step)).alias("_block"))
        units = self._units(source)
        before = self.files.read(self._unit_schema(fields), base, self._values(base, UNITS))
        # Written once, as every later step starts from it; it is as long as the list of stale units.
        staging = f"{self.files.root}/_staging/{commit}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(staging)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._stale(units, before).write.parquet(staging)
        try:
            schema = T.StructType([*fields, T.StructField("_block", T.LongType()), T.StructField("_gone", T.BooleanType())])
            stale = self.spark.read.schema(schema).parquet(staging)
            touched = {r[0]: r[1] for r in stale.groupBy("_block").count().collect()}
            if not touched:
                return 0
            self._write(source, units, stale, base, commit, fields, touched)
            values = self._values(base, ROWS, touched) + self._values(base, UNITS, touched)
            self.files.publish(base, commit, values, "refresh", sum(touched.values()))
            return sum(touched.values())
        finally:
            fs.delete(path, True)

    def _write(self, source: DataFrame, units: DataFrame, stale: DataFrame, base: Manifest, commit: str,
               fields: Sequence[T.StructField], touched: Mapping[int, int]) -> None:
        """The touched blocks (with their numbers of stale units) as they are now: kept units as stored, stale ones
        computed with their halos."""
        blocks, count = sorted(touched), sum(touched.values())
        start, end = F.col("_block") * self.step, (F.col("_block") + 1) * self.step - 1
        live = stale.where(~F.col("_gone"))
        halo = live.select(*self.keys, F.col("_block").alias("_home"), self._blocks(start + self.lo, end + self.hi).alias("_block"))
        reach = (self.hi - self.lo) // self.step + 2
        needed = self._listed(self._renamed(halo.groupBy(*self.keys, "_block").agg(F.max(F.col("_home") == F.col("_block")).alias("_mine"))), count * reach)
        taken = source.join(needed, self._same(source, needed)).select(*self.keys, "_day", "_y", F.col("_o__mine").alias("_mine"))
        means = banded_means(taken, self.keys, "_day", "_y", self.kernels, carry=["_mine"]).where("_mine")
        fresh = means.select(*self.keys, F.date_from_unix_date("_day").alias(self.date), "kernel", "bandwidth",
                             "value", F.floor(F.col("_day") / F.lit(self.step)).alias("_block"))
        stored = self.files.read(self._row_schema(fields), base, self._values(base, ROWS, blocks))
        other = self._listed(self._renamed(stale.select(*self.keys, "_block")), count)
        rows = stored.join(other, self._same(stored, other), "left_anti").unionByName(fresh)
        part = F.col("_block").cast("string")
        self.files.write(rows.withColumn(PARTITION, F.concat(F.lit(f"{ROWS}_"), part)).hint("rebalance", PARTITION), commit)
        now = units.where(F.col("_block").isin(blocks)).select(*self.keys, "_block", "_sum")
        self.files.write(now.withColumn(PARTITION, F.concat(F.lit(f"{UNITS}_"), part)).hint("rebalance", PARTITION), commit)
