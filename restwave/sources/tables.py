"""Stored tables: versioned, partitioned parquet directories with explicit schemas.

A table is partitioned by a value derived from its key (month of the date or instant; hash
bucket of the activity), so an upsert reads and rewrites only the partitions its batch touches
and still finds every stored row of an incoming key. Writes are published as a whole (see
`snapshots`): a frame that was read before a write keeps its rows, and of two writers that
change the same partitions the later one raises `ConcurrentWrite`. A deferred upsert only adds its
rows beside the stored ones; readers merge them by key, and so does, for good, the next upsert or `merge`.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.functions import end_of_day
from restwave.operators.clean import nulls_for_nan
from restwave.operators.quality import require_keys
from restwave.operators.upsert import CHANGED, VERSION, last_write, upsert
from restwave.schemas import PART, TABLES, Table, table
from restwave.session import use_utc
from restwave.sources.snapshots import COMMIT, ConcurrentWrite, Manifest, Snapshots, delta_number, new_commit, new_delta

REMOVE = "is_marker"
#: Deferred upserts of a partition after which they are merged.
DEFERRED = 64
LOST = "user_id string, query_date date, batch bigint, place int, reason string, metric string"


def observed(metrics: Observation) -> dict[str, Any]:
    """The metrics of a finished write; none if adaptive planning dropped an input that turned out empty."""
    try:
        return metrics.get
    except Py4JJavaError:
        return {}


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, lower: Any, upper: Any,
              partitions: int, **options: str) -> DataFrame:
    """A table of an external database, read in parallel ranges of `column`."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=column, lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(partitions), **options)
    return reader.load()


class TableStore:
    def __init__(self, spark: SparkSession, base: str, namespace: str = "wearable"):
        self.spark = use_utc(spark)
        self.base = f"{base.rstrip('/')}/{namespace}"

    def uri(self, name: str) -> str:
        return f"{self.base}/{table(name).name}"

    def _fs_path(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def snapshots(self, name: str) -> Snapshots:
        return Snapshots(self.spark, self.uri(name), PART)

    def exists(self, name: str) -> bool:
        fs, path = self._fs_path(self.uri(name))
        return fs.exists(path)

    def create_all(self) -> None:
        """Create the tables that do not exist yet."""
        for name in TABLES:
            self.create(name)

    def create(self, name: str) -> None:
        self.snapshots(name).create()

    def _manifest(self, name: str, version: int | None = None) -> Manifest:
        manifest = self.snapshots(name).manifest(version)
        if manifest is None:
            raise ValueError(f"{table(name).name} was not created")
        return manifest

    def version(self, name: str) -> int:
        """The number of the newest version; every write makes one."""
        return self._manifest(name).version

    def marks(self, name: str) -> dict[str, int]:
        """Positions that loads have published together with their rows."""
        return self._manifest(name).marks

    def history(self, name: str) -> list[Manifest]:
        """The manifests of all versions that are kept."""
        return [self._manifest(name, v) for v in self.snapshots(name).versions()]

    def expire(self, name: str, keep: int = 2, grace_seconds: float = 86_400.0) -> int:
        return self.snapshots(name).expire(keep, grace_seconds)

    def _stored(self, name: str, manifest: Manifest | None = None, parts: list[str] | None = None) -> DataFrame:
        t, snapshots, manifest = table(name), self.snapshots(name), manifest or self._manifest(name)
        waiting = [v for v in manifest.deltas if parts is None or v in parts]
        if not waiting:
            return snapshots.read(t.stored_schema, manifest, parts)
        # As if one upsert after the other had been merged: the greatest version of a key counts, of equal ones the first.
        keys, place = (*t.keys, PART), "_place"
        deltas = snapshots.read_deltas(t.stored_schema, manifest, waiting).drop("id").withColumn(place, -delta_number(F.col(COMMIT))).drop(COMMIT)
        newest = last_write(deltas, keys, (*VERSION, place), keep=VERSION)
        others = [v for v in manifest.parts if v not in waiting and (parts is None or v in parts)]
        merged = upsert(snapshots.read(t.stored_schema, manifest, waiting), newest, keys, order=VERSION)
        return merged.unionByName(snapshots.read(t.stored_schema, manifest, others)) if others else merged

    def df(self, name: str, version: int | None = None) -> DataFrame:
        """Lazy scan of a table, of the newest or a given version. NaN was made null when the rows were written."""
        shown = F.col("_hidden").isNull() | ~F.col("_hidden")
        return self._stored(name, self._manifest(name, version)).where(shown).select(*table(name).schema.names)

    records = df

    def versions(self, name: str) -> DataFrame:
        """Keys and versions of all stored rows, hidden ones included."""
        return self._stored(name).select(*table(name).keys, *VERSION, "_hidden")

    def day_outcomes(self, name: str, months: list[str]) -> DataFrame:
        """user_id, query_date, pull_status of the intraday days with an outcome in the given months.

        Every such day has one row at its last microsecond, so this reads no data rows of a day to decide.
        """
        return (self._stored(name, parts=months).where(F.col("date_time_utc") == end_of_day("query_date"))
                .select("user_id", "query_date", "pull_status"))

    def drop(self, name: str) -> bool:
        fs, path = self._fs_path(self.uri(name))
        return fs.delete(path, True)

    def add_records(self, name: str, rows: DataFrame) -> int:
        """Append new rows. Raises if they break a key constraint, within or against the table."""
        t = table(name)
        types = dict(self.spark.createDataFrame([], t.schema).dtypes)
        full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
                             for c, kind in types.items()])
        if t.kind == "activity":
            full = full.withColumn("detailsPulled", F.coalesce("detailsPulled", F.lit(False)))
        surrogate = t.keys if t.unique else [c for c in full.columns if c != "id"]
        full = full.withColumn("id", F.coalesce("id", F.xxhash64(*surrogate)))
        full = self._with_version(nulls_for_nan(full)).withColumn(PART, t.part())
        snapshots, base, commit = self.snapshots(name), self._manifest(name), new_commit()
        # Written once, then checked where it lies; what breaks a constraint is never published.
        seen = Observation()
        counted = full.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(PART).alias("parts"), F.count_if(F.col(PART).isNull()).alias("lost"))
        snapshots.write(counted.hint("rebalance", PART), commit)
        found = observed(seen)
        parts, count = found.get("parts", []), found.get("n", 0)
        try:
            staged = snapshots.read_commit(t.stored_schema, commit, parts)
            if found.get("lost"):
                raise ValueError(f"null in required columns {list(t.not_null)}")
            require_keys(staged, t.keys, t.not_null, t.unique)
            if t.unique:
                clash = staged.join(self._stored(name, base, parts).select(*t.keys), list(t.keys), "left_semi")
                if not clash.isEmpty():
                    raise ValueError(f"key already stored in {t.name}")
            snapshots.publish(base, commit, parts, "insert" if t.unique else "append", count, replace=False)
        except Exception:
            snapshots.discard(commit, [*parts, "__HIVE_DEFAULT_PARTITION__"])
            raise
        return count

    # --- what loads could not read ---

    def _lost(self) -> Snapshots:
        return Snapshots(self.spark, f"{self.base}/_lost", "metric")

    def lost(self, name: str | None = None) -> DataFrame:
        """Places of landed responses that loads and streams could not read, with reasons, of one or all tables."""
        names = None if name is None else [table(name).name]
        return self._lost().read(T.StructType.fromDDL(LOST), self._lost().manifest(), names)

    def lost_marks(self) -> dict[str, int]:
        manifest = self._lost().manifest()
        return manifest.marks if manifest else {}

    def add_lost(self, name: str, rows: DataFrame, marks: Mapping[str, int]) -> int:
        """Adds rows of `decode.quarantined`, published together with the marks; returns their number."""
        snapshots, commit, seen = self._lost(), new_commit(), Observation()
        snapshots.create()
        base = snapshots.manifest()
        snapshots.write(rows.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("metric", F.lit(table(name).name)), commit)
        count = observed(seen).get("n", 0)
        snapshots.publish(base, commit, [table(name).name], "append", count, replace=False, marks=marks)
        return count

    @staticmethod
    def _with_version(rows: DataFrame) -> DataFrame:
        kinds = {"_asked": "date", "_batch": "bigint", "_hidden": "boolean"}
        absent = [c for c in (*VERSION, "_hidden") if c not in rows.columns]
        return rows.withColumns({c: F.lit(None).cast(kinds.get(c, "int")) for c in absent})

    def add_record(self, name: str, values: Mapping[str, Any]) -> int:
        return self.add_records(name, self._one_row(name, values))

    def update_record(self, name: str, key: Mapping[str, Any], values: Mapping[str, Any]) -> int:
        """Insert or update one row by its key, setting only the given columns."""
        return self.upsert(name, self._one_row(name, {**key, **values}))

    def _one_row(self, name: str, values: Mapping[str, Any]) -> DataFrame:
        schema = table(name).schema
        unknown = [c for c in values if c not in schema.names]
        if unknown:
            raise ValueError(f"columns not in {name}: {unknown}")
        return self.spark.createDataFrame([tuple(values.values())],
                                          type(schema)([schema[c] for c in values]))

    @staticmethod
    def _parts(staged: DataFrame) -> list[str]:
        """The partitions of a batch: at most its months, or the fixed number of hash buckets."""
        return [r[0] for r in staged.select(PART).distinct().collect()]

    def upsert(self, name: str, batch: DataFrame, marks: Mapping[str, int] | None = None, defer: bool = False) -> int:
        """Insert or overwrite by key; returns the number of rows that this inserts or changes.

        Rows with the VERSION columns only overwrite what has no greater version. Rows without
        them always overwrite. A true `_hidden` column stores a row that readers don't see and
        that isn't counted; a true `is_marker` column removes a stored row instead of writing one.
        The merged partitions and `marks` become visible together, as one version.

        With `defer`, whole rows with the VERSION columns are stored as they are, for readers to merge, so many small
        batches don't rewrite a large month each time. The batch must hold each key once; returns its number of rows.
        """
        t = table(name)
        if not t.unique:
            raise ValueError(f"{t.name} has no unique key")
        snapshots, base, commit = self.snapshots(name), self._manifest(name), new_commit()
        marked, versioned = REMOVE in batch.columns, VERSION[0] in batch.columns
        batch = self._with_version(nulls_for_nan(batch)).withColumn(PART, t.part())
        if defer and versioned and {*batch.columns, "id"} == {*t.stored_schema.names}:
            return self._add_delta(t, base, batch, marks)
        # The batch is kept once, as its plan would otherwise run for each use.
        seen, staging = Observation(), f"{self.base}/_staging/{commit}"
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(staging)
        fs, path = self._fs_path(staging)
        try:
            staged, count = self.spark.read.schema(batch.schema).parquet(staging), observed(seen).get("n", 0)
            if count == 0:
                if marks:
                    snapshots.publish(base, commit, [], "mark", marks=marks)
                return 0
            require_keys(staged.drop(PART), t.keys, t.keys)
            parts = self._parts(staged)
            stored = self._stored(name, base, parts)
            if marked:
                stored = stored.withColumn(REMOVE, F.lit(False))
            merged = upsert(stored, staged, (*t.keys, PART), order=VERSION if versioned else (), changed=True)
            if marked:
                merged = merged.where(~F.col(REMOVE)).drop(REMOVE)
            written = Observation()
            shown = F.col(CHANGED) & ~F.coalesce("_hidden", F.lit(False))
            # Rebalancing splits a hot partition over several files and joins small ones.
            snapshots.write(merged.observe(written, F.count_if(shown).alias("n"), F.count(F.lit(1)).alias("rows")).drop(CHANGED).hint("rebalance", PART), commit)
            done = observed(written)
            snapshots.publish(base, commit, parts, "upsert", done.get("rows", 0), marks=marks)
        finally:
            fs.delete(path, True)
        return count if marked else done.get("n", 0)

    def _add_delta(self, t: Table, base: Manifest, batch: DataFrame, marks: Mapping[str, int] | None) -> int:
        snapshots, commit, seen = self.snapshots(t.name), new_delta(base), Observation()
        rows = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in t.stored_schema if f.name != "id"])
        null = reduce(Column.__or__, [F.col(k).isNull() for k in (*t.keys, PART)])
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(PART).alias("parts"), F.count_if(null).alias("lost"))
        snapshots.write(counted, commit)  # laid out as it comes: a merge will move the rows anyway
        found = observed(seen)
        parts, count = found.get("parts", []), found.get("n", 0)
        if found.get("lost"):
            snapshots.discard(commit, [*parts, "__HIVE_DEFAULT_PARTITION__"])
            raise ValueError(f"null in required columns {list(t.keys)}")
        if count or marks:
            new = snapshots.publish(base, commit, parts, "defer" if count else "mark", count, marks=marks, delta=True)
            due = [v for v in parts if len(new.deltas.get(v, [])) >= DEFERRED]
            if due:
                self.merge(t.name, due)
        return count

    def merge(self, name: str, parts: list[str] | None = None) -> list[str]:
        """Merges what deferred upserts have added to some or all partitions; returns the partitions rewritten.

        Readers see the same rows before and after. If another writer changes one of them meanwhile, they stay as they are.
        """
        snapshots, base, commit, seen = self.snapshots(name), self._manifest(name), new_commit(), Observation()
        due = [v for v in base.deltas if parts is None or v in parts]
        if not due:
            return []
        rows = self._stored(name, base, due).observe(seen, F.count(F.lit(1)).alias("n"))
        snapshots.write(rows.hint("rebalance", PART), commit)
        try:
            snapshots.publish(base, commit, due, "merge", observed(seen).get("n", 0))
        except ConcurrentWrite:
            snapshots.discard(commit, due)
            return []
        return due
