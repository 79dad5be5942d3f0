"""Landed JSON responses, one file per response.

Layout: `<root>/metric=<table>/batch=<ordinal>/<user>_<yyyy-mm-dd>.json`. The date is the
requested day (intraday) or the first day of the requested range (daily). Replies to reload
requests land under `metric=reload`. Rows are the columns of LANDED; a frame with the same
columns from any other store serves just as well; `BodyStore` compacts files to one.
"""

from __future__ import annotations

import contextlib
import os
import sys
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.session import use_utc
from restwave.sources.snapshots import ConcurrentWrite, Snapshots, new_commit
from restwave.sources.tables import observed

# The task-side helper travels with its job: executors need pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANDED = "user_id string, metric string, query_date date, batch bigint, body string"
REPLIES = "reload"
_NAME = r"metric=([^/]+)/batch=(\d+)/([^/]+)_(\d{4}-\d{2}-\d{2})\.json\z"


def from_paths(files: DataFrame, file: bool = False, path: str | None = None) -> DataFrame:
    """File text plus path metadata (or a column of plain paths) to LANDED rows, on request with the file's name; other files are left out."""
    at = F.col(path or "_metadata.file_path")
    part = lambda i: F.regexp_extract(at, _NAME, i)
    decoded = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # The paths of the metadata are encoded; besides, `land` writes a user's reserved characters in that form.
    name = part(3) if path else decoded(part(3))
    return files.where(at.rlike(_NAME)).select(
        F.coalesce(decoded(name), name).alias("user_id"),
        part(1).alias("metric"),
        F.to_date(part(4)).alias("query_date"), part(2).cast("bigint").alias("batch"),
        F.col("value").alias("body"), *([F.col("_metadata.file_name").alias("file")] if file else []))


def read_landed(spark: SparkSession, root: str, metric: str, first_batch: int | None = None) -> DataFrame:
    """Landed responses of one metric; only its own directory is listed. None yet is no rows.

    In a folder that all executors share, a task lists the files when the rows are asked for and tasks read them. In any
    other store Spark's reader does; its list of all files lies in the driver's memory.
    """
    uri = f"{root.rstrip('/')}/metric={metric}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], LANDED)
    if fs.getUri().getScheme() == "file":
        names = spark.range(1, numPartitions=1).mapInArrow(_paths_under(path.toUri().getPath()), "path string")
        dealt = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
        texts = dealt.mapInArrow(_texts, "path string, value binary").withColumn("value", F.col("value").cast("string"))
        landed = from_paths(texts, path="path")
    else:
        landed = from_paths(spark.read.text(uri, wholetext=True, recursiveFileLookup=True))
    return landed if first_batch is None else landed.where(F.col("batch") >= first_batch)


#: Files and bytes of a batch of rows that a task reads.
_FILES, _BYTES = 1_000, 4 << 20


def _paths_under(root: str):
    """The task-side helper that gives the paths of all files under a folder that Spark's reader would open."""
    shown = lambda n: not (n.startswith(".") or n.startswith("_") and "=" not in n or n.endswith("._COPYING_"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        for folder, inner, names in os.walk(root, followlinks=True, onerror=_raised):
            inner[:] = filter(shown, inner)
            paths = [os.path.join(folder, n) for n in names if shown(n)]
            for i in range(0, len(paths), 10 * _FILES):
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths[i:i + 10 * _FILES], pa.string())})

    return run


def _raised(error: OSError) -> None:
    raise error


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task-side helper that reads whole files; empty ones give no rows, as with Spark's reader."""
    rows = lambda found: pa.RecordBatch.from_pydict({
        "path": pa.array([p for p, _ in found], pa.string()), "value": pa.array([b for _, b in found], pa.binary())})
    for batch in batches:
        found, size = [], 0
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                body = f.read()
            if body:
                found.append((path, body))
                size += len(body)
            if size > _BYTES or len(found) == _FILES:
                yield rows(found)
                found, size = [], 0
        yield rows(found)


def stream_landed(spark: SparkSession, root: str, metric: str, files_per_trigger: int = 10_000) -> DataFrame:
    """As `read_landed`, as a stream of newly landed files."""
    files = (spark.readStream.format("text").option("wholetext", True)
             .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
             .load(f"{root.rstrip('/')}/metric={metric}"))
    return from_paths(files)


def reload_answers(landed: DataFrame) -> DataFrame:
    """(user_id, query_date, batch, status) of landed reload replies."""
    return landed.select("user_id", "query_date", "batch",
                         F.from_json("body", "struct<status: string>")["status"].alias("status"))


class BodyStore:
    """Landed responses compacted to bodies: a few large files for each arrival instead of one for each response.

    An arrival is what one compaction or append found new; its number is the version that published it and the
    partition of its rows. Which files were seen is read from the key columns of the bodies themselves. Older
    batches that land late are a new arrival like any other, so a reader that remembers the last arrival it
    has applied misses nothing and reads nothing twice.
    """

    SCHEMA = f"{LANDED}, file string, arrival bigint"

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = use_utc(spark), base.rstrip("/")

    def snapshots(self, metric: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.base}/metric={metric}", "arrival")

    def newest(self, metric: str) -> int:
        """The number of the last arrival; 0 before the first."""
        manifest = self.snapshots(metric).manifest()
        return manifest.version if manifest else 0

    def scan(self, metric: str, after: int = 0, until: int | None = None) -> DataFrame:
        """Bodies with the columns of LANDED, file and arrival; arrivals outside the range are never opened."""
        arrival = F.col("arrival")
        bodies = self.snapshots(metric).read(T.StructType.fromDDL(self.SCHEMA), self.snapshots(metric).manifest()).where(arrival > after)
        return bodies if until is None else bodies.where(arrival <= until)

    def append(self, metric: str, landed: DataFrame, marks: dict[str, int] | None = None) -> int:
        """Adds LANDED rows, and file where they have it, as one arrival; returns their number."""
        snapshots, commit, seen = self.snapshots(metric), new_commit(), Observation()
        snapshots.create()
        base = snapshots.manifest()
        file = F.col("file") if "file" in landed.columns else F.lit(None).cast("string").alias("file")
        rows = landed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(LANDED)], file, F.lit(base.version + 1).cast("bigint").alias("arrival"))
        # Rows of a day lie together, so that the footers' statistics exclude most files for a range of days.
        snapshots.write(rows.observe(seen, F.count(F.lit(1)).alias("n")).hint("rebalance").sortWithinPartitions("query_date", "user_id"), commit)
        count = observed(seen).get("n", 0)
        if count or marks:
            value = str(base.version + 1)
            if snapshots.publish(base, commit, [value], "insert", count, marks=marks).version != base.version + 1:
                raise ConcurrentWrite(f"another arrival of {metric} came first")
        return count

    def compact(self, root: str, metric: str, recheck: bool = False) -> int:
        """Takes up the files that have landed under `root` since the last time; returns their number.

        The metric's batch directories are listed, and only those changed since they were last read are opened (all,
        with `recheck` or where the store keeps no times of directories). A file counts once by batch and name.
        """
        snapshots = self.snapshots(metric)
        manifest = snapshots.manifest()
        before = manifest.marks if manifest else {}
        due = {b: (uri, at) for b, uri, at in batch_directories(self.spark, root, metric)
               if recheck or not at or before.get(f"{SEEN}{b}") != at}
        if not due:
            return 0
        files = from_paths(self.spark.read.text([uri for uri, _ in due.values()], wholetext=True), file=True)
        seen = snapshots.read(T.StructType.fromDDL(self.SCHEMA), manifest).where(F.col("batch").isin(sorted(due))).select("batch", "file")
        return self.append(metric, files.join(seen, ["batch", "file"], "left_anti"), {f"{SEEN}{b}": at for b, (_, at) in due.items()})


SEEN = "seen batch "
#: A directory changed less than this before it was listed may change again within its clock's granularity.
SETTLED_MS = 2_000


def batch_directories(spark: SparkSession, root: str, metric: str) -> list[tuple[int, str, int]]:
    """(batch, uri, time of the last change, 0 if unknown or too recent) of a metric's batch directories."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/metric={metric}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    now, out = int(time.time() * 1000), []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("batch=") and name[6:].isdigit():
            changed = status.getModificationTime()
            out.append((int(name[6:]), status.getPath().toString(), changed if changed < now - SETTLED_MS else 0))
    return sorted(out)


def land(landed: DataFrame, root: str) -> int:
    """Writes LANDED rows as landed files, one for each (metric, batch, user, date), each of which may have one row.

    Into a folder that all executors share, the tasks write the files themselves. In any other store Spark's writer
    does, to a draft whose files the driver then moves one by one: as many calls of the store as there are files.
    """
    spark, keys = landed.sparkSession, ["metric", "batch", "user_id", "query_date"]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, base = path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path(root)
    if fs.getUri().getScheme() == "file":
        parts = landed.select(*[F.col(k).cast("string") for k in keys], F.col("body").cast("string")).repartition(*keys).sortWithinPartitions(*keys)
        return parts.mapInArrow(_files_in(base.toUri().getPath()), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    draft = path(base, f"_landing-{uuid.uuid4().hex}")
    landed.select(*keys, "body").repartition(*keys).write.partitionBy(*keys).text(draft.toString())
    found, n = fs.listFiles(draft, True), 0
    while found.hasNext():
        source = found.next().getPath()
        place = dict(p.split("=", 1) for p in source.toString().split("/") if "=" in p)
        if source.getName().startswith("part-"):
            folder = path(base, f"metric={place['metric']}/batch={place['batch']}")
            fs.mkdirs(folder)
            n += fs.rename(source, path(folder, f"{place['user_id']}_{place['query_date']}.json"))
    fs.delete(draft, True)
    return n


def _files_in(root: str):
    """The task-side helper over rows sorted by their file; gives the number of files of each batch of rows.

    Names are those of Spark's partition directories. A file appears whole, by a rename, and a repeated task
    replaces it. The rows of the last file of a batch wait for the next one.
    """
    escaped = {ord(c): f"%{ord(c):02X}" for c in (*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^")}
    name = lambda v: v.translate(escaped) if v else "__HIVE_DEFAULT_PARTITION__"

    def write(place: tuple, bodies: list[str | None]) -> None:
        metric, batch, user, date = map(name, place)
        folder = os.path.join(root, f"metric={metric}", f"batch={batch}")
        os.makedirs(folder, exist_ok=True)
        draft = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(draft, "wb") as out:
            out.writelines((b or "").encode() + b"\n" for b in bodies)
        with contextlib.suppress(FileNotFoundError):  # the checksum of a file that is replaced
            os.remove(os.path.join(folder, f".{user}_{date}.json.crc"))
        os.replace(draft, os.path.join(folder, f"{user}_{date}.json"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bodies = None, []
        for batch in batches:
            n = 0
            for *here, body in zip(*[c.to_pylist() for c in batch.columns]):
                if bodies and here != place:
                    write(place, bodies)
                    n, bodies = n + 1, []
                place = here
                bodies.append(body)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
        if bodies:
            write(place, bodies)
            yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    return run
