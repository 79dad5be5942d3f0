"""Helpers shared by the corpus operators: words of Arrow text columns, durable results, row structs."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
IS_WORD_BYTE = np.ones(256, bool)
IS_WORD_BYTE[list(SPACE.encode())] = False
#: Bytes that a word hash works on at a time.
PIECE = 1 << 19
#: A row without an id counts as later than every row that has one.
NO_ID = 2**63 - 1


def checkpoint_dir(spark) -> str:
    """The shared folder the session names; a temporary one only where none is set and the session is local (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_shipped: set[str] = set()


def ship_package(spark) -> None:
    """Gives the executors this package, once for each application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(package):
            target = os.path.join(tempfile.mkdtemp(prefix="package-"), "restwave.zip")
            with zipfile.ZipFile(target, "w") as out:
                for folder, _, names in os.walk(package):
                    for name in sorted(n for n in names if n.endswith(".py")):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
            context.addPyFile(target)
        _shipped.add(context.applicationId)


def durable(df: DataFrame) -> DataFrame:
    """Computes df now and cuts its lineage; the rows lie in the shared folder, so a lost executor loses none."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a `durable` frame that nothing reads any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark) -> None:
    """Settings for jobs whose steps are all written or `durable`, one after the other in one session.

    The shuffle files of a finished action go at once (what is left of a step lies in the shared folder, so a lost
    executor is no matter), and Python workers get texts in small batches, as they keep the memory of their largest.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


#: Rows of keys that are sent to all executors at most; with a few longs each, tens of MB.
BROADCAST_ROWS = 250_000


def if_small(keys: DataFrame) -> DataFrame:
    """keys (durable, a few longs a row), marked for a broadcast if their number is within BROADCAST_ROWS.

    So a join with few keys doesn't move texts; with more it sorts and merges as usual.
    """
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def named(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def row_struct(df: DataFrame, keep: list[str] | None = None) -> Column:
    """The columns `keep` (all, if None) as one struct, so that an operator's own names can't clash with them."""
    chosen = df.columns if keep is None else keep
    return F.struct(*[named(df, c) for c in chosen]) if chosen else F.struct(F.lit(0).alias("_"))


def with_outputs(df: DataFrame, row: str, outputs: list[str]) -> DataFrame:
    """The columns of the struct `row` and, in place of those of the same name (in any case), the outputs."""
    fields, taken = df.schema[row].dataType.names, {o.lower() for o in outputs}
    kept = [F.col(row).getField(f).alias(f) for f in fields if f.lower() not in taken]
    return df.select(*kept, *outputs)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, all rows in one array, and the n + 1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def word_runs(bytes_: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and its row."""
    n = len(bytes_)
    word = IS_WORD_BYTE[bytes_]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the whole output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHash:
    """Rolling hashes modulo 2**64 of words and of runs of words, for whole batches at once.

    A byte counts as a random odd 64-bit value, so that texts can't be built to collide; `lane` gives
    independent functions.
    """

    def __init__(self, lane: int):
        rng = np.random.default_rng([20240131, lane])
        self.table, self.base, self.step = (
            rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for size in (256, 1, 1))
        self.inverse = np.array([pow(int(self.base[0]), -1, 2**64)], np.uint64)

    def words(self, bytes_: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word. Works on about PIECE bytes at a time, as it needs several long arrays of them."""
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE)))
            first, past = int(starts[lo]), int(ends[hi - 1])
            n = past - first
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(self.base, n)]))
            unpower = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(self.inverse, n)]))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.table[bytes_[first:past]] * powers[:n], out=sums[1:])
            at = starts[lo:hi] - first
            out[lo:hi] = mix((sums[ends[lo:hi] - first] - sums[at]) * unpower[at])
            lo = hi
        return out

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """A hash of each k consecutive words."""
        out = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            out += words[j:len(words) - k + 1 + j]
            out *= self.step
        return mix(out)

    def runs_at(self, words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """The same for the runs that begin at the given words."""
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out += words[at + j]
            out *= self.step
        return mix(out)
