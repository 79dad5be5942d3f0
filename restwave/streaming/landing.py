"""The incremental loads as streams over the landing directory."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from restwave.operators.decode import quarantined
from restwave.plans.load import FIRST_DATE, load_daily, load_intraday
from restwave.schemas import DAILY_PAYLOADS, table
from restwave.sources.landing import stream_landed
from restwave.sources.tables import TableStore

#: Spark's setting of the tasks that list the files of a micro-batch; by default one for each file.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Bytes of memory for the files that were listed; a stream lists each once.
LISTED = "spark.sql.hive.filesourcePartitionFileCacheSize"
#: Files of a micro-batch for each task that lists or reads them, where that makes more tasks than two for each core.
FILES_OF_TASK = 128


def apply_batch(store: TableStore, batch: DataFrame, epoch: int, name: str, stream: str, run_date: dt.date,
                start: dt.date = FIRST_DATE, answers: DataFrame | None = None, defer: bool = False) -> int:
    """One micro-batch into both sinks: rows into the table, what can't be read into the quarantine.

    Each sink publishes the number of the micro-batch together with its rows and leaves out one it has already,
    so a batch that is repeated after a failure in either adds what is missing, once. Returns the number of
    inserted or changed rows (with `defer`, of the rows that are added for readers to merge).
    """
    t, mark = table(name), f"stream {stream}"
    if t.kind not in ("daily", "intraday"):
        raise ValueError(f"no loader for {name!r}")

    def rows() -> int:
        if store.marks(t.name).get(mark, -1) >= epoch:
            return 0
        if t.kind == "daily":
            return load_daily(store, batch, t.name, run_date, start, marks={mark: epoch}, defer=defer)
        return load_intraday(store, batch, t.name, run_date, start, answers, marks={mark: epoch}, defer=defer)

    def lost() -> None:
        if store.lost_marks().get(f"{mark} {t.name}", -1) < epoch:
            store.add_lost(t.name, quarantined(batch, t.name), {f"{mark} {t.name}": epoch})

    # Small batches leave most cores idle, so both sinks work at once; each ends, whatever the other does.
    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(inheritable_thread_target(store.spark)(lost))
        try:
            changed = rows()
        finally:
            wait([other])
        other.result()
    return changed


def load_available(store: TableStore, root: str, name: str, checkpoint: str, run_date: dt.date,
                   start: dt.date = FIRST_DATE, answers: DataFrame | None = None,
                   files_per_trigger: int = 10_000) -> StreamingQuery:
    """Load everything that has landed since the last call, then stop.

    Every micro-batch goes through `apply_batch` under the name of its checkpoint. The upsert repeats without
    effect besides, so any cut into micro-batches leaves the same table.
    """
    t, session = table(name), store.spark.newSession()
    for key, value in store.spark.conf.getAll.items():
        if session.conf.get(key, None) != value:
            session.conf.set(key, value)
    # The source lists a micro-batch by the settings of the session that it was made in, as long as the stream runs.
    wide = max(2 * session.sparkContext.defaultParallelism, -(-files_per_trigger // FILES_OF_TASK))
    tasks = min(int(session.conf.get("spark.sql.shuffle.partitions")), wide)
    session.conf.set(LISTING, tasks)
    session.conf.set(LISTED, 0)
    if t.name not in DAILY_PAYLOADS or not DAILY_PAYLOADS[t.name].weigh_ins:  # those also meet the stored days of all users
        session.conf.set("spark.sql.shuffle.partitions", tasks)

    listed = []

    def write(batch: DataFrame, epoch: int) -> None:
        if not listed:
            # The source has just listed all files at once; without this the driver's heap stays as large as that made it.
            listed.append(epoch)
            store.spark._jvm.System.gc()
        # Both sinks read the batch. Its many small files are read once, by few tasks.
        held = batch.coalesce(tasks).persist()
        try:
            # They are read while the sinks are still being planned; a failure shows in the sinks.
            with ThreadPoolExecutor(1) as pool:
                pool.submit(inheritable_thread_target(store.spark)(held.count))
                apply_batch(store, held, epoch, t.name, checkpoint, run_date, start, answers, True)
        finally:
            held.unpersist()

    return (stream_landed(session, root, t.name, files_per_trigger).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
