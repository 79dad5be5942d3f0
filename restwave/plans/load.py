"""Incremental loads of landed responses into the stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from restwave.functions import month_of
from restwave.operators.calendar import check_range
from restwave.operators.decode import daily_batch, decode_daily, decode_intraday, intraday_batch, quarantined
from restwave.operators.status import DAY, dates_to_load, high_water
from restwave.schemas import DAILY_PAYLOADS, UPDATE_ORDER, metric_table, table
from restwave.sources.landing import BodyStore
from restwave.sources.tables import TableStore

# First date ever loaded; days of a request, by table and for all others.
FIRST_DATE = dt.date(2015, 1, 1)
REQUEST_DAYS = {"health_stats": 1000, None: 28}

Hook = Callable[[DataFrame], DataFrame]


def _range(landed: DataFrame, date: str, run_date: dt.date, start: dt.date, end: dt.date | None,
           dates: Collection[dt.date] | None) -> DataFrame:
    """Rows of the inclusive range up to `end` or the run date, or only of `dates` within it."""
    last = run_date if end is None else end
    check_range(start, last)
    inside = F.col(date).between(F.lit(start), F.lit(last))
    return landed.where(inside & F.col(date).isin(list(dates)) if dates is not None else inside)


def load_daily(store: TableStore, landed: DataFrame, name: str, run_date: dt.date,
               start: dt.date = FIRST_DATE, hook: Hook | None = None, end: dt.date | None = None,
               dates: Collection[dt.date] | None = None, marks: Mapping[str, int] | None = None, defer: bool = False) -> int:
    """Upsert the landed entries of the range; returns the number of inserted or changed rows.

    A stored row keeps the version it came from and only gives way to a greater one, so any cut
    of the same responses into loads, in any order, leaves the same table. `hook` is an optional
    DataFrame transformation of the batch. `defer` as in `TableStore.upsert`; a hook's batch is
    never deferred.
    """
    name = metric_table(name, "daily").name
    rows = _range(decode_daily(landed, name), "date", run_date, start, end, dates)
    batch = daily_batch(rows, name, keep_version=True)
    if DAILY_PAYLOADS[name].weigh_ins:
        batch = _bridged(batch, store.df(name))
    if hook:
        batch = batch.transform(hook)
    return store.upsert(name, batch.withColumn("date_pulled", F.lit(run_date)), marks, defer and not hook)


def _bridged(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The batch and the empty days between it and what is stored of its users."""
    span = lambda df, a, b: df.groupBy("user_id").agg(F.min("date").alias(a), F.max("date").alias(b))
    spans = span(batch, "lo", "hi").join(span(stored, "first", "last"), "user_id")
    gap = F.when(F.col("lo") > F.date_add("last", 1), F.sequence(F.date_add("last", 1), F.date_sub("lo", 1))).when(
        F.col("hi") < F.date_sub("first", 1), F.sequence(F.date_add("hi", 1), F.date_sub("first", 1)))
    days = spans.select("user_id", F.explode(gap).alias("date")).withColumn("_rank", F.lit(0))
    return batch.unionByName(days, allowMissingColumns=True)


def load_intraday(store: TableStore, landed: DataFrame, name: str, run_date: dt.date,
                  start: dt.date = FIRST_DATE, answers: DataFrame | None = None,
                  hook: Hook | None = None, end: dt.date | None = None,
                  dates: Collection[dt.date] | None = None, marks: Mapping[str, int] | None = None, defer: bool = False) -> int:
    """Upsert the landed days of the range; returns the number of inserted or changed rows.

    As with `load_daily` the stored versions decide, and a day has one outcome (`intraday_batch`).
    """
    name = metric_table(name, "intraday").name
    due = _range(landed, "query_date", run_date, start, end, dates)
    batch = intraday_batch(decode_intraday(due, name, answers)).withColumn("date_pulled", F.lit(run_date))
    if hook:
        batch = batch.transform(hook)
    return store.upsert(name, batch, marks, defer and not hook)


def newest_batch(store: TableStore, name: str) -> int | None:
    """The greatest ingest ordinal stored of a table: a caller whose batches land in order may
    read on from it (`read_landed(first_batch=...)`)."""
    return store.versions(name).agg(F.max("_batch")).first()[0]


ARRIVAL = "arrival"


def unsettled(store: TableStore, due: DataFrame, name: str) -> DataFrame:
    """The bodies of days that need a load: the table has neither data nor a no-data answer for them.

    Decided on keys alone: the days of the bodies without those that the table has settled, from the months in
    question. Bodies meet only the days that are left, so none is parsed or moved to find out.
    """
    days = due.select(*DAY).distinct()
    months = [r[0] for r in days.select(month_of("query_date")).distinct().collect()]  # bounded by the calendar
    return due.join(dates_to_load(days, store.day_outcomes(name, months)), list(DAY), "left_semi")


def ahead(store: TableStore, due: DataFrame, name: str) -> DataFrame:
    """The bodies of ranges that reach a user's last stored date, or beyond it; all bodies of new users.

    A body's range begins at its requested date and has the length of a request, so what lies wholly before
    the restart point is left out by its key.
    """
    last = high_water(store.df(name).select("user_id", "date"))
    reach = F.date_add("query_date", REQUEST_DAYS.get(name, REQUEST_DAYS[None]) - 1)
    kept = due.select("user_id", "query_date").distinct().join(last, "user_id", "left").where(F.col("last_date").isNull() | (reach >= F.col("last_date")))
    return due.join(kept.select("user_id", "query_date"), ["user_id", "query_date"], "left_semi")


def load_new(store: TableStore, bodies: BodyStore, name: str, run_date: dt.date, start: dt.date = FIRST_DATE,
             answers: DataFrame | None = None, hook: Hook | None = None, restart: bool = False, keep_lost: bool = True) -> int:
    """Load what has arrived since the last call; returns the number of inserted or changed rows.

    The last applied arrival is published in the same version of the table as its rows, so an arrival is applied
    once, whatever fails in between, and arrivals up to it are not opened again. Batches that arrive late are
    applied by their version. Of an intraday table only days without an outcome are loaded; of a daily one, with
    `restart`, only ranges that reach the user's last stored date. What can't be read goes to `store.lost`, once
    as well, unless `keep_lost` is off.
    """
    t = table(name)
    if t.kind not in ("daily", "intraday"):
        raise ValueError(f"no loader for {name!r}")
    after, newest, changed = store.marks(t.name).get(ARRIVAL, 0), bodies.newest(t.name), 0
    if newest > after:
        due, marks = bodies.scan(t.name, after, newest), {ARRIVAL: newest}
        if t.kind == "daily":
            changed = load_daily(store, ahead(store, due, t.name) if restart else due, t.name, run_date, start, hook, marks=marks)
        else:
            changed = load_intraday(store, unsettled(store, due, t.name), t.name, run_date, start, answers, hook, marks=marks)
    lost = f"{ARRIVAL} {t.name}"
    if keep_lost and newest > store.lost_marks().get(lost, 0):
        store.add_lost(t.name, quarantined(bodies.scan(t.name, store.lost_marks().get(lost, 0), newest), t.name), {lost: newest})
    return changed


def update_new(store: TableStore, bodies: BodyStore, run_date: dt.date, start: dt.date = FIRST_DATE,
               answers: DataFrame | None = None, hooks: Mapping[str, Hook] | None = None) -> dict[str, int]:
    """`load_new` for the ten time-series tables in order; table name to upserted rows."""
    hooks = hooks or {}
    return {table(m).name: load_new(store, bodies, m, run_date, start, answers, hooks.get(table(m).name)) for m in UPDATE_ORDER}


def quarantine(store: TableStore, landed: DataFrame, name: str, uri: str) -> int:
    """Write what decoding leaves out of the given responses to `uri`; returns the number of rows."""
    lost = Observation()
    rows = quarantined(landed, table(name).name).withColumn("metric", F.lit(table(name).name))
    rows.observe(lost, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(uri)
    return lost.get["n"]


def update(store: TableStore, landed: Callable[[str], DataFrame], name: str, run_date: dt.date,
           start: dt.date = FIRST_DATE, answers: DataFrame | None = None,
           hook: Hook | None = None) -> int:
    """Load one table, given by table or model name, from `landed(table name)`."""
    t = table(name)
    if t.kind == "daily":
        return load_daily(store, landed(t.name), t.name, run_date, start, hook)
    if t.kind == "intraday":
        return load_intraday(store, landed(t.name), t.name, run_date, start, answers, hook)
    raise ValueError(f"no loader for {name!r}")


def update_all(store: TableStore, landed: Callable[[str], DataFrame], run_date: dt.date,
               start: dt.date = FIRST_DATE, answers: DataFrame | None = None,
               hooks: Mapping[str, Hook] | None = None) -> dict[str, int]:
    """Load the ten time-series tables in order; table name to upserted rows."""
    hooks = hooks or {}
    return {table(m).name: update(store, landed, m, run_date, start, answers, hooks.get(table(m).name))
            for m in UPDATE_ORDER}
