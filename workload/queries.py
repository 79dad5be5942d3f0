"""The registered queries: each operator over the provided tables.

The tables are a star schema, so they stand in for wearable data: `events` for readings of a user
over time, `lineitem` for logged sets and measures, `orders` for stored and incoming rows.
Every query reads whole tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restwave.functions import grams_to_pounds, seconds_to_hours, smooth_name, zero_to_null
from restwave.operators import activities, calendar, clean, decode, quality, series, smooth, status, windows, workout
from restwave.operators.banded import band_join
from restwave.operators.upsert import last_write, upsert
from restwave.schemas import BANDWIDTHS, DAILY_PAYLOADS, INTRADAY_PAYLOADS, KERNELS, SERIES_VIEWS, SMOOTHED_COLUMNS, FlatPayload
from restwave.plans import load as loads
from restwave.plans import publish
from restwave.plans.smooths import SmoothStore
from restwave.session import scratch_uri, use_utc
from restwave.sources.files import FrameStore
from restwave.sources.landing import BodyStore, land, read_landed
from restwave.sources.tables import TableStore
from restwave.streaming.landing import apply_batch, load_available

Query = Callable[[SparkSession, str], DataFrame]

FEW = (1, 7, 14)
RUN_DATE = dt.date(2024, 1, 31)
STORED_UNTIL, INCOMING_FROM = "1999-06-30", "1999-01-01"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
# Events per built response body: event ids are unique, so a body holds at most this many.
BODY_SPAN = 4096


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to fixed places and instants to zone-free form, for comparison.

    The nudge, far below the last place, keeps exact decimal ties from hinging on the last bit
    of a sum; the SQL side has the same.
    """
    kinds = dict(df.dtypes)

    def show(c: str):
        if kinds[c] == "double":
            return F.round(F.col(c) + F.lit(3.31237 * 10.0 ** -(places + 3)), places).alias(c)
        if kinds[c] == "timestamp":
            return F.col(c).cast("timestamp_ntz").alias(c)
        return F.col(c)

    return df.select(*[show(c) for c in df.columns])


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").withColumn("date", F.to_date("ts"))


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean per user, on a gap-free calendar."""
    return calendar.fill_calendar(calendar.daily_mean(readings(spark, sf), ["value"]))


def _span(spark: SparkSession, sf: str) -> tuple[dt.date, dt.date]:
    """First and last day of the readings."""
    return tuple(readings(spark, sf).agg(F.min("date"), F.max("date")).first())


def type_days(spark: SparkSession, sf: str) -> DataFrame:
    """A long multi-series frame: daily mean per user and event type."""
    days = calendar.daily_mean(readings(spark, sf), ["value"], keys=("user_id", "event_type"))
    return days.select("user_id", F.lit("events").alias("metric"), F.col("event_type").alias("series"),
                       "date", "value")


def one_series(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.lit("events").alias("metric"), F.lit("value").alias("series"),
                     "date", "value")


# --- calendars -------------------------------------------------------------------------------

def daily_mean_calendar(spark, sf):
    return rounded(user_days(spark, sf))


def distinct_dates(spark, sf):
    return calendar.distinct_dates(readings(spark, sf), keys=("event_type",))


def date_calendar(spark, sf):
    users = readings(spark, sf).select("user_id").distinct()
    return calendar.date_calendar(users, *_span(spark, sf))


def range_chunks(spark, sf):
    spans = load(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    return calendar.range_chunks(spans, "first", "last", 28).select(
        "o_orderpriority", "chunk_start", "chunk_end")


# --- row windows and kernels -----------------------------------------------------------------

def sma_centered(spark, sf):
    return rounded(windows.simple_row_means(user_days(spark, sf), "value", (7, 14)))


def sma_all_widths(spark, sf):
    return rounded(windows.simple_row_means(user_days(spark, sf), "value"))


def gaussian_rows(spark, sf):
    return rounded(windows.gaussian_row_means(user_days(spark, sf), "value", (7,)))


def gaussian_rows_all_widths(spark, sf):
    return rounded(windows.gaussian_row_means(user_days(spark, sf), "value"))


def kernel_gaussian(spark, sf):
    return rounded(smooth.kernel_smooth(one_series(user_days(spark, sf)), ["gaussian"], FEW))


def kernel_boxcar(spark, sf):
    return rounded(smooth.kernel_smooth(one_series(user_days(spark, sf)), ["simple"], FEW))


def kernel_all_bandwidths(spark, sf):
    return rounded(smooth.kernel_smooth(one_series(user_days(spark, sf)), bandwidths=BANDWIDTHS))


def kernel_many_series(spark, sf):
    return rounded(smooth.kernel_smooth(type_days(spark, sf), bandwidths=(7, 14)))


def kernel_repeated_dates(spark, sf):
    """Every reading by itself: several of one user and date count one by one and all get rows."""
    return rounded(smooth.kernel_smooth(one_series(readings(spark, sf)), bandwidths=(1, 7)))


def band_pairs(spark, sf):
    days = calendar.daily_mean(readings(spark, sf), ["value"]).select(
        "user_id", F.unix_date("date").alias("day"), "value")
    other = days.select("user_id", F.col("day").alias("other_day"), F.col("value").alias("other_value"))
    pairs = band_join(days, other, ["user_id"], "day", "other_day", -2, 3)
    return rounded(pairs.groupBy("user_id", F.date_from_unix_date("day").alias("date")).agg(
        F.count("*").alias("n"), F.sum("other_value").alias("near_sum")))


def align_to_dates(spark, sf):
    days = calendar.daily_mean(readings(spark, sf), ["value"])
    spine = readings(spark, sf).select("user_id", "date").distinct()
    means = smooth.boxcar_means(days, (7,), keys=("user_id",))
    return rounded(smooth.align_to_dates(spine, means, ["user_id", "date"])
                   .select("user_id", "date", F.col("value").alias("smooth")))


def _wide(spark, sf):
    long = smooth.kernel_smooth(type_days(spark, sf), ["boxcar"], FEW)
    return smooth.wide(long, EVENT_TYPES, ["boxcar"], FEW)


def smooth_wide(spark, sf):
    return rounded(_wide(spark, sf))


def smooth_trim(spark, sf):
    return rounded(smooth.trim_wide(_wide(spark, sf), 2, 13))


def smooth_trim_long(spark, sf):
    long = smooth.kernel_smooth(type_days(spark, sf), ["boxcar"], FEW)
    return rounded(smooth.trim_bandwidths(long, 7, 150))


# --- cleaning and workouts -------------------------------------------------------------------

def zero_to_null_units(spark, sf):
    return rounded(load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        zero_to_null("l_discount").alias("discount"), zero_to_null("l_tax").alias("tax"),
        seconds_to_hours("l_quantity").alias("hours"),
        grams_to_pounds("l_extendedprice").alias("pounds"),
        (F.col("l_discount") * grams_to_pounds("l_extendedprice") / F.lit(100.0)).alias("fat")))


def sleep_clock_hours(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    nights = readings(spark, sf).withColumns({"start_ms": ms, "end_ms": ms + F.lit(28_800_000)})
    return rounded(clean.sleep_clock(nights, "start_ms", "end_ms").select(
        "event_id", "date", "sleep_start_time", "sleep_end_time"))


def _stored_days(spark, sf, name: str) -> DataFrame:
    """Events as stored rows of a daily table: column i holds the day's mean value plus i."""
    days = calendar.daily_mean(readings(spark, sf), ["value"])
    columns = [c for c in DAILY_PAYLOADS[name].mapping.values()]
    if name == "health_stats":
        columns.append("fat_mass")
    base = F.col("value")
    cells = {c: F.floor(base + i) % 50 * F.lit(1.0) for i, c in enumerate(columns)}
    if name == "sleep":
        midnight = F.unix_date("date").cast("double") * 86_400_000.0
        cells["local_sleep_start_time"] = midnight - F.floor(base) * 60_000.0
        cells["local_sleep_time_end"] = midnight + F.floor(base) * 60_000.0
    return days.select(F.xxhash64("user_id", "date").alias("id"), "user_id", "date",
                       *[v.alias(c) for c, v in cells.items()], F.lit(RUN_DATE).alias("date_pulled"))


def clean_query(name: str) -> Query:
    return lambda spark, sf: rounded(clean.CLEANERS[name](_stored_days(spark, sf, name)))


def _sets(spark, sf) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "R", "BENCH_PRESS").otherwise(F.col("l_returnflag"))
    return load(spark, sf, "lineitem").select(
        label.alias("Exercise"), (F.col("l_extendedprice") / 1000.0).alias("Weight"),
        F.col("l_quantity").cast("int").alias("Reps"), "l_suppkey")


def workout_agg(spark, sf):
    return rounded(workout.workout_summary(_sets(spark, sf)), 3)


def workout_agg_by(spark, sf):
    return rounded(workout.workout_summary(_sets(spark, sf), by=("l_suppkey",)), 3)


# --- landed bodies ---------------------------------------------------------------------------

def json_fields(spark, sf):
    props = F.from_json("props", "struct<k: bigint, missing: double>")
    return readings(spark, sf).select("event_id", "date", props["k"].alias("k"),
                                      props["missing"].alias("missing"))


def _landed_daily(spark, sf, name: str) -> DataFrame:
    """One response body per event: mapped key i holds value + i, text keys the event type.

    Views carry a list of one under the values member, clicks the keys themselves, others an
    object. Weigh-ins are always lists and share one batch, so a day averages its events.
    """
    p = DAILY_PAYLOADS[name]
    keys = [(F.col("event_type") if k in p.text else F.col("value") + i).alias(k)
            for i, k in enumerate(p.mapping)]
    day = F.date_format("date", "yyyy-MM-dd").alias(p.date_field)
    one = F.struct(*keys)
    as_list = F.to_json(F.array(F.struct(day, F.array(one).alias(p.values_field))))
    as_object = F.to_json(F.array(F.struct(day, one.alias(p.values_field))))
    as_self = F.to_json(F.array(F.struct(day, *keys)))
    entry = as_list if p.weigh_ins else F.when(F.col("event_type") == "view", as_list).when(
        F.col("event_type") == "click", as_self).otherwise(as_object)
    body = F.concat(F.lit(f'{{"{p.path}":'), entry, F.lit("}")) if p.path else entry
    batch = F.lit(1).cast("bigint") if p.weigh_ins else F.col("event_id")
    return readings(spark, sf).select("user_id", F.lit(name).alias("metric"), F.col("date").alias("query_date"),
                                      batch.alias("batch"), body.alias("body"))


def ingest_daily(name: str) -> Query:
    return lambda spark, sf: rounded(
        decode.daily_batch(decode.decode_daily(_landed_daily(spark, sf, name), name), name))


def _landed_intraday(spark, sf, name: str) -> DataFrame:
    """Response bodies of a user's day, at most BODY_SPAN readings each, descriptors reversed."""
    p = INTRADAY_PAYLOADS[name]
    ev = readings(spark, sf).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")).cast("double"))
    groups = ev.groupBy("user_id", F.col("date").alias("query_date"),
                        F.floor(F.col("event_id") / BODY_SPAN).alias("batch"))
    if isinstance(p, FlatPayload):
        text = {"startGMT": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
                "endGMT": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
                "primaryActivityLevel": F.col("event_type"), "activityLevelConstant": F.lit("true")}
        cells = [text.get(k, F.col("value") + i).alias(k) for i, k in enumerate(p.mapping)]
        bodies = groups.agg(F.to_json(F.collect_list(F.struct(*cells))).alias("body"))
    else:
        names = list(p.mapping)
        row = F.array(*[F.col("ms") if k == "timestamp" else F.col("value") + i
                        for i, k in enumerate(names)])
        described = F.array(*[F.struct(F.lit(k).alias(p.key_field), F.lit(i).alias(p.index_field))
                              for i, k in reversed(list(enumerate(names)))])
        bodies = groups.agg(F.collect_list(row).alias("rows")).withColumn("body", F.to_json(F.struct(
            F.lit(60.0).alias(p.available), described.alias(p.descriptors), F.col("rows").alias(p.values))))
    return bodies.select("user_id", F.lit(name).alias("metric"), "query_date", "batch", "body")


def ingest_intraday(name: str) -> Query:
    def run(spark, sf):
        days = decode.day_status(_landed_intraday(spark, sf, name), name)
        return rounded(decode.intraday_rows(days, name).drop("batch", "item"))
    return run


def _event_days(spark, sf) -> DataFrame:
    flag = lambda kind: F.bool_or(F.col("event_type") == kind).alias(kind)
    return readings(spark, sf).groupBy("user_id", F.col("date").alias("query_date")).agg(
        *[flag(k) for k in EVENT_TYPES], F.max("value").alias("top"),
        F.unix_millis(F.max("ts").cast("timestamp")).cast("double").alias("ms"))


def _refusals(spark, sf) -> DataFrame:
    """Reload replies: a user is refused on days whose signups exceed a value."""
    return readings(spark, sf).where("event_type = 'signup'").select(
        "user_id", F.col("date").alias("query_date"),
        F.when(F.col("value") > 100, "DENIED").otherwise("OK").alias("status"))


def _descriptor_days(spark, sf, again: bool = False) -> DataFrame:
    """A response for each day; `again`: of a later batch, with data on every day and other values."""
    p = INTRADAY_PAYLOADS["heart_rate_detailed"]
    days, batch = _event_days(spark, sf), 1
    if again:
        days, batch = days.withColumns({"view": F.lit(True), "purchase": F.lit(True), "click": F.lit(True), "top": F.col("top") + 1000.0}), 2
    described = F.array(F.struct(F.lit("timestamp").alias("key"), F.lit(0).alias("index")),
                        F.struct(F.lit("heartrate").alias("key"), F.lit(1).alias("index")))
    body = F.struct(F.when(F.col("view"), F.col("top")).alias(p.available),
                    F.when(F.col("purchase"), described).alias(p.descriptors),
                    F.when(F.col("purchase") & F.col("click"), F.array(F.array("ms", "top"))).alias(p.values))
    return days.select("user_id", "query_date", F.lit(batch).cast("bigint").alias("batch"), F.to_json(body).alias("body"))


def load_status(spark, sf):
    days = decode.settle_reloads(decode.day_status(_descriptor_days(spark, sf), "heart_rate_detailed"),
                                 _refusals(spark, sf))
    return days.select("user_id", "query_date", "pull_status")


def load_rows(spark, sf):
    rows = decode.decode_intraday(_descriptor_days(spark, sf), "heart_rate_detailed", _refusals(spark, sf))
    return rounded(rows.select("user_id", "query_date", "date_time_utc", "hr", "pull_status", "is_marker"))


def load_status_flat(spark, sf):
    steps = F.when(F.col("purchase"), F.lit(0.0)).otherwise(F.col("top"))
    cells = F.when(F.col("error"), F.array(F.struct(steps.alias("steps")), F.struct(F.lit(0.0).alias("steps"))))
    body = F.to_json(F.coalesce(cells, F.slice(F.array(F.struct(steps.alias("steps"))), 1, 0)))
    days = _event_days(spark, sf).select("user_id", "query_date", F.lit(1).cast("bigint").alias("batch"),
                                         body.alias("body"))
    return decode.settle_reloads(decode.day_status(days, "steps_detailed"), None).select(
        "user_id", "query_date", "pull_status")


def all_zero_days(spark, sf):
    items = load(spark, sf, "lineitem").withColumn("query_date", F.to_date("l_shipdate"))
    return status.all_zero_days(items, "l_discount", ("l_suppkey", "query_date"))


def _day_states(spark, sf) -> DataFrame:
    state = F.when(F.col("purchase"), "fetched").when(F.col("error"), "denied").when(
        F.col("click"), "no_data").otherwise("pending")
    return _event_days(spark, sf).select("user_id", "query_date", state.alias("status"))


def status_lookup(spark, sf):
    rows = readings(spark, sf).select("event_id", "user_id", F.col("date").alias("query_date"))
    return status.with_status(rows, _day_states(spark, sf)).select("event_id", "pull_status")


def status_tally(spark, sf):
    return status.status_tally(_day_states(spark, sf)).withColumn(
        "dates", F.array_join(F.col("dates").cast("array<string>"), ","))


def empty_dates(spark, sf):
    return status.empty_dates(_day_states(spark, sf))


def placeholders(spark, sf):
    data = readings(spark, sf).where("event_type = 'purchase'").select(
        "user_id", F.col("date").alias("query_date"), F.col("ts").cast("timestamp").alias("date_time_utc"),
        "value", F.lit("fetched").alias("pull_status"))
    return rounded(status.with_placeholders(data, _day_states(spark, sf)))


def watermark(spark, sf):
    orders = load(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    return status.high_water(orders, keys=("o_custkey",))


def missing_dates(spark, sf):
    users = readings(spark, sf).select("user_id").distinct()
    days = calendar.date_calendar(users, *_span(spark, sf), "query_date")
    seen = _day_states(spark, sf).withColumnRenamed("status", "pull_status")
    return status.dates_to_load(days, seen)


# --- upserts ---------------------------------------------------------------------------------

def _order_days(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice",
        "o_orderpriority", "o_orderstatus")


def last_write_wins(spark, sf):
    return rounded(last_write(_order_days(spark, sf), ("o_custkey", "date"), ("o_orderkey",)))


def upsert_daily(spark, sf):
    days, key = _order_days(spark, sf), ("o_custkey", "date")
    stored = last_write(days.where(F.col("date") <= F.lit(STORED_UNTIL).cast("date")), key, ("o_orderkey",))
    incoming = days.where(F.col("date") >= F.lit(INCOMING_FROM).cast("date")).select(
        *key, "o_orderkey",
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") * 2.0).alias("o_totalprice"),
        "o_orderstatus")
    return rounded(upsert(stored, last_write(incoming, key, ("o_orderkey",)), key))


def upsert_intraday(spark, sf):
    key = ("user_id", "date_time_utc")
    rows = load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("date_time_utc"),
                                            "event_id", "value", "event_type")
    stored = last_write(rows.where("date_time_utc < timestamp '2024-01-20'"), key, ("event_id",))
    incoming = rows.where("date_time_utc >= timestamp '2024-01-15'").select(
        *key, "event_id", (F.col("value") * 2.0).alias("value"))
    return rounded(upsert(stored, last_write(incoming, key, ("event_id",)), key))


# --- loads through stored tables ----------------------------------------------------------------

def _store(spark, *names: str) -> TableStore:
    store = TableStore(spark, scratch_uri(spark, "db"))
    for name in names:
        store.create(name)
    return store


def load_daily(spark, sf):
    """Three loads of interleaved batches, the newest first."""
    store, landed = _store(spark, "steps"), _landed_daily(spark, sf, "steps")
    for turn in (2, 0, 1):
        loads.load_daily(store, landed.where(F.col("batch") % 3 == turn), "steps", RUN_DATE)
    return rounded(store.df("steps").drop("id"))


def load_weight_calendar(spark, sf):
    """Loads of apart days, the last first: the days between them are filled in."""
    store, landed = _store(spark, "health_stats"), _landed_daily(spark, sf, "health_stats")
    day = F.dayofmonth("query_date")
    for part in (day > 20, day < 8, day.between(8, 20)):
        loads.load_daily(store, landed.where(part), "weight", RUN_DATE)
    return rounded(store.df("health_stats").drop("id", "date_pulled"))


def load_intraday(spark, sf):
    """Every day also has an empty response of a later batch, which here is loaded first."""
    store, name = _store(spark, "heart_rate_detailed"), "heart_rate_detailed"
    days = _descriptor_days(spark, sf)
    empty = days.withColumns({"batch": F.lit(2).cast("bigint"), "body": F.lit("{}")})
    for part in (empty, days.where(F.dayofmonth("query_date") % 2 == 0), days.where(F.dayofmonth("query_date") % 2 == 1)):
        loads.load_intraday(store, part, "heart_rate", RUN_DATE, answers=_refusals(spark, sf))
    return rounded(store.df(name).select("user_id", "query_date", "date_time_utc", "hr", "pull_status"))


def quarantined_rows(spark, sf):
    """Steps bodies with a good row and one whose start is bad, by the event's type also with an offset or no JSON."""
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    good = F.when(F.col("event_type") == "view", F.concat(start, F.lit("Z"))).otherwise(F.concat(start, F.lit("+02:00")))
    row = lambda at, end: F.struct(at.alias("startGMT"), end.alias("endGMT"), F.col("value").alias("steps"))
    body = F.to_json(F.array(row(good, F.lit("bad")), row(F.lit("soon"), start)))
    landed = readings(spark, sf).select("user_id", F.col("date").alias("query_date"), F.col("event_id").alias("batch"),
                                        F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(body).alias("body"))
    return decode.quarantined(landed, "steps_detailed")


def _chunk_bodies(spark, sf) -> DataFrame:
    """Steps responses of ten days of a month of a user, an entry for each event in order; batch 1 is the first third."""
    p = DAILY_PAYLOADS["steps"]
    entry = F.struct(F.date_format("date", "yyyy-MM-dd").alias(p.date_field),
                     F.struct(*[(F.col("value") + i).alias(k) for i, k in enumerate(p.mapping)]).alias(p.values_field))
    third = F.least(F.floor((F.dayofmonth("date") - 1) / 10), F.lit(2))
    groups = readings(spark, sf).groupBy("user_id", F.date_add(F.trunc("date", "MM"), (third * 10).cast("int")).alias("query_date"),
                                         (third + 1).alias("batch"))
    bodies = groups.agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("all"))
    return bodies.select(F.col("user_id").cast("string").alias("user_id"), F.lit("steps").alias("metric"), "query_date", "batch",
                         F.to_json(F.struct(F.transform("all", lambda x: x["e"]).alias(p.path))).alias("body"))


def load_incremental(spark, sf):
    """Three arrivals of bodies, each loaded as it comes: the last third of the month, the first two, and again the
    first with other values under an older batch, late, which displaces nothing."""
    store, bodies = _store(spark, "steps"), BodyStore(spark, scratch_uri(spark, "bodies"))
    landed, batch = _chunk_bodies(spark, sf), F.col("batch")
    late = landed.where(batch == 1).withColumns({"batch": F.lit(0).cast("bigint"), "body": F.regexp_replace("body", r"([0-9])\.", "9$1.")})
    for arrival in (landed.where(batch == 3), landed.where(batch < 3), late):
        bodies.append("steps", arrival)
        loads.load_new(store, bodies, "steps", RUN_DATE)
    return rounded(store.df("steps").drop("id"))


def load_incremental_days(spark, sf):
    """Two arrivals of intraday days: of the second, only days without an outcome are loaded."""
    store, bodies, name = _store(spark, "heart_rate_detailed"), BodyStore(spark, scratch_uri(spark, "bodies")), "heart_rate_detailed"
    for again in (False, True):
        bodies.append(name, _descriptor_days(spark, sf, again).withColumn("metric", F.lit(name)))
        loads.load_new(store, bodies, name, RUN_DATE, answers=_refusals(spark, sf))
    return rounded(store.df(name).select("user_id", "query_date", "date_time_utc", "hr", "pull_status"))


def landed_files(spark, sf):
    """Response files of two thirds of the month are compacted, then those of the last third beside the old ones."""
    root, bodies = scratch_uri(spark, "landing"), BodyStore(spark, scratch_uri(spark, "bodies"))
    for part in (F.col("batch") < 3, F.col("batch") == 3):
        land(_chunk_bodies(spark, sf).where(part), root)
        bodies.compact(root, "steps")
    entries = F.json_array_length(F.get_json_object("body", f"$.{DAILY_PAYLOADS['steps'].path}"))
    return bodies.scan("steps").select("user_id", "metric", "query_date", "batch", "arrival", "file", entries.alias("n_entries"))


def stream_load(spark, sf):
    """The same files as a stream of several triggers, whose last micro-batch is then applied once more."""
    root, store = scratch_uri(spark, "landing"), _store(spark, "steps")
    land(_chunk_bodies(spark, sf), root)
    checkpoint = scratch_uri(spark, "stream")
    query = load_available(store, root, "steps", checkpoint, RUN_DATE, files_per_trigger=1_000)
    query.awaitTermination()
    last = query.lastProgress.batchId
    apply_batch(store, read_landed(spark, root, "steps").withColumn("body", F.lit('{"broken')), last, "steps", checkpoint, RUN_DATE)
    return rounded(store.df("steps").drop("id").withColumn("n_lost", F.lit(store.lost("steps").count())))


def table_snapshots(spark, sf):
    """Orders stored in three writes, the last over half of the first: what a reader from before the last write has,
    and the newest version."""
    store = _store(spark, "activities")
    key = {"user_id": F.col("o_custkey").cast("string"), "activityId": F.col("o_orderkey").cast("string")}
    rows = load(spark, sf, "orders").withColumns(key).withColumn("date", F.to_date("o_orderdate"))
    old = F.col("date") < F.lit(INCOMING_FROM).cast("date")
    store.add_records("activities", rows.where(old).select(*key, "date", F.col("o_totalprice").alias("distance")))
    store.upsert("activities", rows.where(~old).select(*key, "date", F.col("o_totalprice").alias("distance")))
    held = store.df("activities")
    store.upsert("activities", rows.where("o_orderkey % 2 = 0").select(*key, (F.col("o_totalprice") * 2.0).alias("distance")))
    label = lambda df, version: df.select(F.lit(version).alias("version"), "user_id", "activityId", "date", "distance")
    return rounded(label(store.df("activities", 1), 1).unionByName(label(held, 2)).unionByName(label(store.df("activities"), store.version("activities"))))


def table_append_update(spark, sf):
    """Orders as activities: appended, then their prices and the newest orders upserted."""
    store = _store(spark, "activities")
    key = {"user_id": F.col("o_custkey").cast("string"), "activityId": F.col("o_orderkey").cast("string")}
    rows = load(spark, sf, "orders").withColumns(key).withColumn("date", F.to_date("o_orderdate"))
    split = F.lit(INCOMING_FROM).cast("date")
    store.add_records("activities", rows.where(F.col("date") < split).select(*key, "date", F.col("o_totalprice").alias("distance")))
    store.upsert("activities", rows.where(F.col("date") >= F.date_sub(split, 90)).select(*key, "date", (F.col("o_totalprice") * 2.0).alias("calories")))
    return rounded(store.df("activities").select(*key, "date", "distance", "calories", "detailsPulled"))


def stored_row_means(spark, sf):
    return rounded(windows.stored_row_means(user_days(spark, sf), ["value"], scratch_uri(spark, "means"), (7, 14)))


# --- activities and quality ------------------------------------------------------------------

def topk_recent(spark, sf):
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return rounded(activities.most_recent(load(spark, sf, "orders"), order).select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice"))


def activity_list(spark, sf):
    """List responses of at most BODY_SPAN activities, built from events, newest ten per user.

    Every response came before with other distances and comes again unchanged.
    """
    item = F.struct(F.col("event_id").cast("string").alias("activityId"),
                    F.col("event_type").alias("activityType"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("startTime"),
                    F.col("value").alias("distance"))
    landed = load(spark, sf, "events").groupBy(
        "user_id", F.floor(F.col("event_id") / BODY_SPAN).alias("batch")).agg(
        F.to_json(F.collect_list(item)).alias("body"))
    before = landed.withColumns({"batch": F.col("batch") - 1_000_000, "body": F.replace("body", F.lit('"distance":'), F.lit('"distance":9'))})
    again = landed.withColumn("batch", F.col("batch") + 1_000_000)
    return rounded(activities.activity_list(before.unionByName(landed).unionByName(again), 10).select(
        "user_id", "activityId", "activityType", "startTime", "distance", "detailsPulled"))


def strength_sets(spark, sf):
    """A workout response per order: for each line a working set and a rest of its tax in seconds. Each
    response came before with other sets."""
    active = F.struct(F.lit("ACTIVE").alias("setType"), F.col("l_returnflag").alias("exerciseName"),
                      F.col("l_quantity").cast("int").alias("reps"),
                      F.col("l_partkey").cast("int").alias("weight"), F.col("l_discount").alias("duration"))
    rest = F.struct(F.lit("REST").alias("setType"), F.lit(None).cast("string").alias("exerciseName"),
                    F.lit(None).cast("int").alias("reps"), F.lit(None).cast("int").alias("weight"),
                    F.col("l_tax").alias("duration"))
    landed = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("activityId")).agg(
        F.to_json(F.struct(F.flatten(F.collect_list(F.array(active, rest))).alias("exerciseSets"))).alias("body")).withColumn("batch", F.lit(2))
    before = landed.withColumns({"batch": F.lit(1), "body": F.replace("body", F.lit("ACTIVE"), F.lit("OLD"))})
    return rounded(activities.strength_sets(landed.unionByName(before)).select(
        "activityId", "setType", "exerciseName", "reps", "weight", "duration"))


def type_split(spark, sf):
    return rounded(activities.of_type(load(spark, sf, "events"), "purchase", "event_type", EVENT_TYPES)
                   .select("event_id", "user_id", "value"))


def dq_unique(spark, sf):
    return quality.duplicate_keys(load(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"))


def dq_not_null(spark, sf):
    props = F.from_json("props", "struct<k: bigint>")["k"]
    rows = load(spark, sf, "events").select("event_id", F.nullif(props, F.lit(50)).alias("k"),
                                            F.when(F.col("value") >= 5, F.col("value")).alias("v"))
    return quality.missing_keys(rows, ("k", "v")).select("event_id", F.array_join("missing", ",").alias("missing"))


def unreadable_bodies(spark, sf):
    props = load(spark, sf, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("key"),
                                             F.col("props").alias("body"))
    texts = load(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("key"),
                                                F.col("text").alias("body"))
    return quality.unreadable(props.unionByName(texts)).select("source", "key")


# --- series marts ----------------------------------------------------------------------------

def series_query(metric: str) -> Query:
    """The mart of a metric over events: viewed column i holds the day's mean plus i."""
    def run(spark, sf):
        days = user_days(spark, sf)
        columns = [v.series for v in SERIES_VIEWS[metric]]
        table = days.select("user_id", "date", *[(F.col("value") + i).alias(c) for i, c in enumerate(columns)])
        long = smooth.to_long(table, columns).withColumn("metric", F.lit(metric))
        smoothed = smooth.kernel_smooth(long, ["gaussian"], (1, 14))
        return rounded(series.metric_series(metric, table, smoothed, 2, 150))
    return run


# --- processing and publishing ---------------------------------------------------------------

def process_all(spark, sf):
    """The wide exports of all six metrics, read back with a row per series and kernel."""
    files = FrameStore(spark, scratch_uri(spark, "process"))
    publish.process_frames({n: _stored_days(spark, sf, n) for n in clean.CLEANERS}, files)
    parts = []
    for metric, columns in SMOOTHED_COLUMNS.items():
        rows = [F.struct(F.lit(c).alias("series"), F.lit(k).alias("kernel"),
                         *[F.col(smooth_name(c, k, b)).alias(f"b{b}") for b in BANDWIDTHS]) for c in columns for k in KERNELS]
        parts.append(files.read(f"moving_averages/{metric}.parquet")
                     .select("user_id", F.lit(metric).alias("metric"), "date", F.inline(F.array(*rows))))
    return rounded(reduce(DataFrame.unionByName, parts))


def publish_series(spark, sf):
    """The marts after a second refresh, by when days were added and some smooths are not there yet."""
    files = FrameStore(spark, scratch_uri(spark, "publish"))
    stored = {n: _stored_days(spark, sf, n) for n in clean.CLEANERS}

    def refresh(raw_until: str, smoothed_until: str) -> None:
        files.write_each({n: c.where(F.col("date") < raw_until) for n, c in clean.clean_all(stored).items()}, "processed")
        cleaned = {n: files.read(f"processed/{n}.parquet").where(F.col("date") < smoothed_until) for n in SERIES_VIEWS}
        files.write(smooth.smooth_all(cleaned, bandwidths=FEW), publish.SMOOTHED, partition_by=("metric",))
        publish.refresh_series(files, 2, 150)

    refresh("2024-01-15", "2024-01-15")
    refresh("9999-01-01", "2024-01-25")
    marts = [publish.read_series(files, m).withColumn("metric", F.lit(m)) for m in SERIES_VIEWS]
    return rounded(reduce(DataFrame.unionByName, marts))


def smooth_incremental(spark, sf):
    """Stored smooths after a refresh over days that came, went and changed since the first one."""
    days = type_days(spark, sf)
    kernels = smooth.date_kernels(["boxcar"], FEW) + smooth.date_kernels(["gaussian"], (1,), 9.0)
    store = SmoothStore(spark, scratch_uri(spark, "smooths"), kernels, step=7)
    other = F.when(F.col("user_id") % 5 == 0, F.col("value") * 2).otherwise(F.col("value"))
    early = days.where((F.col("date") < "2024-01-24") | (F.col("user_id") % 2 == 0))
    gone = days.where(F.col("date") >= "2024-01-29").withColumn("date", F.date_add("date", 40))
    store.refresh(early.withColumn("value", other).unionByName(gone))
    store.refresh(days)
    return rounded(store.read("user_id bigint, metric string, series string"))


# --- stored files ----------------------------------------------------------------------------

def _order_frame(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.to_date("o_orderdate").alias("date"), "o_orderpriority")


def _roundtrip(spark, sf, fmt: str) -> DataFrame:
    orders = _order_frame(spark, sf)
    store = FrameStore(spark, scratch_uri(spark, f"roundtrip-{fmt}"))
    store.write(orders, f"orders.{fmt}", fmt)
    return rounded(store.read(f"orders.{fmt}", fmt, orders.schema))


def io_roundtrip_parquet(spark, sf):
    return _roundtrip(spark, sf, "parquet")


def io_roundtrip_csv(spark, sf):
    return _roundtrip(spark, sf, "csv")


def io_union(spark, sf):
    """Chunks written apart and read as one; the later chunk has no priority column."""
    orders = _order_frame(spark, sf)
    split = F.lit(INCOMING_FROM).cast("date")
    store = FrameStore(spark, scratch_uri(spark, "union"))
    store.write(orders.where(F.col("date") < split), "old.parquet")
    store.write(orders.where(F.col("date") >= split).drop("o_orderpriority"), "new.parquet")
    return rounded(store.read("old.parquet").unionByName(store.read("new.parquet"), allowMissingColumns=True))


def sorted_export(spark, sf):
    """A sorted export with the place of each row, and what a read between two dates gives."""
    orders = _order_frame(spark, sf)
    store = FrameStore(spark, scratch_uri(spark, "sorted"))
    store.write_sorted(orders, "orders.parquet", ("date", "o_orderkey"), rows_per_file=5_000)
    bounds = store.manifest("orders.parquet").select("file", "low", "high")
    key = F.struct("date", "o_orderkey")
    every = store.read_sorted("orders.parquet").join(bounds, "file").withColumn("in_bounds", key.between(F.col("low"), F.col("high")))
    some = store.read_sorted("orders.parquet", *(dt.date.fromisoformat(d) for d in (INCOMING_FROM, STORED_UNTIL)))
    columns = ["o_orderkey", "date", "row", "in_bounds", "part"]
    return every.withColumn("part", F.lit("all")).select(*columns).unionByName(
        some.withColumns({"in_bounds": F.lit(True), "part": F.lit("between")}).select(*columns))


def registry() -> dict[str, Query]:
    plain = (
        daily_mean_calendar, distinct_dates, date_calendar, range_chunks, sma_centered, sma_all_widths,
        gaussian_rows, gaussian_rows_all_widths, kernel_gaussian, kernel_boxcar, kernel_all_bandwidths,
        kernel_many_series, kernel_repeated_dates, band_pairs, align_to_dates, smooth_wide, smooth_trim, smooth_trim_long,
        zero_to_null_units, sleep_clock_hours, workout_agg, workout_agg_by, json_fields, load_status,
        load_rows, load_status_flat, all_zero_days, status_lookup, status_tally, empty_dates,
        placeholders, watermark, missing_dates, last_write_wins, upsert_daily, upsert_intraday,
        load_daily, load_weight_calendar, load_intraday, load_incremental, load_incremental_days, landed_files, stream_load,
        quarantined_rows, table_append_update, table_snapshots, stored_row_means, process_all, publish_series, smooth_incremental,
        topk_recent, activity_list, strength_sets, type_split, dq_unique, dq_not_null,
        unreadable_bodies, io_roundtrip_parquet, io_roundtrip_csv, io_union, sorted_export,
    )
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {f"clean_{n}": clean_query(n) for n in clean.CLEANERS}
    out |= {f"ingest_{n}": ingest_daily(n) for n in DAILY_PAYLOADS}
    out |= {f"ingest_{n}": ingest_intraday(n) for n in INTRADAY_PAYLOADS}
    out |= {f"series_{m}": series_query(m) for m in SERIES_VIEWS}
    return out
