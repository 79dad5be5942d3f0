"""Landed response bodies to typed rows.

Input frames have the columns of `restwave.sources.landing.LANDED`: user_id, metric, query_date,
batch, body. `batch` is the ingest ordinal; together with the position inside the body it orders
writes to the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restwave.functions import end_of_day, epoch_ms_to_utc, grams_to_pounds, text_to_utc
from restwave.operators.calendar import daily_mean, fill_calendar
from restwave.operators.quality import unreadable
from restwave.operators.status import DENIED, FETCHED, NO_DATA, PENDING, RELOAD, UNKNOWN
from restwave.operators.upsert import VERSION, last_write
from restwave.schemas import (
    DAILY_PAYLOADS,
    INTRADAY_PAYLOADS,
    DailyPayload,
    DescriptorPayload,
    FlatPayload,
)

ORDER = ("batch", "query_date", "entry", "item")
CORRUPT = "_corrupt"


def daily_rows(landed: DataFrame, payload: DailyPayload) -> DataFrame:
    """One row per measurement: user, date, mapped columns and the ORDER columns.

    The values member of an entry may be an object, a list of objects, or absent, in which case
    the entry itself carries the keys. A list schema reads an object as a list of one.
    """
    body = F.from_json("body", payload.body)
    entries = body[payload.path] if payload.path else body
    e = F.col("_e")
    own = F.array(F.struct(*[e[k].alias(k) for k in payload.mapping]))
    nested = e[payload.values_field]
    measures = F.when(nested.isNull(), own).otherwise(F.from_json(nested, payload.measures))
    return (landed.select("user_id", "batch", "query_date", F.posexplode(entries).alias("entry", "_e"))
            .select("user_id", "batch", "query_date", "entry",
                    F.try_to_date(e[payload.date_field], "yyyy-MM-dd").alias("date"),
                    F.posexplode(measures).alias("item", "_m"))
            .select("user_id", "date", *[F.col("_m")[k].alias(c) for k, c in payload.mapping.items()],
                    *ORDER)
            .where(F.col("date").isNotNull()))


def versioned(rows: DataFrame, rank: Column | int = 1) -> DataFrame:
    """The ORDER columns as the version that a stored row keeps; see `upsert.VERSION`."""
    have = dict(zip(("batch", "query_date", "entry", "item"), VERSION[1:]))
    kinds = {"_batch": "bigint", "_asked": "date"}
    named = {v: (F.col(c) if c in rows.columns else F.lit(None)).cast(kinds.get(v, "int")) for c, v in have.items()}
    return rows.withColumns({VERSION[0]: F.lit(rank) if isinstance(rank, int) else rank, **named})


def weigh_in_days(rows: DataFrame) -> DataFrame:
    """Weigh-ins to one row per day: means, calendar, pounds and fat mass.

    A day landed in several batches counts only its newest batch. Days that the calendar adds
    have rank 0, so they never displace a measured day.
    """
    values = [c for c in rows.columns if c not in ("user_id", "date", *ORDER)]
    # Reduced to days, one exchange by user serves both the newest batch and the calendar.
    per_batch = daily_mean(rows, values, keys=("user_id", "batch")).repartition("user_id")
    newest = versioned(last_write(per_batch, ("user_id", "date"), ("batch",), keep=("batch",))).drop("batch")
    days = fill_calendar(newest).withColumn("_rank", F.coalesce("_rank", F.lit(0)))
    return (days.withColumns({c: grams_to_pounds(c) for c in ("weight", "muscle_mass", "bone_mass")})
            .withColumn("fat_mass", F.col("body_fat") * F.col("weight") / F.lit(100.0)))


def daily_batch(rows: DataFrame, name: str, keep_version: bool = False) -> DataFrame:
    """Measurements of one table to an upsert batch holding each (user, date) once."""
    if DAILY_PAYLOADS[name].weigh_ins:
        out = weigh_in_days(rows)
    else:
        out = last_write(versioned(rows).drop(*ORDER), ("user_id", "date"), VERSION, keep=VERSION)
    return out if keep_version else out.drop(*VERSION)


def decode_daily(landed: DataFrame, name: str) -> DataFrame:
    if name not in DAILY_PAYLOADS:
        raise ValueError(f"unsupported daily metric {name!r}")
    return daily_rows(landed, DAILY_PAYLOADS[name])


def descriptor_index(descriptors: Column, key: str, payload: DescriptorPayload) -> Column:
    """Position of a named value in the rows of a descriptor response."""
    named = F.filter(descriptors, lambda d: d[payload.key_field] == F.lit(key))
    return F.get(named, F.lit(0))[payload.index_field]


def _descriptor_status(r: Column, p: DescriptorPayload) -> Column:
    described = F.coalesce(F.size(r[p.descriptors]), F.lit(0)) > 0
    filled = F.coalesce(F.size(r[p.values]), F.lit(0)) > 0
    return (F.when(r.isNull() | r[CORRUPT].isNotNull(), UNKNOWN)
            .when(~described & r[p.available].isNull(), NO_DATA)
            .when(~described, RELOAD)
            .when(filled, FETCHED)
            .otherwise(NO_DATA))


def _flat_status(r: Column, p: FlatPayload) -> Column:
    idle = F.forall(r, lambda x: F.coalesce(x[p.available] == F.lit(0.0), F.lit(False)))
    return F.when(r.isNull(), UNKNOWN).when(F.size(r) == 0, NO_DATA).when(idle, RELOAD).otherwise(FETCHED)


def intraday_payload(name: str) -> DescriptorPayload | FlatPayload:
    if name not in INTRADAY_PAYLOADS:
        raise ValueError(f"unsupported intraday metric {name!r}")
    return INTRADAY_PAYLOADS[name]


def day_status(landed: DataFrame, name: str) -> DataFrame:
    """Parse each landed day once and classify it: adds `_r` (parsed) and `pull_status`.

    Unreadable text and an empty body have status unknown.
    """
    payload = intraday_payload(name)
    r = F.from_json("body", payload.body, {"columnNameOfCorruptRecord": CORRUPT})
    classify = _descriptor_status if isinstance(payload, DescriptorPayload) else _flat_status
    # Generated rather than projected: a later filter on the status would otherwise be pushed
    # below the projection and parse the body anew for each mention of it.
    parsed = landed.select("*", F.explode(F.array(r)).alias("_r"))
    return parsed.withColumn("pull_status", classify(F.col("_r"), payload))


def settle_reloads(days: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Turn reload days into denied or pending.

    `answers` (user_id, status, and batch where known) are the server's replies. After one refusal
    nothing more is asked for that user, so it covers all of the user's unanswered days: of the
    same batch, if the replies tell theirs, else of the given days.
    """
    if answers is None:
        return days.withColumn("pull_status", F.when(F.col("pull_status") == RELOAD, PENDING)
                               .otherwise(F.col("pull_status")))
    on = ["user_id", *(["batch"] if "batch" in answers.columns else [])]
    refused = (answers.where(F.col("status") == "DENIED").select(*on).distinct()
               .withColumn("_refused", F.lit(True)))
    settled = F.when(F.col("pull_status") != RELOAD, F.col("pull_status")).when(
        F.col("_refused"), DENIED).otherwise(PENDING)
    return days.join(refused, on, "left").withColumn("pull_status", settled).drop("_refused")


def truncate_dates(df: DataFrame) -> DataFrame:
    """Dates for the columns stored as such; times of day are dropped after they were used.

    Unreadable text becomes null.
    """
    present = [c for c in ("query_date", "date_pulled", "start_gmt", "end_gmt") if c in df.columns]
    return df.withColumns({c: F.try_to_date(F.substring(F.col(c).cast("string"), 1, 10), "yyyy-MM-dd") for c in present})


def intraday_rows(days: DataFrame, name: str, markers: bool = False, keep_lost: bool = False) -> DataFrame:
    """Rows of the fetched days among `day_status` output.

    With `markers`, every given day also yields one row at its last microsecond (`is_marker`).
    Rows without a readable instant are left out unless `keep_lost`.
    """
    payload = intraday_payload(name)
    flat = isinstance(payload, FlatPayload)
    r = F.col("_r")
    # Positions are looked up once per body, not once per row.
    at = [] if flat else [descriptor_index(r[payload.descriptors], k, payload).alias(f"_ix{i}")
                          for i, k in enumerate(payload.mapping)]
    located = days.select("user_id", "query_date", "batch", "pull_status",
                          (r if flat else r[payload.values]).alias("_v"), *at)
    fetched = F.col("pull_status") == F.lit(FETCHED)
    if markers:
        no_row = F.get("_v", F.lit(-1))  # a null of the row type
        data = F.transform("_v", lambda x: F.struct(x.alias("row"), F.lit(False).alias("mark")))
        mark = F.array(F.struct(no_row.alias("row"), F.lit(True).alias("mark")))
        cells = F.when(fetched, F.concat(data, mark)).otherwise(mark)
        rows = located.select("*", F.posexplode(cells).alias("item", "_c"))
        row, is_marker = F.col("_c.row"), F.col("_c.mark")
    else:
        rows = located.where(fetched).select("*", F.posexplode("_v").alias("item", "_c"))
        row, is_marker = F.col("_c"), F.lit(False)
    named = [(row[k] if flat else F.get(row, F.col(f"_ix{i}"))).alias(c)
             for i, (k, c) in enumerate(payload.mapping.items())]
    instant = text_to_utc(payload.start) if flat else epoch_ms_to_utc("timestamp")
    out = (rows.select("user_id", "query_date", "batch", "item", "pull_status",
                       is_marker.alias("is_marker"), *named)
           .withColumn("date_time_utc", F.when(F.col("is_marker"), end_of_day("query_date"))
                       .otherwise(instant)))
    out = truncate_dates(out)
    if not keep_lost:
        out = out.where(F.col("date_time_utc").isNotNull())
    return out if markers else out.drop("is_marker")


def decode_intraday(landed: DataFrame, name: str, answers: DataFrame | None = None) -> DataFrame:
    """Data rows plus one end-of-day marker row per settled day, from a single parse.

    For days without data the marker is the stored placeholder. For fetched days it displaces an
    earlier placeholder under the same key and is itself not stored. Pending and unknown days
    give no rows, so they stay to be loaded.
    """
    days = settle_reloads(day_status(landed, name), answers)
    settled = days.where(F.col("pull_status").isin(FETCHED, NO_DATA, DENIED))
    return intraday_rows(settled, name, markers=True)


def intraday_batch(rows: DataFrame) -> DataFrame:
    """`decode_intraday` output to an upsert batch holding each (user, instant) once.

    A day has one outcome: fetched beats denied, denied beats no data, whatever the batches; then
    the newest batch counts. The marker of a fetched day is stored hidden, so that a placeholder
    that comes later finds it there.
    """
    rank = F.when(F.col("pull_status") == FETCHED, 3).when(F.col("pull_status") == DENIED, 2).otherwise(1)
    hidden = F.col("is_marker") & (F.col("pull_status") == FETCHED)
    rows = versioned(rows.withColumn("_hidden", hidden), rank).drop("batch", "item", "is_marker")
    return last_write(rows, ("user_id", "date_time_utc"), VERSION, keep=VERSION)


def quarantined(landed: DataFrame, name: str) -> DataFrame:
    """What decoding leaves out: (user_id, query_date, batch, place, reason), for keeping and counting.

    Reasons: `body` (unreadable text; place is null), `date` (an entry without a readable date) and
    `instant` (a row of a fetched day without a readable instant); place counts from 0.
    """
    bad = unreadable(landed).select("user_id", "query_date", "batch", F.lit(None).cast("int").alias("place"), F.lit("body").alias("reason"))
    if name in DAILY_PAYLOADS:
        p = DAILY_PAYLOADS[name]
        body = F.from_json("body", p.body)
        entries = landed.select("user_id", "query_date", "batch", F.posexplode(body[p.path] if p.path else body).alias("place", "_e"))
        lost = entries.where(F.try_to_date(F.col("_e")[p.date_field], "yyyy-MM-dd").isNull())
        reason = "date"
    else:
        p = intraday_payload(name)
        lost = intraday_rows(day_status(landed, name), name, keep_lost=True).where(F.col("date_time_utc").isNull()).withColumnRenamed("item", "place")
        reason = "instant"
    return bad.unionByName(lost.select("user_id", "query_date", "batch", "place", F.lit(reason).alias("reason")))
