"""Expected results of the registered queries as SQL over the same tables."""

from __future__ import annotations

from restwave.functions import smooth_name
from restwave.schemas import DAILY_PAYLOADS, INTRADAY_PAYLOADS, SERIES_VIEWS, FlatPayload

# Written out, not taken from the engine, so that a wrong constant there shows.
POUNDS_PER_GRAM = 0.00220462
BANDWIDTHS = (1, 7, 14, 21, 28, 35, 42, 49, 56, 63, 70, 77, 84, 91, 98, 105, 112, 119, 126, 133, 140, 147)
ROW_WIDTHS = (*BANDWIDTHS, 154, 161, 168, 175)
ZERO_IS_MISSING = ("body_fat", "bmi", "fat_mass")
SLEEP_DURATIONS = ("total_sleep_time", "rem_time", "deep_time", "light_time", "awake_time")
STRESS_DURATIONS = ("high_stress_duration", "low_stress_duration", "rest_stress_duration")
SMOOTHED = {
    "health_stats": ("weight", "bmi", "body_fat", "body_water", "bone_mass", "muscle_mass", "fat_mass"),
    "sleep": ("resting_hr", "sleep_score", "total_sleep_time", "rem_time", "deep_time", "light_time", "awake_time",
              "sleep_start_time", "sleep_end_time", "hrv_7d_average"),
    "steps": ("step_goal", "total_steps", "total_distance"),
    "stress": ("high_stress_duration", "low_stress_duration", "overall_stress_level", "rest_stress_duration"),
    "heart_rate": ("resting_hr", "wellness_max_avg_hr", "wellness_min_avg_hr"),
    "body_battery": ("low_body_battery", "high_body_battery"),
}
# metric, series, axis, axis label, legend
VIEWS = (
    ("health_stats", "weight", "default", "Weight (lb)", "Weight"),
    ("health_stats", "body_fat", "body_fat", "Body Fat %", "Body Fat"),
    ("heart_rate", "resting_hr", "default", "Heart Rate (bpm)", "Resting HR"),
    ("sleep", "deep_time", "default", "Time (hours)", "Deep Sleep"),
    ("sleep", "rem_time", "default", "Time (hours)", "REM Sleep"),
    ("sleep", "light_time", "default", "Time (hours)", "Light Sleep"),
    ("sleep", "awake_time", "default", "Time (hours)", "Awake Time"),
    ("sleep", "total_sleep_time", "default", "Time (hours)", "Total Sleep Time"),
    ("sleep", "sleep_score", "sleep_score", "Sleep Score", "Sleep Score"),
    ("steps", "total_steps", "default", "Total Steps", "Total Steps"),
    ("steps", "step_goal", "default", "Total Steps", "Step Goal"),
    ("steps", "total_distance", "distance", "Total Distance (m)", "Total Distance"),
)
SLEEP_COLUMNS = ("date", "resting_hr", "sleep_score", *SLEEP_DURATIONS, "sleep_start_time", "sleep_end_time", "hrv_7d_average")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FEW = (1, 7, 14)
STORED_UNTIL, INCOMING_FROM = "1999-06-30", "1999-01-01"

DAYS = "SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL"
# One row per user and day between the user's first and last day.
FILLED = f"""days AS ({DAYS}),
spans AS (SELECT user_id, min(date) AS a, max(date) AS b FROM days GROUP BY ALL),
cal AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans),
filled AS (SELECT c.user_id, c.date, d.value FROM cal c LEFT JOIN days d USING (user_id, date))"""
TYPE_DAYS = """tdays AS (SELECT user_id, event_type AS series, CAST(ts AS DATE) AS date, avg(value) AS value
FROM events GROUP BY ALL)"""


def _values(numbers) -> str:
    return "(VALUES " + ", ".join(f"({n})" for n in numbers) + ")"


def _row_frames(widths) -> str:
    parts = [f"""SELECT user_id, date, 'simple' AS kernel, {w} AS bandwidth, round(avg(value) OVER (
PARTITION BY user_id ORDER BY date ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING) + 3.31237e-9, 6) AS value
FROM filled""" for w in widths]
    return f"WITH {FILLED} " + " UNION ALL ".join(parts)


def _row_gaussian(widths) -> str:
    return f"""WITH {FILLED},
num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS r FROM filled),
ws AS (SELECT w, w // 2 AS back, (w - 1) // 2 AS fwd, w // 2 - (w - 1) / 2.0 AS c FROM {_values(widths)} t(w)),
terms AS (SELECT a.user_id, a.date, w, b.value AS y,
  exp(-0.5 * power((b.r - a.r + c) / (w / 2.0), 2)) AS k
  FROM num a CROSS JOIN ws LEFT JOIN num b
  ON a.user_id = b.user_id AND b.value IS NOT NULL AND b.r - a.r BETWEEN -back AND fwd)
SELECT user_id, date, 'gaussian' AS kernel, w AS bandwidth, round(sum(k * y) / sum(k) + 3.31237e-9, 6) AS value
FROM terms GROUP BY user_id, date, w"""


def _kernel(source: str, keys: str, kernel: str, bandwidths) -> str:
    weight, near = ("exp(-0.5 * power((b.date - a.date) / CAST(w AS DOUBLE), 2))", "true")
    if kernel == "boxcar":
        weight, near = "1.0", "abs(b.date - a.date) <= w // 2"
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    out = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {out}, a.date, '{kernel}' AS kernel, w AS bandwidth,
  sum({weight} * b.value) / nullif(sum(CASE WHEN b.value IS NOT NULL THEN {weight} END), 0) AS value
  FROM {source} a CROSS JOIN {_values(bandwidths)} t(w) LEFT JOIN {source} b
  ON {same} AND b.value IS NOT NULL AND {near}
  GROUP BY {out}, a.date, w"""


def _one_series(kernels, bandwidths) -> str:
    union = " UNION ALL ".join(_kernel("filled", "user_id", k, bandwidths) for k in kernels)
    return f"""WITH {FILLED}, s AS ({union})
SELECT user_id, 'events' AS metric, 'value' AS series, date, kernel, bandwidth, round(value + 3.31237e-9, 6) AS value FROM s"""


def _wide(low: int, high: int) -> str:
    cells = [f"round(max(CASE WHEN series = '{t}' AND bandwidth = {b} THEN value END) + 3.31237e-9, 6) "
             f"AS {smooth_name(t, 'boxcar', b)}" for t in EVENT_TYPES for b in FEW if low <= b <= high]
    return (f"WITH {TYPE_DAYS}, s AS ({_kernel('tdays', 'user_id, series', 'boxcar', FEW)}) "
            f"SELECT user_id, date, {', '.join(cells)} FROM s GROUP BY user_id, date")


def _stored(name: str) -> str:
    columns = list(DAILY_PAYLOADS[name].mapping.values())
    if name == "health_stats":
        columns.append("fat_mass")
    cells = {c: f"CAST(CAST(floor(value + {i}) AS BIGINT) % 50 AS DOUBLE)" for i, c in enumerate(columns)}
    return ", ".join(f"{e} AS {c}" for c, e in cells.items())


def _clean(name: str, exact: bool = False) -> str:
    """The cleaned table; `exact` leaves out the rounding for comparison."""
    def shown_value(e: str) -> str:
        return e if exact else f"round({e} + 3.31237e-9, 6)"

    base = f"stored AS (SELECT user_id, date, value AS v, {_stored(name)} FROM ({DAYS}))"
    columns = list(DAILY_PAYLOADS[name].mapping.values())
    if name == "health_stats":
        columns.append("fat_mass")

    def cell(c: str) -> str:
        if name == "health_stats" and c in ZERO_IS_MISSING:
            return f"nullif({c}, 0.0) AS {c}"
        if (name == "sleep" and c in SLEEP_DURATIONS) or (name == "stress" and c in STRESS_DURATIONS):
            return f"{shown_value(f'{c} / 3600.0')} AS {c}"
        if c == "sleep_start_time":
            return f"{shown_value('24.0 - floor(v) / 60.0')} AS {c}"
        if c == "sleep_end_time":
            return f"{shown_value('floor(v) / 60.0')} AS {c}"
        return c

    shown = SLEEP_COLUMNS[1:] if name == "sleep" else columns
    return f"WITH {base} SELECT user_id, date, {', '.join(cell(c) for c in shown)} FROM stored"


def _cleaned_series(names) -> str:
    """CTE `raw`: metric, user_id, date, series, value of (metric, column) pairs."""
    tables = ", ".join(f"c_{m} AS ({_clean(m, exact=True)})" for m in dict.fromkeys(m for m, _ in names))
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, user_id, date, '{c}' AS series, {c}::DOUBLE AS value FROM c_{m}" for m, c in names)
    return f"{tables}, raw AS ({rows})"


def _process_all() -> str:
    def cells(kernel: str) -> str:
        out = []
        for b in BANDWIDTHS:
            w = f"exp(-0.5 * power(d / {b}::DOUBLE, 2))" if kernel == "gaussian" else f"CASE WHEN abs(d) <= {b // 2} THEN 1.0::DOUBLE END"
            out.append(f"round(sum({w} * y) / nullif(sum({w}), 0) + 3.31237e-9, 6) AS b{b}")
        return ", ".join(out)

    parts = " UNION ALL ".join(f"SELECT user_id, metric, series, date, '{k}' AS kernel, {cells(k)} FROM p GROUP BY user_id, metric, series, date"
                               for k in ("gaussian", "boxcar"))
    return f"""WITH {_cleaned_series([(m, c) for m, cs in SMOOTHED.items() for c in cs])},
p AS (SELECT a.user_id, a.metric, a.series, a.date, b.date - a.date AS d, b.value AS y FROM raw a LEFT JOIN raw b
  ON a.user_id = b.user_id AND a.metric = b.metric AND a.series = b.series AND b.value IS NOT NULL)
{parts}"""


def _publish_series() -> str:
    labels = ", ".join("(" + ", ".join(f"'{x}'" for x in v) + ")" for v in VIEWS)
    kernels = " UNION ALL ".join(_kernel("early", "user_id, metric, series", k, (7, 14)) for k in ("gaussian", "boxcar"))
    return f"""WITH {_cleaned_series([v[:2] for v in VIEWS])},
early AS (SELECT * FROM raw WHERE date < DATE '2024-01-25'), s AS ({kernels}),
labels(metric, series, axis, axis_label, legend) AS (VALUES {labels})
SELECT raw.user_id, metric, series, raw.date, round(raw.value + 3.31237e-9, 6) AS value, axis, axis_label, legend,
  s.kernel, s.bandwidth, round(s.value + 3.31237e-9, 6) AS smooth, coalesce(s.kernel = 'gaussian' AND s.bandwidth = 14, false) AS is_default
FROM raw JOIN labels USING (metric, series) LEFT JOIN s USING (user_id, metric, series, date)"""


def _workout(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""WITH s AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'BENCH_PRESS' ELSE l_returnflag END AS ex,
  l_extendedprice / 1000.0 AS w0, CAST(l_quantity AS INTEGER) AS reps FROM lineitem),
c AS (SELECT *, CASE WHEN ex = 'BENCH_PRESS' AND w0 < 66 THEN 2.0 * w0 ELSE w0 END AS w FROM s),
g AS (SELECT {lead}ex AS Exercise, max(w) AS MaxWeight, CAST(sum(reps) AS BIGINT) AS TotalReps,
  avg(reps) AS AvgReps, coalesce(sum(w * reps), 0.0) AS TotalWeightReps,
  max(w / (1.0278::DOUBLE - 0.0278::DOUBLE * reps)) AS Max1RM FROM c GROUP BY ALL),
h AS (SELECT *, TotalWeightReps / TotalReps AS AvgWeightPerRep FROM g)
SELECT {lead}Exercise, round(MaxWeight + 3.31237e-6, 3) AS MaxWeight, TotalReps, round(AvgReps + 3.31237e-6, 3) AS AvgReps,
  round(TotalWeightReps + 3.31237e-6, 3) AS TotalWeightReps, round(Max1RM + 3.31237e-6, 3) AS Max1RM,
  round(AvgWeightPerRep + 3.31237e-6, 3) AS AvgWeightPerRep,
  round(AvgWeightPerRep / (1.0278::DOUBLE - 0.0278::DOUBLE * AvgReps) + 3.31237e-6, 3) AS Avg1RM FROM h"""


def _ingest_daily(name: str) -> str:
    p = DAILY_PAYLOADS[name]
    if p.weigh_ins:
        pounds = {"weight", "muscle_mass", "bone_mass"}
        at = {c: i for i, c in enumerate(p.mapping.values())}
        expr = {c: f"(value + {i})" + (f" * {POUNDS_PER_GRAM}::DOUBLE" if c in pounds else "") for c, i in at.items()}
        cells = ", ".join(f"round({e} + 3.31237e-9, 6) AS {c}" for c, e in expr.items())
        return (f"WITH {FILLED} SELECT user_id, date, {cells}, "
                f"round({expr['body_fat']} * {expr['weight']} / 100.0 + 3.31237e-9, 6) AS fat_mass FROM filled")
    cells = ", ".join(f"t AS {c}" if k in p.text else f"round(v + {i} + 3.31237e-9, 6) AS {c}"
                      for i, (k, c) in enumerate(p.mapping.items()))
    return f"""WITH last AS (SELECT user_id, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS v,
  arg_max(event_type, event_id) AS t FROM events GROUP BY ALL) SELECT user_id, date, {cells} FROM last"""


def _ingest_intraday(name: str) -> str:
    p = INTRADAY_PAYLOADS[name]
    head = """SELECT user_id, CAST(ts AS DATE) AS query_date, 'fetched' AS pull_status,
  date_trunc('millisecond', ts) AS date_time_utc, """
    if isinstance(p, FlatPayload):
        fixed = {"startGMT": "CAST(ts AS DATE)", "endGMT": "CAST(ts AS DATE)",
                 "primaryActivityLevel": "event_type", "activityLevelConstant": "'true'"}
        cells = [f"{fixed.get(k, f'round(value + {i} + 3.31237e-9, 6)')} AS {c}" for i, (k, c) in enumerate(p.mapping.items())]
    else:
        cells = ["CAST(epoch_us(ts) // 1000 AS DOUBLE) AS timestamp" if k == "timestamp" else f"round(value + {i} + 3.31237e-9, 6) AS {c}"
                 for i, (k, c) in enumerate(p.mapping.items())]
    return head + ", ".join(cells) + " FROM events"


EVENT_DAYS = "ed AS (SELECT user_id, CAST(ts AS DATE) AS query_date, " + ", ".join(
    f"bool_or(event_type = '{k}') AS {k}" for k in EVENT_TYPES) + """,
  max(value) AS top, max(ts) AS last FROM events GROUP BY ALL)"""
REFUSED = "ref AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 100)"
LOAD_STATUS = f"""{EVENT_DAYS}, {REFUSED},
st AS (SELECT user_id, query_date, last, top, CASE
  WHEN NOT purchase AND NOT view THEN 'no_data'
  WHEN NOT purchase THEN CASE WHEN user_id IN (SELECT user_id FROM ref) THEN 'denied' ELSE 'pending' END
  WHEN click THEN 'fetched' ELSE 'no_data' END AS pull_status FROM ed)"""
DAY_STATES = f"""{EVENT_DAYS}, ds AS (SELECT user_id, query_date, CASE WHEN purchase THEN 'fetched'
  WHEN error THEN 'denied' WHEN click THEN 'no_data' ELSE 'pending' END AS status FROM ed)"""
END_OF_DAY = "CAST(query_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND"
LAST_STEPS = """WITH last AS (SELECT user_id, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS v FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS user_id, date, round(v + 3.31237e-9, 6) AS step_goal, round(v + 1 + 3.31237e-9, 6) AS total_steps,
  round(v + 2 + 3.31237e-9, 6) AS total_distance, DATE '2024-01-31' AS date_pulled{} FROM last"""
CALENDAR = """cal AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT user_id FROM events), (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events))"""
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS date, o_orderpriority"


def _series(metric: str) -> str:
    views = SERIES_VIEWS[metric]
    rows = " UNION ALL ".join(
        f"SELECT user_id, date, '{v.series}' AS series, '{v.axis}' AS axis, '{v.axis_label}' AS axis_label, "
        f"'{v.legend}' AS legend, value + {i} AS value FROM filled" for i, v in enumerate(views))
    return f"""WITH {FILLED}, raw AS ({rows}), s AS ({_kernel('raw', 'user_id, series', 'gaussian', (14,))})
SELECT raw.user_id, raw.series, raw.date, round(raw.value + 3.31237e-9, 6) AS value, axis, axis_label, legend,
  s.kernel, s.bandwidth, round(s.value + 3.31237e-9, 6) AS smooth, true AS is_default
FROM raw JOIN s USING (user_id, series, date)"""


def statements() -> dict[str, str]:
    out = {
        "daily_mean_calendar": f"WITH {FILLED} SELECT user_id, date, round(value + 3.31237e-9, 6) AS value FROM filled",
        "distinct_dates": "SELECT DISTINCT event_type, CAST(ts AS DATE) AS date FROM events ORDER BY ALL",
        "date_calendar": f"WITH {CALENDAR} SELECT * FROM cal",
        "range_chunks": """WITH s AS (SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS a,
  max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY ALL),
c AS (SELECT o_orderpriority, b, CAST(unnest(generate_series(a, b, INTERVAL 28 DAY)) AS DATE) AS chunk_start FROM s)
SELECT o_orderpriority, chunk_start, least(chunk_start + 27, b) AS chunk_end FROM c""",
        "sma_centered": _row_frames((7, 14)),
        "sma_all_widths": _row_frames(ROW_WIDTHS),
        "gaussian_rows": _row_gaussian((7,)),
        "gaussian_rows_all_widths": _row_gaussian(ROW_WIDTHS),
        "kernel_gaussian": _one_series(["gaussian"], FEW),
        "kernel_boxcar": _one_series(["boxcar"], FEW),
        "kernel_all_bandwidths": _one_series(["gaussian", "boxcar"], BANDWIDTHS),
        "kernel_many_series": f"""WITH {TYPE_DAYS}, s AS (
{_kernel('tdays', 'user_id, series', 'gaussian', (7, 14))} UNION ALL
{_kernel('tdays', 'user_id, series', 'boxcar', (7, 14))})
SELECT user_id, 'events' AS metric, series, date, kernel, bandwidth, round(value + 3.31237e-9, 6) AS value FROM s""",
        "kernel_repeated_dates": f"""WITH s0 AS (SELECT user_id, CAST(ts AS DATE) AS date, value FROM events),
s AS ({_kernel('s0', 'user_id', 'gaussian', (1, 7))} UNION ALL {_kernel('s0', 'user_id', 'boxcar', (1, 7))})
SELECT s0.user_id, 'events' AS metric, 'value' AS series, s0.date, kernel, bandwidth, round(s.value + 3.31237e-9, 6) AS value
FROM s0 JOIN s USING (user_id, date)""",
        "band_pairs": f"""WITH d AS ({DAYS}) SELECT a.user_id, a.date, count(*) AS n, round(sum(b.value) + 3.31237e-9, 6) AS near_sum
FROM d a JOIN d b ON a.user_id = b.user_id AND b.date - a.date BETWEEN -2 AND 3 GROUP BY a.user_id, a.date""",
        "align_to_dates": f"""WITH d AS ({DAYS}) SELECT a.user_id, a.date, round(avg(b.value) + 3.31237e-9, 6) AS smooth
FROM d a JOIN d b ON a.user_id = b.user_id AND abs(b.date - a.date) <= 3 GROUP BY a.user_id, a.date""",
        "smooth_wide": _wide(0, 999),
        "smooth_trim": _wide(2, 13),
        "smooth_trim_long": f"""WITH {TYPE_DAYS}, s AS ({_kernel('tdays', 'user_id, series', 'boxcar', (7, 14))})
SELECT user_id, 'events' AS metric, series, date, kernel, bandwidth, round(value + 3.31237e-9, 6) AS value FROM s""",
        "zero_to_null_units": f"""SELECT l_orderkey, l_linenumber, round(nullif(l_discount, 0.0) + 3.31237e-9, 6) AS discount,
  round(nullif(l_tax, 0.0) + 3.31237e-9, 6) AS tax, round(l_quantity / 3600.0 + 3.31237e-9, 6) AS hours,
  round(l_extendedprice * {POUNDS_PER_GRAM}::DOUBLE + 3.31237e-9, 6) AS pounds,
  round(l_discount * (l_extendedprice * {POUNDS_PER_GRAM}::DOUBLE) / 100.0 + 3.31237e-9, 6) AS fat FROM lineitem""",
        "sleep_clock_hours": """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS date,
  epoch_us(ts) // 1000 - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000 AS ms FROM events)
SELECT event_id, date, round(ms / 3600000.0::DOUBLE + 24.0 + 3.31237e-9, 6) AS sleep_start_time,
  round((ms + 28800000) / 3600000.0::DOUBLE + 3.31237e-9, 6) AS sleep_end_time FROM e""",
        "workout_agg": _workout(),
        "workout_agg_by": _workout("l_suppkey"),
        "json_fields": """SELECT event_id, CAST(ts AS DATE) AS date, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(json_extract(props, '$.missing') AS DOUBLE) AS missing FROM events""",
        "load_status": f"WITH {LOAD_STATUS} SELECT user_id, query_date, pull_status FROM st",
        "load_rows": f"""WITH {LOAD_STATUS}
SELECT user_id, query_date, date_trunc('millisecond', last) AS date_time_utc, round(top + 3.31237e-9, 6) AS hr, pull_status,
  false AS is_marker FROM st WHERE pull_status = 'fetched'
UNION ALL SELECT user_id, query_date, {END_OF_DAY}, NULL, pull_status, true FROM st WHERE pull_status <> 'pending'""",
        "load_status_flat": f"""WITH {EVENT_DAYS} SELECT user_id, query_date, CASE WHEN NOT error THEN 'no_data'
  WHEN purchase OR top = 0 THEN 'pending' ELSE 'fetched' END AS pull_status FROM ed""",
        "all_zero_days": """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS query_date,
  bool_and(coalesce(l_discount = 0, false)) AS all_zero FROM lineitem GROUP BY ALL""",
        "status_lookup": f"""WITH {DAY_STATES} SELECT event_id,
  CASE WHEN status = 'pending' THEN 'unknown' ELSE status END AS pull_status
FROM events e JOIN ds ON e.user_id = ds.user_id AND CAST(e.ts AS DATE) = ds.query_date""",
        "status_tally": f"""WITH {DAY_STATES} SELECT user_id, status, count(*) AS n,
  string_agg(CAST(query_date AS VARCHAR), ',' ORDER BY query_date) AS dates FROM ds GROUP BY ALL""",
        "empty_dates": f"WITH {DAY_STATES} SELECT user_id, query_date FROM ds WHERE status IN ('no_data', 'denied')",
        "placeholders": f"""WITH {DAY_STATES} SELECT user_id, CAST(ts AS DATE) AS query_date, ts AS date_time_utc,
  round(value + 3.31237e-9, 6) AS value, 'fetched' AS pull_status FROM events WHERE event_type = 'purchase'
UNION ALL SELECT user_id, query_date, {END_OF_DAY}, NULL, status FROM ds WHERE status IN ('no_data', 'denied')""",
        "watermark": "SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY ALL",
        "missing_dates": f"""WITH {DAY_STATES}, {CALENDAR} SELECT user_id, date AS query_date FROM cal
WHERE NOT EXISTS (SELECT 1 FROM ds WHERE ds.user_id = cal.user_id AND ds.query_date = cal.date
  AND status IN ('fetched', 'no_data'))""",
        "last_write_wins": """SELECT o_custkey, CAST(o_orderdate AS DATE) AS date,
  round(arg_max(o_totalprice, o_orderkey) + 3.31237e-9, 6) AS o_totalprice, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority,
  arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL""",
        "upsert_daily": f"""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS date FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, date ORDER BY o_orderkey DESC) AS rn FROM o),
e AS (SELECT * FROM r WHERE rn = 1 AND date <= DATE '{STORED_UNTIL}'),
n AS (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * 2.0 END AS price
  FROM r WHERE rn = 1 AND date >= DATE '{INCOMING_FROM}')
SELECT coalesce(n.o_custkey, e.o_custkey) AS o_custkey, coalesce(n.date, e.date) AS date,
  round(CASE WHEN n.date IS NOT NULL THEN n.price ELSE e.o_totalprice END + 3.31237e-9, 6) AS o_totalprice,
  e.o_orderpriority AS o_orderpriority,
  CASE WHEN n.date IS NOT NULL THEN n.o_orderstatus ELSE e.o_orderstatus END AS o_orderstatus
FROM e FULL JOIN n ON e.o_custkey = n.o_custkey AND e.date = n.date""",
        "upsert_intraday": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn
  FROM events),
e AS (SELECT * FROM r WHERE rn = 1 AND ts < TIMESTAMP '2024-01-20'),
n AS (SELECT * FROM r WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-15')
SELECT coalesce(n.user_id, e.user_id) AS user_id, coalesce(n.ts, e.ts) AS date_time_utc,
  round(CASE WHEN n.ts IS NOT NULL THEN n.value * 2.0 ELSE e.value END + 3.31237e-9, 6) AS value, e.event_type AS event_type
FROM e FULL JOIN n ON e.user_id = n.user_id AND e.ts = n.ts""",
        "load_daily": LAST_STEPS.format(""),
        "load_weight_calendar": _ingest_daily("health_stats").replace("SELECT user_id, date, round", "SELECT CAST(user_id AS VARCHAR) AS user_id, date, round"),
        "load_intraday": f"""WITH {LOAD_STATUS}, out AS (SELECT *, CASE WHEN pull_status IN ('fetched', 'denied') THEN pull_status ELSE 'no_data' END AS s FROM st)
SELECT CAST(user_id AS VARCHAR) AS user_id, query_date, CASE WHEN s = 'fetched' THEN date_trunc('millisecond', last) ELSE {END_OF_DAY} END AS date_time_utc,
  CASE WHEN s = 'fetched' THEN round(top + 3.31237e-9, 6) END AS hr, s AS pull_status FROM out""",
        "load_incremental": LAST_STEPS.format(""),
        "stream_load": LAST_STEPS.format(", CAST(0 AS BIGINT) AS n_lost"),
        "load_incremental_days": f"""WITH {LOAD_STATUS}
SELECT CAST(user_id AS VARCHAR) AS user_id, query_date, CASE WHEN pull_status = 'no_data' THEN {END_OF_DAY} ELSE date_trunc('millisecond', last) END AS date_time_utc,
  CASE pull_status WHEN 'no_data' THEN NULL WHEN 'fetched' THEN round(top + 3.31237e-9, 6) ELSE round(top + 1000.0 + 3.31237e-9, 6) END AS hr,
  CASE WHEN pull_status = 'no_data' THEN 'no_data' ELSE 'fetched' END AS pull_status FROM st""",
        "landed_files": """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS date, least((day(ts) - 1) // 10, 2) AS third FROM events),
f AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(date_trunc('month', date) AS DATE) + CAST(third * 10 AS INTEGER) AS query_date, third, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, 'steps' AS metric, query_date, CAST(third + 1 AS BIGINT) AS batch, CAST(CASE WHEN third < 2 THEN 1 ELSE 2 END AS BIGINT) AS arrival,
  user_id || '_' || CAST(query_date AS VARCHAR) || '.json' AS file, CAST(n AS INTEGER) AS n_entries FROM f""",
        "table_snapshots": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS activityId, CAST(o_orderdate AS DATE) AS date,
  o_orderkey % 2 = 0 AS twice, o_totalprice AS price FROM orders)
SELECT 1 AS version, user_id, activityId, date, round(price + 3.31237e-9, 6) AS distance FROM o WHERE date < DATE '1999-01-01'
UNION ALL SELECT 2, user_id, activityId, date, round(price + 3.31237e-9, 6) FROM o
UNION ALL SELECT 3, user_id, activityId, date, round(CASE WHEN twice THEN price * 2.0 ELSE price END + 3.31237e-9, 6) FROM o""",
        "quarantined_rows": """SELECT user_id, CAST(ts AS DATE) AS query_date, event_id AS batch,
  CASE WHEN event_type <> 'error' THEN 1 END AS place, CASE WHEN event_type = 'error' THEN 'body' ELSE 'instant' END AS reason FROM events""",
        "table_append_update": """SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS activityId, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderdate < DATE '1999-01-01' THEN round(o_totalprice + 3.31237e-9, 6) END AS distance,
  CASE WHEN o_orderdate >= DATE '1998-10-03' THEN round(o_totalprice * 2.0 + 3.31237e-9, 6) END AS calories,
  CASE WHEN o_orderdate < DATE '1999-01-01' THEN false END AS detailsPulled FROM orders""",
        "stored_row_means": f"""SELECT *, 'value' AS series FROM ({_row_frames((7, 14))}) UNION ALL SELECT *, 'value' FROM ({_row_gaussian((7, 14))})""",
        "process_all": _process_all(),
        "publish_series": _publish_series(),
        "smooth_incremental": f"""WITH {TYPE_DAYS}, s AS ({_kernel('tdays', 'user_id, series', 'boxcar', FEW)} UNION ALL
{_kernel('tdays', 'user_id, series', 'gaussian', (1,))})
SELECT user_id, 'events' AS metric, series, date, kernel, bandwidth, round(value + 3.31237e-9, 6) AS value FROM s""",
        "topk_recent": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice + 3.31237e-9, 6) AS o_totalprice
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
        "activity_list": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S.%f') DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events)
SELECT user_id, CAST(event_id AS VARCHAR) AS activityId, event_type AS activityType,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS startTime, round(value + 3.31237e-9, 6) AS distance, false AS detailsPulled
FROM r WHERE rn <= 10""",
        "strength_sets": """SELECT CAST(l_orderkey AS VARCHAR) AS activityId, 'ACTIVE' AS setType,
  l_returnflag AS exerciseName, CAST(l_quantity AS INTEGER) AS reps, CAST(l_partkey AS INTEGER) AS weight,
  round(l_discount + 3.31237e-9, 6) AS duration FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'REST', NULL, NULL, NULL, round(l_tax + 3.31237e-9, 6) FROM lineitem""",
        "type_split": """SELECT event_id, user_id, round(value + 3.31237e-9, 6) AS value FROM events
WHERE event_type = 'purchase'""",
        "dq_unique": """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL
HAVING count(*) > 1""",
        "dq_not_null": """WITH e AS (SELECT event_id, nullif(CAST(json_extract(props, '$.k') AS BIGINT), 50) IS NULL AS k,
  value < 5 AS v FROM events)
SELECT event_id, concat_ws(',', CASE WHEN k THEN 'k' END, CASE WHEN v THEN 'v' END) AS missing FROM e WHERE k OR v""",
        "unreadable_bodies": """SELECT 'events' AS source, event_id AS key FROM events WHERE NOT json_valid(props)
UNION ALL SELECT 'documents', doc_id FROM documents WHERE NOT json_valid(text)""",
        "io_roundtrip_parquet": f"SELECT {ORDER_COLUMNS} FROM orders",
        "io_roundtrip_csv": f"SELECT {ORDER_COLUMNS} FROM orders",
        "io_union": f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderdate < DATE '{INCOMING_FROM}' THEN o_orderpriority END AS o_orderpriority FROM orders""",
        "sorted_export": f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
  row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) NULLS FIRST, o_orderkey NULLS FIRST) - 1 AS row FROM orders)
SELECT *, true AS in_bounds, 'all' AS part FROM x
UNION ALL SELECT *, true, 'between' FROM x WHERE date BETWEEN DATE '{INCOMING_FROM}' AND DATE '{STORED_UNTIL}'""",
    }
    out |= {f"clean_{n}": _clean(n) for n in DAILY_PAYLOADS}
    out |= {f"ingest_{n}": _ingest_daily(n) for n in DAILY_PAYLOADS}
    out |= {f"ingest_{n}": _ingest_intraday(n) for n in INTRADAY_PAYLOADS}
    out |= {f"series_{m}": _series(m) for m in SERIES_VIEWS}
    return out
