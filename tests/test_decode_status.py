import datetime as dt
import json

import pytest

from restwave.operators import activities, decode, status
from restwave.operators.upsert import last_write, upsert
from restwave.schemas import DAILY_PAYLOADS, INTRADAY_PAYLOADS
from restwave.sources.landing import LANDED
from pyspark.sql import functions as F

D = dt.date
UTC = dt.timezone.utc


def landed(spark, metric, *bodies, day=D(2024, 1, 1), user="a"):
    """Bodies as batches 1, 2, ...; a (day, body) pair or (day, batch, body) overrides the defaults."""
    rows = []
    for i, b in enumerate(bodies):
        when, batch, body = (b if len(b) == 3 else (b[0], i + 1, b[1])) if isinstance(b, tuple) else (day, i + 1, b)
        rows.append((user, metric, when, batch, body if isinstance(body, str) or body is None else json.dumps(body)))
    return spark.createDataFrame(rows, LANDED)


def utc(df, c="date_time_utc"):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def test_entries_as_object_list_self_or_absent(spark):
    steps = lambda v: {"calendarDate": "2024-01-01", **v}
    body = {"values": [steps({"values": {"stepGoal": 10, "totalSteps": 7}}),
                       {"calendarDate": "2024-01-02", "values": [{"totalSteps": 1}, {"totalSteps": 2}]},
                       {"calendarDate": "2024-01-03", "totalSteps": 3, "totalDistance": 2.5},
                       {"calendarDate": "2024-01-04", "values": []},
                       {"calendarDate": "not a date", "values": {"totalSteps": 9}}]}
    out = decode.decode_daily(landed(spark, "steps", body, "null", {}, {"values": None}, {"values": []}, "junk{"), "steps")
    got = sorted((r.date.day, r.step_goal, r.total_steps, r.total_distance) for r in out.collect()
                 if r.total_steps is not None)
    assert got == [(1, 10.0, 7.0, None), (2, None, 1.0, None), (2, None, 2.0, None), (3, None, 3.0, 2.5)]
    assert out.count() == 4
    day2 = decode.daily_batch(out, "steps").where("date = '2024-01-02'").first()
    assert day2.total_steps == 2.0  # later items of one body win


def test_mixed_shapes_in_one_body(spark):
    entry = lambda d, **v: {"calendarDate": f"2024-01-{d:02d}", **v}
    body = [entry(1, values={"restingHR": 50}), entry(2, values=[{"restingHR": 51}, {"restingHR": 52}]),
            entry(3, restingHR=53), entry(4, values=[{"restingHR": 54}], restingHR=99), entry(5, values={}),
            entry(6, values={"restingHR": "high", "wellnessMaxAvgHR": 90})]
    plain = [entry(7, values={"restingHR": 57}), entry(8, values={"restingHR": 58})]
    for name, bodies in (("heart_rate", (body, plain)),):
        rows = decode.decode_daily(landed(spark, name, *bodies), name).collect()
        assert sorted((r.date.day, r.item, r.resting_hr, r.wellness_max_avg_hr) for r in rows) == [
            (1, 0, 50.0, None), (2, 0, 51.0, None), (2, 1, 52.0, None), (3, 0, 53.0, None), (4, 0, 54.0, None),
            (5, 0, None, None), (6, 0, None, 90.0), (7, 0, 57.0, None), (8, 0, 58.0, None)]
    scale = {"dailyWeightSummaries": [{"summaryDate": "2024-01-01", "allWeightMetrics": {"weight": 7.0}},
                                      {"summaryDate": "2024-01-02", "weight": 8.0}]}
    rows = decode.decode_daily(landed(spark, "health_stats", scale), "health_stats").collect()
    assert sorted((r.date.day, r.weight) for r in rows) == [(1, 7.0), (2, 8.0)]


@pytest.mark.parametrize("name", list(DAILY_PAYLOADS))
def test_every_daily_metric_maps_every_column(spark, name):
    p = DAILY_PAYLOADS[name]
    values = {k: ("GOOD" if k in p.text else float(i)) for i, k in enumerate(p.mapping)}
    entry = {p.date_field: "2024-03-01", p.values_field: [values] if p.weigh_ins else values}
    body = {p.path: [entry]} if p.path else [entry]
    out = decode.decode_daily(landed(spark, name, body), name).first()
    for i, (k, c) in enumerate(p.mapping.items()):
        assert out[c] == ("GOOD" if k in p.text else float(i))
    assert out.date == D(2024, 3, 1)


def test_weigh_ins(spark):
    day = lambda d, *w: {"summaryDate": d, "allWeightMetrics": [{"weight": x, "bodyFat": f} for x, f in w]}
    first = {"dailyWeightSummaries": [day("2024-01-01", (1000.0, 10.0)), day("2024-01-03", (5000.0, 20.0))]}
    second = {"dailyWeightSummaries": [day("2024-01-01", (70000.0, 20.0), (80000.0, None))]}
    out = decode.daily_batch(decode.decode_daily(landed(spark, "health_stats", first, second), "health_stats"),
                             "health_stats")
    got = {r.date.day: r for r in out.collect()}
    assert set(got) == {1, 2, 3}
    pounds = 75000.0 * 0.00220462
    assert got[1].weight == pytest.approx(pounds) and got[1].fat_mass == pytest.approx(20.0 * pounds / 100)
    assert got[2].weight is None and got[2].fat_mass is None
    assert got[3].weight == pytest.approx(5000.0 * 0.00220462)


def descriptor_body(name, rows, reverse=False, **extra):
    p = INTRADAY_PAYLOADS[name]
    keys = list(p.mapping)
    order = list(reversed(keys)) if reverse else keys
    desc = [{p.key_field: k, p.index_field: order.index(k)} for k in keys]
    return {p.available: 50, p.descriptors: desc,
            p.values: [[r[keys.index(k)] for k in order] for r in rows], **extra}


@pytest.mark.parametrize("name", [n for n in INTRADAY_PAYLOADS if n != "steps_detailed"])
@pytest.mark.parametrize("reverse", [False, True])
def test_descriptor_decode(spark, name, reverse):
    p = INTRADAY_PAYLOADS[name]
    rows = [[1704067200000, *range(1, len(p.mapping))], [1704067260500, *[None] * (len(p.mapping) - 1)]]
    days = decode.day_status(landed(spark, name, descriptor_body(name, rows, reverse)), name)
    out = utc(decode.intraday_rows(days, name)).orderBy("date_time_utc").collect()
    assert [r.date_time_utc for r in out] == ["2024-01-01 00:00:00.000000", "2024-01-01 00:01:00.500000"]
    for i, c in enumerate(p.mapping.values()):
        assert [r[c] for r in out] == [rows[0][i], rows[1][i]]
    assert {(r.query_date, r.pull_status) for r in out} == {(D(2024, 1, 1), "fetched")}


def test_flat_decode(spark):
    item = {"startGMT": "2024-01-01T23:45:00.0", "endGMT": "2024-01-02T00:00:00.0", "steps": 12, "pushes": 0,
            "primaryActivityLevel": "active", "activityLevelConstant": True}
    days = decode.day_status(landed(spark, "steps_detailed", [item, {**item, "startGMT": "bad", "steps": 0}]),
                             "steps_detailed")
    out = utc(decode.intraday_rows(days, "steps_detailed")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.date_time_utc, r.start_gmt, r.end_gmt) == ("2024-01-01 23:45:00.000000", D(2024, 1, 1), D(2024, 1, 2))
    assert (r.steps, r.pushes, r.primary_activity_level, r.activity_level_constant) == (12.0, 0.0, "active", "true")


def test_day_status(spark):
    name = "heart_rate_detailed"
    p = INTRADAY_PAYLOADS[name]
    bodies = [{}, {p.available: None, p.descriptors: None}, {p.available: 50}, {p.available: 50, p.descriptors: []},
              descriptor_body(name, []), descriptor_body(name, [[1, 2]]), "null", "broken{", None]
    days = decode.day_status(landed(spark, name, *bodies), name)
    got = {r.batch: r.pull_status for r in days.collect()}
    assert [got[i + 1] for i in range(9)] == [
        "no_data", "no_data", "reload", "reload", "no_data", "fetched", "unknown", "unknown", "unknown"]
    flat = decode.day_status(landed(spark, "steps_detailed", [], [{"steps": 0}, {"steps": 0}], [{"steps": 0}, {"steps": 1}],
                                    [{"steps": None}], "null", "x["), "steps_detailed")
    got = {r.batch: r.pull_status for r in flat.collect()}
    assert [got[i + 1] for i in range(6)] == ["no_data", "reload", "fetched", "fetched", "unknown", "unknown"]
    with pytest.raises(ValueError):
        decode.day_status(flat, "weather")
    with pytest.raises(ValueError):
        decode.decode_daily(flat, "weather")


def test_reloads_and_markers(spark, make):
    name = "heart_rate_detailed"
    p = INTRADAY_PAYLOADS[name]
    days = landed(spark, name, (D(2024, 1, 1), {p.available: 50}), (D(2024, 1, 2), {}),
                  (D(2024, 1, 3), descriptor_body(name, [[1704240000000, 60]])), (D(2024, 1, 4), "null"))
    refused = make("user_id string, status string", ("a", "DENIED"), ("b", "OK"))
    accepted = make("user_id string, status string", ("a", "OK"))
    for answers, first in ((refused, "denied"), (accepted, "pending"), (None, "pending")):
        s = decode.settle_reloads(decode.day_status(days, name), answers)
        assert {r.query_date.day: r.pull_status for r in s.collect()} == {
            1: first, 2: "no_data", 3: "fetched", 4: "unknown"}
    rows = utc(decode.decode_intraday(days, name, refused)).collect()
    assert sorted((r.date_time_utc, r.pull_status, r.hr, r.is_marker) for r in rows) == [
        ("2024-01-01 23:59:59.999999", "denied", None, True), ("2024-01-02 23:59:59.999999", "no_data", None, True),
        ("2024-01-03 00:00:00.000000", "fetched", 60.0, False), ("2024-01-03 23:59:59.999999", "fetched", None, True)]


@pytest.mark.parametrize("name", list(INTRADAY_PAYLOADS))
def test_each_body_is_parsed_once(spark, name, tmp_path):
    landed(spark, name, "{}").write.parquet(f"file:{tmp_path}/landed")
    stored = spark.read.parquet(f"file:{tmp_path}/landed")
    for df in (decode.decode_intraday(stored, name), decode.intraday_rows(decode.day_status(stored, name), name)):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


def test_placeholder_operators(make):
    st = make("user_id string, query_date date, status string", ("a", D(2024, 1, 1), "no_data"),
              ("a", D(2024, 1, 2), "denied"), ("a", D(2024, 1, 3), "fetched"), ("a", D(2024, 1, 5), "denied"))
    data = make("user_id string, query_date date, date_time_utc timestamp, hr double, pull_status string",
                ("a", D(2024, 1, 3), dt.datetime(2024, 1, 3, 1, tzinfo=UTC), 60.0, "fetched"),
                ("a", D(2024, 1, 5), dt.datetime(2024, 1, 5, 1, tzinfo=UTC), 61.0, "denied"))
    out = utc(status.with_placeholders(data, st)).orderBy("date_time_utc").collect()
    assert [(r.date_time_utc, r.hr, r.pull_status) for r in out] == [
        ("2024-01-01 23:59:59.999999", None, "no_data"), ("2024-01-02 23:59:59.999999", None, "denied"),
        ("2024-01-03 01:00:00.000000", 60.0, "fetched"), ("2024-01-05 01:00:00.000000", 61.0, "denied")]
    rows = make("user_id string, query_date date", ("a", D(2024, 1, 3)), ("a", D(2024, 1, 9)))
    assert sorted(r.pull_status for r in status.with_status(rows, st).collect()) == ["fetched", "unknown"]
    assert sorted(r.query_date.day for r in status.empty_dates(st).collect()) == [1, 2, 5]
    tally = {r.status: (r.n, [d.day for d in r.dates]) for r in status.status_tally(st).collect()}
    assert tally == {"no_data": (1, [1]), "denied": (2, [2, 5]), "fetched": (1, [3])}


def test_dates_to_load(make):
    cal = make("user_id string, query_date date", *[("a", D(2024, 1, i)) for i in range(1, 6)])
    st = make("user_id string, query_date date, pull_status string", ("a", D(2024, 1, 1), "fetched"),
              ("a", D(2024, 1, 2), "no_data"), ("a", D(2024, 1, 3), "denied"), ("a", D(2024, 1, 4), "denied"),
              ("a", D(2024, 1, 4), "fetched"), ("a", D(2024, 1, 5), None))
    assert sorted(r.query_date.day for r in status.dates_to_load(cal, st).collect()) == [3, 5]
    zero = make("user_id string, query_date date, steps double", ("a", D(2024, 1, 1), 0.0), ("a", D(2024, 1, 1), 0.0),
                ("a", D(2024, 1, 2), 0.0), ("a", D(2024, 1, 2), None), ("a", D(2024, 1, 3), 5.0))
    assert {r.query_date.day: r.all_zero for r in status.all_zero_days(zero, "steps").collect()} == {
        1: True, 2: False, 3: False}
    marks = status.high_water(cal.withColumnRenamed("query_date", "date")).collect()
    assert [(r.user_id, r.last_date) for r in marks] == [("a", D(2024, 1, 5))]


def test_upsert_worked_example(make):
    stored = make("id bigint, user_id string, date date, w double, keep double",
                  (5, "a", D(2024, 1, 1), 71.0, 6.0), (6, "a", D(2024, 1, 2), 72.0, 7.0))
    batch = make("user_id string, date date, w double", ("a", D(2024, 1, 1), None), ("a", D(2024, 1, 3), 73.0))
    keys = ("user_id", "date")
    out = upsert(stored, batch, keys)
    got = {r.date.day: (r.id, r.w, r.keep) for r in out.collect()}
    assert got[1] == (5, None, 6.0) and got[2] == (6, 72.0, 7.0)
    assert got[3][1:] == (73.0, None) and got[3][0] is not None
    again = upsert(out, batch, keys)
    assert again.exceptAll(out).isEmpty() and out.exceptAll(again).isEmpty()
    with pytest.raises(ValueError):
        upsert(stored, batch.withColumn("x", F.lit(1)), keys)
    with pytest.raises(ValueError):
        upsert(stored, batch.drop("date"), keys)


def test_last_write(make):
    df = make("k int, seq int, item int, v string, n double", (1, 1, 9, "a", 1.0), (1, 2, 1, "b", None),
              (1, 2, 2, "c", None), (2, 1, 1, None, 3.0))
    got = {r.k: (r.v, r.n) for r in last_write(df, ["k"], ["seq", "item"]).collect()}
    assert got == {1: ("c", None), 2: (None, 3.0)}


def test_activity_list_and_sets(make):
    acts = json.dumps([{"activityId": str(i), "startTime": f"2024-01-0{i}", "activityType": "running"} for i in (1, 2, 3)])
    df = make("user_id string, body string", ("a", acts), ("b", "null"), ("c", None), ("d", "[]"))
    out = activities.activity_list(df, 2).collect()
    assert sorted((r.user_id, r.activityId, r.detailsPulled) for r in out) == [("a", "2", False), ("a", "3", False)]
    sets = make("user_id string, activityId string, body string",
                ("a", "1", json.dumps({"exerciseSets": [{"exerciseName": "SQUAT", "reps": 5, "weight": 100}]})),
                ("a", "2", "{}"), ("a", "3", json.dumps({"exerciseSets": []})), ("a", "4", json.dumps({"exerciseSets": None})))
    got = activities.strength_sets(sets).collect()
    assert [(r.activityId, r.exerciseName, r.reps, r.weight, r.setType) for r in got] == [("1", "SQUAT", 5, 100, None)]
    frame = make("activityType string", ("running",), ("hiking",), ("running",))
    assert activities.of_type(frame, "running").count() == 2
    with pytest.raises(ValueError):
        activities.of_type(frame, "chess")
    assert [r.activityType for r in activities.most_recent(frame, [F.col("activityType").desc()], 2).collect()] == ["running"] * 2
