import datetime as dt

import pytest

from restwave.operators import clean, smooth, workout
from restwave.operators.quality import duplicate_keys, missing_keys, require_keys, unreadable
from restwave.operators.series import metric_series
from restwave.schemas import BANDWIDTHS, SMOOTHED_COLUMNS, TABLES

D = dt.date


def ms(*args):
    return dt.datetime(*args, tzinfo=dt.timezone.utc).timestamp() * 1000.0


def row(spark, name, **values):
    schema = TABLES[name].schema
    return spark.createDataFrame([tuple({"user_id": "a", "id": 1, "date_pulled": D(2024, 2, 1), **values}.get(c)
                                        for c in schema.names)], schema)


def test_health_stats_zero_is_missing(spark):
    out = clean.clean_health_stats(row(spark, "health_stats", date=D(2024, 1, 1), weight=0.0, body_fat=0.0,
                                       bmi=0.0, fat_mass=0.0, body_water=0.0)).first()
    assert (out.weight, out.body_water) == (0.0, 0.0)
    assert out.body_fat is out.bmi is out.fat_mass is None
    assert not {"id", "date_pulled"} & set(out.asDict())


@pytest.mark.parametrize("start,want", [((2023, 12, 31, 23, 0), 23.0), ((2024, 1, 1, 0, 30), 24.5)])
def test_sleep_clock(spark, start, want):
    out = clean.clean_sleep(row(spark, "sleep", date=D(2024, 1, 1), local_sleep_start_time=ms(*start),
                                local_sleep_time_end=ms(2024, 1, 1, 7, 0), total_sleep_time=28800.0,
                                rem_time=None, hrv_7d_average=55.0)).first()
    assert (out.sleep_start_time, out.sleep_end_time, out.total_sleep_time) == (want, 7.0, 8.0)
    assert out.rem_time is None and out.hrv_7d_average == 55.0
    assert list(out.asDict()) == ["user_id", *clean.SLEEP_COLUMNS]


def test_stress_hours(spark):
    out = clean.clean_stress(row(spark, "stress", date=D(2024, 1, 1), high_stress_duration=1800.0,
                                 overall_stress_level=40.0)).first()
    assert (out.high_stress_duration, out.overall_stress_level, out.low_stress_duration) == (0.5, 40.0, None)


def test_clean_all_needs_every_table(spark):
    tables = {n: row(spark, n, date=D(2024, 1, 1)) for n in clean.CLEANERS}
    assert set(clean.clean_all(tables)) == set(clean.CLEANERS)
    del tables["steps"]
    with pytest.raises(ValueError):
        clean.clean_all(tables)


def test_missing_bookkeeping_is_an_error(make):
    with pytest.raises(ValueError):
        clean.drop_bookkeeping(make("id bigint, date date", (1, D(2024, 1, 1))))


def test_catalogue_sizes(spark):
    assert sum(len(c) for c in SMOOTHED_COLUMNS.values()) == 29
    assert 29 * 2 * len(BANDWIDTHS) == 1276
    tables = clean.clean_all({n: row(spark, n, date=D(2024, 1, 1)) for n in clean.CLEANERS})
    long = smooth.long_series({**tables, "other": tables["steps"]})
    assert long.count() == 29
    assert smooth.smooth_all(tables, ["boxcar"], (1,)).count() == 29


def test_workout_worked_example(make):
    df = make("Exercise string, Weight double, Reps int", ("BENCH_PRESS", 65.0, 1), ("BENCH_PRESS", 66.0, 3),
              ("SQUAT", 50.0, 40), (None, 10.0, 1), ("PLANK", None, None), ("PLANK", float("nan"), None))
    got = {r.Exercise: r for r in workout.workout_summary(df).collect()}
    assert set(got) == {"BENCH_PRESS", "SQUAT", "PLANK"}
    b = got["BENCH_PRESS"]
    assert (b.MaxWeight, b.TotalReps, b.AvgReps, b.TotalWeightReps) == (130.0, 4, 2.0, 130.0 + 198.0)
    assert b.Max1RM == pytest.approx(130.0) and b.AvgWeightPerRep == pytest.approx(82.0)
    assert b.Avg1RM == pytest.approx(82.0 / (1.0278 - 0.0278 * 2))
    assert got["SQUAT"].Max1RM < 0  # more reps than the formula allows: kept
    p = got["PLANK"]
    assert (p.MaxWeight, p.TotalReps, p.TotalWeightReps, p.AvgWeightPerRep, p.Avg1RM) == (None, 0, 0.0, None, None)


def test_quality(make):
    df = make("k int, v string", (1, "a"), (1, None), (2, "b"), (None, None))
    assert [(r.k, r.n) for r in duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert sorted((tuple(r.missing) for r in missing_keys(df, ["k", "v"]).collect())) == [("k", "v"), ("v",)]
    with pytest.raises(ValueError):
        require_keys(df, ["k"], ["k"])
    with pytest.raises(ValueError):
        require_keys(df.where("k = 1"), ["k"], ["k"])
    require_keys(df.where("k = 1"), ["k"], ["k"], unique=False)
    bad = unreadable(make("body string", ("{}",), ("oops",), (None,), ("[1",)))
    assert sorted(r.body for r in bad.collect()) == ["[1", "oops"]


def test_metric_series(spark):
    table = clean.clean_health_stats(row(spark, "health_stats", date=D(2024, 1, 1), weight=150.0, body_fat=20.0))
    smoothed = smooth.smooth_all({"health_stats": table}, bandwidths=(1, 14))
    out = metric_series("health_stats", table, smoothed, 2, 150).collect()
    assert sorted((r.series, r.axis, r.axis_label, r.legend, r.kernel, r.bandwidth, r.smooth, r.is_default)
                  for r in out) == [
        ("body_fat", "body_fat", "Body Fat %", "Body Fat", "boxcar", 14, 20.0, False),
        ("body_fat", "body_fat", "Body Fat %", "Body Fat", "gaussian", 14, 20.0, True),
        ("weight", "default", "Weight (lb)", "Weight", "boxcar", 14, 150.0, False),
        ("weight", "default", "Weight (lb)", "Weight", "gaussian", 14, 150.0, True)]
    bare = metric_series("health_stats", table, smoothed, 500, 600).collect()
    assert sorted((r.series, r.smooth, r.is_default) for r in bare) == [("body_fat", None, False), ("weight", None, False)]
    with pytest.raises(ValueError):
        metric_series("stress", table, smoothed)
