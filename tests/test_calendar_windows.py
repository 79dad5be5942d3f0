import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from restwave.operators import calendar, smooth, windows
from restwave.operators.banded import banded_means, boxcar_distance, gaussian_distance, gaussian_rows

D = dt.date


def cells(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def long_series(spark, users=3, days=120, seed=1, gaps=0.2):
    rng = random.Random(seed)
    rows = [(f"u{u}", "m", "s", D(2024, 1, 1) + dt.timedelta(days=i),
             None if rng.random() < 0.2 else rng.uniform(-50, 100))
            for u in range(users) for i in range(days) if rng.random() > gaps]
    return rows, spark.createDataFrame(rows, "user_id string, metric string, series string, date date, value double")


def test_daily_mean_and_calendar(make):
    df = make("user_id string, date date, w double", ("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 1), 3.0),
              ("a", D(2024, 1, 4), None), ("b", D(2024, 1, 9), float("nan")), ("b", None, 4.0))
    out = calendar.fill_calendar(calendar.daily_mean(df, ["w"]))
    got = {(r.user_id, r.date): r.w for r in out.collect()}
    assert got == {("a", D(2024, 1, 1)): 2.0, ("a", D(2024, 1, 2)): None, ("a", D(2024, 1, 3)): None,
                   ("a", D(2024, 1, 4)): None, ("b", D(2024, 1, 9)): None}


def test_calendar_matches_pandas(spark):
    rng = random.Random(3)
    rows = [("u", D(2023, 2, 1) + dt.timedelta(days=rng.randrange(90)), rng.uniform(0, 9)) for _ in range(60)]
    out = calendar.fill_calendar(calendar.daily_mean(
        spark.createDataFrame(rows, "user_id string, date date, v double"), ["v"]))
    got = {r.date: r.v for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["u", "date", "v"])
    want = pdf.assign(date=pd.to_datetime(pdf.date)).groupby("date").v.mean().asfreq("D")
    assert set(got) == {t.date() for t in want.index}
    for t, v in want.items():
        assert (got[t.date()] is None) == math.isnan(v)
        assert math.isnan(v) or got[t.date()] == pytest.approx(v)


def test_empty_calendar(make):
    df = make("user_id string, date date, w double")
    assert calendar.fill_calendar(calendar.daily_mean(df, ["w"])).columns == ["user_id", "date", "w"]
    assert calendar.fill_calendar(df).isEmpty()


@pytest.mark.parametrize("days,start,end", [(28, D(2024, 1, 1), D(2024, 2, 10)), (1, D(2024, 1, 1), D(2024, 1, 4)),
                                            (1000, D(2024, 1, 1), D(2024, 2, 1)), (7, D(2024, 1, 1), D(2024, 1, 14))])
def test_chunks_tile_the_range(make, days, start, end):
    df = make("a date, b date", (start, end))
    chunks = cells(calendar.range_chunks(df, "a", "b", days), "chunk_start", "chunk_end")
    assert chunks[0][0] == start and chunks[-1][1] == end
    assert all((b - a).days < days for a, b in chunks)
    assert all(x[1] + dt.timedelta(days=1) == y[0] for x, y in zip(chunks, chunks[1:]))
    if days == 28:
        assert chunks == [(D(2024, 1, 1), D(2024, 1, 28)), (D(2024, 1, 29), D(2024, 2, 10))]


def test_ranges_are_checked(make):
    df = make("user_id string", ("a",))
    with pytest.raises(ValueError):
        calendar.date_calendar(df, D(2024, 1, 2), D(2024, 1, 1))
    with pytest.raises(ValueError):
        calendar.range_chunks(df, "a", "b", 0)
    assert calendar.date_calendar(df, D(2024, 1, 1), D(2024, 1, 3)).count() == 3


def test_distinct_dates_sorted(make):
    df = make("date date", (D(2024, 1, 2),), (D(2024, 1, 1),), (D(2024, 1, 2),))
    assert [r.date for r in calendar.distinct_dates(df).collect()] == [D(2024, 1, 1), D(2024, 1, 2)]


def test_sma_worked_example(make):
    df = make("user_id string, date date, v double", *[("a", D(2024, 1, i + 1), v)
                                                       for i, v in enumerate((3.0, None, 1.0, 4.0))])
    out = windows.simple_row_means(df, "v", (3,)).orderBy("date")
    assert [r.value for r in out.collect()] == [3.0, 2.0, 2.5, 2.5]


@pytest.mark.parametrize("how", ["window", "blocks", "auto"])
def test_sma_matches_pandas(spark, how):
    rows, df = long_series(spark, users=1)
    out = windows.simple_row_means(df, "value", (1, 3, 4, 7, 8, 175), how=how)
    pdf = pd.DataFrame(rows, columns=["user_id", "m", "s", "date", "v"]).sort_values("date")
    got = {(r.date, r.bandwidth): r.value for r in out.collect()}
    for w in (1, 3, 4, 7, 8, 175):
        want = pdf.v.astype(float).rolling(w, min_periods=1, center=True).mean()
        for d, v in zip(pdf.date, want):
            g = got[(d, w)]
            assert (g is None) if math.isnan(v) else g == pytest.approx(v)


def plain_rows(values, w):
    out = []
    c = w // 2 - (w - 1) / 2
    for i in range(len(values)):
        n = d = 0.0
        for o in range(-(w // 2), (w - 1) // 2 + 1):
            if 0 <= i + o < len(values) and values[i + o] is not None:
                k = math.exp(-0.5 * ((o + c) / (w / 2)) ** 2)
                n, d = n + k * values[i + o], d + k
        out.append(n / d if d else None)
    return out


@pytest.mark.parametrize("how", ["pairs", "blocks"])
def test_gaussian_rows_match_a_plain_loop(spark, how):
    rows, df = long_series(spark, users=2, days=60)
    widths = (1, 3, 4, 7, 14)
    got = {(r.user_id, r.date, r.bandwidth): r.value
           for r in windows.gaussian_row_means(df, "value", widths, how=how).collect()}
    for u in ("u0", "u1"):
        mine = sorted((r[3], r[4]) for r in rows if r[0] == u)
        for w in widths:
            for (d, _), v in zip(mine, plain_rows([x[1] for x in mine], w)):
                g = got[(u, d, w)]
                assert g is None if v is None else g == pytest.approx(v, abs=1e-9)
    assert len(got) == len(rows) * len(widths)


def plain_kernel(points, kernel, bw):
    out = {}
    for d, _ in points:
        n = s = 0.0
        for e, y in points:
            dist = abs((e - d).days)
            if y is None or dist > (39 * bw if kernel == "gaussian" else bw / 2):
                continue
            k = math.exp(-0.5 * (dist / bw) ** 2) if kernel == "gaussian" else 1.0
            n, s = n + k * y, s + k
        out[d] = n / s if s else None
    return out


@pytest.mark.parametrize("how", ["pairs", "blocks"])
def test_kernels_match_a_plain_loop(spark, how):
    rows, df = long_series(spark, users=2, days=150, gaps=0.5)
    got = {(r.user_id, r.date, r.kernel, r.bandwidth): r.value
           for r in smooth.kernel_smooth(df, ["gaussian", "boxcar"], (1, 3, 7), how=how).collect()}
    assert len(got) == len(rows) * 6
    for u in ("u0", "u1"):
        points = [(r[3], r[4]) for r in rows if r[0] == u]
        for kernel in ("gaussian", "boxcar"):
            for bw in (1, 3, 7):
                for d, v in plain_kernel(points, kernel, bw).items():
                    g = got[(u, d, kernel, bw)]
                    assert g is None if v is None else g == pytest.approx(v, abs=1e-9)


def test_long_series_spans_many_blocks(spark):
    # Longer than several blocks of either plan, before and after the epoch.
    days = 4000
    df = spark.range(days).select(F.lit("u").alias("user_id"), (F.col("id") - 2000).alias("day"),
                                  F.when(F.col("id") % 5 != 0, F.hash("id") / F.lit(1e8)).alias("y"))
    kernels = [gaussian_distance(7, 9.0), gaussian_distance(21, 9.0), boxcar_distance(14), gaussian_rows(8)]
    pairs, blocks = (banded_means(df, ["user_id"], "day", "y", kernels, how) for how in ("pairs", "blocks"))
    assert pairs.count() == days * len(kernels)
    on = ["user_id", "day", "kernel", "bandwidth"]
    joined = pairs.join(blocks.withColumnRenamed("value", "other"), on)
    assert joined.count() == days * len(kernels)
    assert joined.where(~F.col("value").eqNullSafe(F.col("other"))
                        & (F.coalesce(F.abs(F.col("value") - F.col("other")), F.lit(1.0)) > 1e-9)).isEmpty()


def test_blocks_may_straddle_batches(spark):
    rows, df = long_series(spark, users=4, days=90)
    df = df.withColumn("user_id", F.when(F.col("user_id") != "u1", F.col("user_id")))
    want = smooth.kernel_smooth(df, ["gaussian"], (3, 7), how="blocks")
    before = sorted(want.collect(), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(want.collect(), key=str) == before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(before) == len(rows) * 2 and any(r.user_id is None for r in before)


def test_smoothing_properties(spark):
    rows, df = long_series(spark, users=1)
    same = smooth.kernel_smooth(df, ["boxcar"], (1,)).collect()
    assert {r.date: r.value for r in same} == {r[3]: r[4] for r in rows}
    flat = df.withColumn("value", F.lit(5.0))
    assert all(r.value == pytest.approx(5.0) for r in smooth.kernel_smooth(flat, bandwidths=(1, 7)).collect())
    none = df.withColumn("value", F.lit(None).cast("double"))
    for how in ("pairs", "blocks"):
        assert all(r.value is None for r in smooth.kernel_smooth(none, bandwidths=(7,), how=how).collect())


def test_nan_is_missing(make):
    df = make("user_id string, metric string, series string, date date, value double",
              ("a", "m", "s", D(2024, 1, 1), 4.0), ("a", "m", "s", D(2024, 1, 2), float("nan")))
    for how in ("pairs", "blocks"):
        got = {(r.kernel, r.date.day): r.value for r in smooth.kernel_smooth(df, bandwidths=(2,), how=how).collect()}
        assert got == {("gaussian", 1): 4.0, ("gaussian", 2): 4.0, ("boxcar", 1): 4.0, ("boxcar", 2): 4.0}


def test_kernel_names():
    assert smooth.kernel_names(["simple", "gaussian", "boxcar"]) == ["boxcar", "gaussian"]
    with pytest.raises(ValueError):
        smooth.kernel_names(["triangle"])


def test_wide_names_and_trim(spark):
    _, df = long_series(spark, users=1, days=10)
    long = smooth.kernel_smooth(df, ["boxcar"], (1, 7, 14))
    out = smooth.wide(long, ["s"], ["boxcar"], (1, 7, 14))
    assert out.columns == ["user_id", "date", "s_boxcar_1", "s_boxcar_7", "s_boxcar_14"]
    assert smooth.trim_wide(out, 7, 14).columns == ["user_id", "date", "s_boxcar_7", "s_boxcar_14"]
    assert {r.bandwidth for r in smooth.trim_bandwidths(long, 1, 7).collect()} == {1, 7}
    value = {r.date: r.value for r in long.where("bandwidth = 7").collect()}
    assert {r.date: r.s_boxcar_7 for r in out.collect()} == value


def test_stored_row_means_follow_the_data(spark, tmp_path):
    _, df = long_series(spark, users=1, days=10)
    base = f"file:{tmp_path}"
    first = windows.stored_row_means(df, ["value"], base, (1, 3))
    assert first.count() == df.count() * 4
    stamp = sorted(p.name for p in tmp_path.iterdir())
    windows.stored_row_means(df, ["value"], base, (1, 3))
    assert sorted(p.name for p in tmp_path.iterdir()) == stamp
    changed = windows.stored_row_means(df.withColumn("value", F.lit(1.0)), ["value"], base, (1, 3))
    assert all(r.value == pytest.approx(1.0) for r in changed.collect())
    assert len(list(tmp_path.iterdir())) == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["auto", "pairs"])
def test_repeated_dates_null_keys_and_far_dates(spark, make, how):
    rows = [("a", D(2024, 1, 1), 2.0), ("a", D(2024, 1, 1), 4.0), (None, D(2024, 1, 1), 5.0), (None, D(2024, 1, 1), None), ("b", D(2024, 1, 1), None),
            ("c", D(2024, 1, 1), 1.0), ("c", D(2024, 1, 31), None)]
    df = make("user_id string, date date, value double", *rows).selectExpr("user_id", "'m' AS metric", "'s' AS series", "date", "value")
    for widths in ((1,), (1, 7), (1, 7, 150)):  # other bandwidths don't change an answer
        got = smooth.kernel_smooth(df, ["gaussian"], widths, how=how).where("bandwidth = 1").collect()
        assert sorted(((r.user_id or "", r.date.day, r.value) for r in got), key=str) == [
            ("", 1, 5.0), ("", 1, 5.0), ("a", 1, 3.0), ("a", 1, 3.0), ("b", 1, None), ("c", 1, 1.0), ("c", 31, 1.0)]
    both = smooth.kernel_smooth(df, ["gaussian", "boxcar"], (1,), how=how).where("user_id = 'a'").collect()
    assert [r.value for r in both] == [3.0] * 4


def test_plans(spark):
    _, df = long_series(spark, users=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan_of(smooth.kernel_smooth(df, ["gaussian"], (1, 7), how="pairs"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text and "Arrow" not in text
    text = plan_of(smooth.kernel_smooth(df))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    for narrow in (windows.simple_row_means(df, "value", (7, 14)), smooth.kernel_smooth(df, ["boxcar"], (7, 14))):
        text = plan_of(narrow)
        assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1
        assert "Python" not in text and "Arrow" not in text
