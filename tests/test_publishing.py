"""Wide exports, marts by changed month, and stored smooths that recompute what a change reaches."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from restwave.operators import smooth
from restwave.operators.clean import CLEANERS
from restwave.plans import publish
from restwave.plans import smooths as stored_smooths
from restwave.plans.smooths import SmoothStore
from restwave.schemas import SERIES_VIEWS, table
from restwave.sources.files import FrameStore

D = dt.date
LONG = "user_id string, metric string, series string, date date, value double"
KEYS = "user_id string, metric string, series string"


def day(i):
    return D(2024, 1, 1) + dt.timedelta(days=i)


def cells(df):
    return sorted((str(tuple(r[:-1])), None if r[-1] is None else round(r[-1], 9)) for r in df.collect())


def test_wide_export_equals_the_pivoted_one(spark, make):
    rows = [(u, day(i), None if i % 4 == 0 else float(i * k), float("nan") if i % 3 == 0 else 1.0 + i)
            for k, u in ((1, "a"), (2, None)) for i in (0, 1, 2, 5, 9, 40, 700)]
    df = make("user_id string, date date, x double, y double", *rows)
    got = smooth.smooth_wide(df, ["x", "y"], ("gaussian", "simple"), (1, 7))
    want = smooth.wide(smooth.kernel_smooth(smooth.to_long(df, ["x", "y"]), ("gaussian", "boxcar"), (1, 7), ("user_id", "series")),
                       ["x", "y"], ("gaussian", "boxcar"), (1, 7))
    assert got.columns == want.columns
    shown = [sorted(([str(v) if not isinstance(v, float) else f"{v:.9f}" for v in r]) for r in f.collect()) for f in (got, want)]
    assert shown[0] == shown[1] and len(shown[0]) == 14
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Expand" not in plan and "Aggregate" not in plan and plan.count("Generate") == 1
    assert smooth.smooth_wide(df.limit(0), ["x"], ("boxcar",), (7,)).isEmpty()
    twice = smooth.smooth_wide(df.unionByName(df), ["x"], ("boxcar",), (1,))
    assert twice.count() == 28
    with pytest.raises(ValueError):
        smooth.smooth_wide(df, [], ("boxcar",), (7,))


@pytest.fixture
def smooths(spark, tmp_path):
    return SmoothStore(spark, f"file:{tmp_path}/smooths", smooth.date_kernels(("boxcar",), (1, 7)), step=10)


def fresh(df):
    return cells(smooth.kernel_smooth(df.where("date is not null"), ("boxcar",), (1, 7)))


def test_smooths_recompute_what_a_change_reaches(smooths, make):
    rows = {(u, i): float(i % 7) for u in ("a", "b", None) for i in range(60)}

    def source():
        return make(LONG, *[(u, "m", "s", day(i), v) for (u, i), v in rows.items()], ("a", "m", "s", None, 1.0))

    blocks = len({(day(i) - D(1970, 1, 1)).days // 10 for i in range(60)})
    assert smooths.refresh(source()) == 3 * blocks
    assert cells(smooths.read(KEYS)) == fresh(source())
    held, before, version = smooths.read(KEYS), cells(smooths.read(KEYS)), smooths.files.versions()
    assert smooths.refresh(source()) == 0 and smooths.files.versions() == version
    # A changed block reaches its two neighbours; other blocks and series stay as they are.
    first = min(i for i in range(20, 30) if (day(i) - D(1970, 1, 1)).days % 10 == 0)
    rows["a", first + 5] = 100.0
    rows[None, first] = None
    assert smooths.refresh(source()) == 2 * 3
    assert cells(smooths.read(KEYS)) == fresh(source())
    # Removed days take their smooths along, and new series come.
    for i in range(60):
        del rows["b", i]
        rows["c", i + 1000] = math.nan if i == 3 else 1.0
    smooths.refresh(source())
    assert cells(smooths.read(KEYS)) == fresh(source())
    assert cells(held) == before
    assert cells(smooths.read(KEYS, version=1)) == before


def test_other_kernels_recompute_all_and_empty_sources_empty_the_store(spark, smooths, make, tmp_path):
    df = make(LONG, *[("a", "m", "s", day(i), float(i)) for i in range(5)])
    smooths.refresh(df)
    other = SmoothStore(spark, f"file:{tmp_path}/smooths", smooth.date_kernels(("gaussian",), (1,)), step=512)
    assert other.refresh(df) > 0
    assert cells(other.read(KEYS)) == cells(smooth.kernel_smooth(df, ("gaussian",), (1,)))
    assert other.refresh(df.limit(0)) > 0 and other.read(KEYS).isEmpty()
    assert SmoothStore(spark, f"file:{tmp_path}/none", smooths.kernels).read(KEYS).isEmpty()
    with pytest.raises(ValueError):
        SmoothStore(spark, f"file:{tmp_path}/none", [])


def test_smooths_keep_the_old_version_if_a_refresh_fails(smooths, make, monkeypatch):
    df = make(LONG, *[("a", "m", "s", day(i), float(i)) for i in range(5)])
    smooths.refresh(df)
    before = cells(smooths.read(KEYS))
    with monkeypatch.context() as m:
        m.setattr(smooths.files, "publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            smooths.refresh(df.withColumn("value", F.lit(2.0)))
    assert cells(smooths.read(KEYS)) == before
    smooths.refresh(df.withColumn("value", F.lit(2.0)))
    assert {v for _, v in cells(smooths.read(KEYS))} == {2.0}


def test_marts_rewrite_changed_months_only(spark, make, tmp_path):
    files = FrameStore(spark, f"file:{tmp_path}/out")

    def process(steps):
        frames = {n: spark.createDataFrame([], table(n).schema) for n in CLEANERS}
        frames["steps"] = make("id bigint, user_id string, date date, date_pulled date, total_steps double, step_goal double, total_distance double",
                               *[(1, "a", d, None, v, 10.0, None) for d, v in steps.items()])
        publish.process_frames(frames, files, ("boxcar",), (1, 7), export_wide=False)
        return publish.refresh_series(files, 1, 150)

    def mart():
        return {(r.series, r.date, r.bandwidth): r.smooth for r in publish.read_series(files, "steps").collect()}

    def whole():
        publish_to = FrameStore(spark, f"file:{tmp_path}/out")
        df = publish.metric_series("steps", publish_to.read("processed/steps.parquet"), publish_to.read(publish.SMOOTHED), 1, 150)
        return {(r.series, r.date, r.bandwidth): r.smooth for r in df.collect()}

    steps = {D(2024, 1, 10): 1.0, D(2024, 2, 10): 2.0, D(2024, 3, 1): 3.0}
    assert process(steps) == {m: ["2024-01", "2024-02", "2024-03"] if m == "steps" else [] for m in SERIES_VIEWS}
    assert mart() == whole() and len(mart()) == 3 * 3 * 2
    held, before = publish.read_series(files, "steps"), len(mart())
    assert not any(process(steps).values())
    # The smooth of the first of March reaches into February.
    steps[D(2024, 2, 28)] = 9.0
    assert process(steps)["steps"] == ["2024-02", "2024-03"]
    assert mart() == whole()
    del steps[D(2024, 1, 10)]
    assert process(steps)["steps"] == ["2024-01"] and mart() == whole()
    assert process({None: 5.0})["steps"] == ["2024-02", "2024-03", "none"]
    assert mart() == whole()
    assert held.count() == before and len(publish.series_history(files, "steps")) == 5
    assert publish.refresh_series(files, 1, 6)["steps"] == ["none"]
    with pytest.raises(ValueError):
        publish.read_series(files, "nothing")


def test_long_lists_of_units_are_not_broadcast(smooths, make, monkeypatch):
    monkeypatch.setattr(stored_smooths, "BROADCAST_UNITS", 3, raising=False)
    plans, write, stale = [], smooths.files.write, smooths._stale
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin"))
    monkeypatch.setattr(smooths.files, "write", lambda rows, commit: (plan(rows), write(rows, commit)))
    monkeypatch.setattr(smooths, "_stale", lambda *a: (df := stale(*a), plan(df))[0])
    rows = [(u, "m", None, day(i), float(i % 7)) for u in ("a", None) for i in range(40)]
    assert smooths.refresh(make(LONG, *rows)) == 10 and sum(plans) == 0
    changed = [*rows[:-1], (None, "m", None, day(39), 50.0)]
    assert smooths.refresh(make(LONG, *changed)) == 2 and cells(smooths.read(KEYS)) == fresh(make(LONG, *changed))
    changed = [(*r[:4], r[4] + 1) for r in changed if r[0] is None]
    plans.clear()
    assert smooths.refresh(make(LONG, *changed)) == 10 and sum(plans) == 0
    assert cells(smooths.read(KEYS)) == fresh(make(LONG, *changed))
