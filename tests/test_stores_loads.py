import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from restwave.plans import load, publish
from restwave.schemas import INTRADAY_PAYLOADS, PART, TABLES, UPDATE_ORDER, table
from restwave.sources import landing
from restwave.sources.files import FrameStore, base_uri
from restwave.sources.landing import LANDED, from_paths, read_landed, reload_answers
from restwave.sources.tables import REMOVE, TableStore
from restwave.streaming.landing import load_available

D = dt.date
UTC = dt.timezone.utc


@pytest.fixture
def store(spark, tmp_path):
    s = TableStore(spark, f"file:{tmp_path}/db")
    s.create_all()
    return s


def drop_file(root, metric, batch, user, day, body):
    folder = os.path.join(root, f"metric={metric}", f"batch={batch}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{user}_{day}.json"), "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def steps_body(*days):
    return {"values": [{"calendarDate": f"2024-01-{d:02d}", "values": {"totalSteps": s, "stepGoal": 10}} for d, s in days]}


def hr_body(*points):
    p = INTRADAY_PAYLOADS["heart_rate_detailed"]
    return {p.available: 50, p.descriptors: [{"key": "timestamp", "index": 0}, {"key": "heartrate", "index": 1}],
            p.values: [list(x) for x in points]}


def at(*args):
    return int(dt.datetime(*args, tzinfo=UTC).timestamp() * 1000)


def frame(spark, metric, *rows):
    return spark.createDataFrame([(u, metric, d, b, body if isinstance(body, str) else json.dumps(body))
                                  for u, d, b, body in rows], LANDED)


# --- files ---

def test_sorted_export(spark, tmp_path, make):
    files = FrameStore(spark, base_uri(local_dir=str(tmp_path)))
    rows = [(None, 0), (None, 1)] + [(i // 3, i) for i in range(40)]
    df = make("k int, n int", *rows[::-1]).repartition(3)
    files.write_sorted(df, "t", ("k", "n"), rows_per_file=5)
    files.write_sorted(df, "t", ("k", "n"), rows_per_file=5)  # replaces
    got = sorted(files.read_sorted("t").collect(), key=lambda r: r.row)
    assert [(r.k, r.n) for r in got] == rows and [r.row for r in got] == list(range(42))
    assert [r.file for r in got] == sorted(r.file for r in got) and max(r.file for r in got) >= 8
    listed = files.manifest("t").orderBy("file").collect()
    for m in listed:
        own = [(r.k, r.n) for r in got if r.file == m.file]
        assert (tuple(m.low), tuple(m.high), m.rows, m.first_row) == (own[0], own[-1], len(own), rows.index(own[0]))
    for low, high in ((4, 5), (None, 2), (12, None), (0, 0), (50, None), (7, 3)):
        part = files.read_sorted("t", low, high)
        want = [(k, n, rows.index((k, n))) for k, n in rows if k is not None and (low is None or k >= low) and (high is None or k <= high)]
        assert sorted((r.k, r.n, r.row) for r in part.collect()) == want
    between = files.read_sorted("t", 4, 5)
    assert len(between.inputFiles()) <= 4 < len(listed)  # manifest included
    files.write_sorted(df.where("n < 0"), "none", ("k",))
    assert files.read_sorted("none").collect() == [] and files.manifest("none").collect() == []
    for call in (lambda: files.write_sorted(df, "t", ()), lambda: (files.write_sorted(df.withColumnRenamed("n", "Row"), "u", ("k",)), files.read_sorted("u"))):
        with pytest.raises(ValueError):
            call()


def test_frame_store(spark, tmp_path, make):
    files = FrameStore(spark, base_uri(local_dir=str(tmp_path)))
    df = make("a int, b string, d date, x double", (1, "x,\"y\"", D(2024, 1, 1), 0.1), (2, None, None, None))
    for fmt in ("parquet", "csv"):
        files.write(df, f"deep/dir/t.{fmt}", fmt)
        files.write(df, f"deep/dir/t.{fmt}", fmt)  # replaces
        back = files.read(f"deep/dir/t.{fmt}", fmt, df.schema)
        assert sorted(back.collect()) == sorted(df.collect())
    assert dict(files.read("deep/dir/t.csv", "csv").dtypes) == {"a": "int", "b": "string", "d": "date", "x": "double"}
    files.write(df, "sorted.parquet", order_by=("d", "a"))
    placed = files.read("sorted.parquet").select("a", "_metadata.file_name", "_metadata.row_index")
    assert [r.a for r in sorted(placed.collect(), key=lambda r: (r.file_name, r.row_index))] == [2, 1]
    for call in (lambda: files.write(df, "t", "orc"), lambda: files.read("t", "orc")):
        with pytest.raises(ValueError):
            call()
    files.write_each({"one": df, "two": df}, "processed")
    assert files.read("processed/two.parquet").count() == 2


def test_base_uri():
    assert base_uri(local_dir="/x") == "file:/x"
    assert base_uri("aws", bucket="b", prefix="p/") == "s3a://b/p"
    for bad in ({}, {"environment": "aws"}):
        with pytest.raises(ValueError):
            base_uri(**bad)


# --- tables ---

def test_tables_exist_empty_and_typed(store):
    for name, t in TABLES.items():
        df = store.df(name)
        assert df.isEmpty() and df.columns == t.schema.names
    assert store.drop("steps") and not store.exists("steps")
    store.create_all()
    assert store.exists("steps")
    assert table("HealthStats").name == "health_stats"
    with pytest.raises(ValueError):
        table("Nothing")


def test_add_records(store, make):
    assert store.add_record("activities", {"user_id": "a", "activityId": "7", "activityType": "running"}) == 1
    row = store.df("activities").first()
    assert row.detailsPulled is False and row.id is not None and row.activityType == "running"
    with pytest.raises(ValueError):
        store.add_record("activities", {"user_id": "a", "activityId": "7"})
    with pytest.raises(ValueError):
        store.add_record("activities", {"user_id": "a", "activityId": None})
    with pytest.raises(ValueError):
        store.add_record("activities", {"user_id": "a", "nope": 1})
    many = make("user_id string, activityId string, reps int", ("a", "7", 5), ("a", "7", 6))
    assert store.add_records("strength", many) == 2
    assert store.records("strength").count() == 2
    with pytest.raises(ValueError):
        store.upsert("strength", many)


def test_update_record(store):
    store.update_record("activities", {"user_id": "a", "activityId": "1"}, {"activityType": "hiit", "steps": 5.0})
    store.update_record("activities", {"user_id": "a", "activityId": "1"}, {"activityType": "tennis"})
    store.update_record("activities", {"user_id": "b", "activityId": "1"}, {"steps": 2.0})
    got = sorted((r.user_id, r.activityType, r.steps) for r in store.df("activities").collect() if r.activityType) + [
        (r.user_id, r.steps) for r in store.df("activities").where("user_id = 'b'").collect()]
    assert got == [("a", "tennis", 5.0), ("b", 2.0)]


def test_upsert_touches_only_its_months(store, make):
    rows = make("user_id string, date date, total_steps double", ("a", D(2024, 1, 31), 1.0), ("a", D(2024, 2, 1), 2.0))
    assert store.upsert("steps", rows) == 2
    january = os.path.join(store.uri("steps")[5:], f"{PART}=2024-01")
    before = sorted(os.listdir(january))
    store.upsert("steps", make("user_id string, date date, total_steps double", ("a", D(2024, 2, 1), 9.0),
                               ("a", D(2024, 3, 1), 3.0)))
    assert sorted(os.listdir(january)) == before
    assert sorted((r.date, r.total_steps) for r in store.df("steps").collect()) == [
        (D(2024, 1, 31), 1.0), (D(2024, 2, 1), 9.0), (D(2024, 3, 1), 3.0)]
    with pytest.raises(ValueError):
        store.upsert("steps", rows.union(rows))
    with pytest.raises(ValueError):
        store.upsert("steps", make("user_id string, date date", (None, D(2024, 1, 1))))


def test_nan_reads_as_null(store, make):
    store.upsert("steps", make("user_id string, date date, total_steps double", ("a", D(2024, 1, 1), float("nan"))))
    assert store.df("steps").first().total_steps is None


def test_removal_can_empty_a_partition(store, make):
    schema = "user_id string, query_date date, date_time_utc timestamp, hr double, pull_status string"
    stamp = dt.datetime(2024, 1, 31, 23, 59, 59, 999999, tzinfo=UTC)
    store.upsert("heart_rate_detailed", make(schema, ("a", D(2024, 1, 31), stamp, None, "no_data")))
    removal = make(f"{schema}, {REMOVE} boolean", ("a", D(2024, 1, 31), stamp, None, "fetched", True))
    store.upsert("heart_rate_detailed", removal)
    assert store.df("heart_rate_detailed").isEmpty()


# --- landing ---

def test_landed_files(spark, tmp_path):
    root = str(tmp_path)
    drop_file(root, "steps", 3, "a_b-1", "2024-01-01", steps_body((1, 5)))
    drop_file(root, "steps", 4, "a_b-1", "2024-01-02", '{\n "values": []\n}')
    drop_file(root, "steps", 4, "x+y", "2024-01-02", "{}")
    drop_file(root, "reload", 4, "a", "2024-01-02", {"status": "DENIED"})
    open(os.path.join(root, "metric=steps", "batch=4", "notes.txt"), "w").write("x")
    rows = sorted(read_landed(spark, f"file:{root}", "steps").collect())
    assert [(r.user_id, r.metric, r.query_date.day, r.batch) for r in rows] == [
        ("a_b-1", "steps", 1, 3), ("a_b-1", "steps", 2, 4), ("x+y", "steps", 2, 4)]
    assert json.loads(rows[1].body) == {"values": []}
    assert read_landed(spark, f"file:{root}", "steps", first_batch=4).count() == 2
    nothing = read_landed(spark, f"file:{root}", "sleep")
    assert nothing.isEmpty() and nothing.columns == list(rows[0].asDict())
    answers = reload_answers(read_landed(spark, f"file:{root}", landing.REPLIES)).collect()
    assert [(r.user_id, r.query_date.day, r.status) for r in answers] == [("a", 2, "DENIED")]


# --- loads ---

def test_daily_load_is_incremental(spark, store):
    run = D(2024, 1, 31)
    first = frame(spark, "steps", ("a", D(2024, 1, 1), 1, steps_body((1, 1), (3, 3))),
                  ("b", D(2024, 1, 1), 1, steps_body((1, 10))), ("a", D(2024, 1, 1), 1, steps_body((40 - 9, 31))))
    assert load.load_daily(store, first, "steps", D(2024, 1, 20)) == 3  # the 31st is after the run date
    later = frame(spark, "steps", ("a", D(2024, 1, 1), 2, steps_body((1, 100), (3, 300), (5, 500))),
                  ("b", D(2024, 1, 1), 2, steps_body((2, 20))))
    assert load.load_daily(store, later, "steps", run) == 4
    got = {(r.user_id, r.date.day): (r.total_steps, r.date_pulled) for r in store.df("steps").collect()}
    assert got == {("a", 1): (100.0, run), ("a", 3): (300.0, run), ("a", 5): (500.0, run),
                   ("b", 1): (10.0, D(2024, 1, 20)), ("b", 2): (20.0, run)}
    before = sorted(store.df("steps").collect())
    assert load.load_daily(store, later, "steps", run) == 0
    assert load.load_daily(store, first, "steps", run) == 1  # the 31st; older batches displace nothing
    assert sorted(store.df("steps").where("day(date) < 31").collect()) == before
    assert load.newest_batch(store, "steps") == 2
    assert load.load_daily(store, later.where("false"), "steps", run) == 0


def test_start_date_and_hook(spark, store):
    body = frame(spark, "steps", ("a", D(2024, 1, 1), 1, steps_body((1, 1), (3, 3))))
    hook = lambda df: df.withColumn("step_goal", F.lit(7.0))
    assert load.load_daily(store, body, "steps", D(2024, 2, 1), start=D(2024, 1, 2), hook=hook) == 1
    assert [(r.date.day, r.step_goal) for r in store.df("steps").collect()] == [(3, 7.0)]


def test_intraday_load(spark, store):
    name = "heart_rate_detailed"
    p = INTRADAY_PAYLOADS[name]
    answers = spark.createDataFrame([("a", "DENIED")], "user_id string, status string")
    d = lambda i: D(2024, 1, i)
    first = frame(spark, name, ("a", d(1), 1, hr_body((at(2024, 1, 1, 1), 60), (at(2024, 1, 1, 2), 61))),
                  ("a", d(2), 1, {}), ("a", d(3), 1, {p.available: 50}),
                  ("b", d(3), 1, {p.available: 50}), ("a", d(4), 1, hr_body((at(2024, 1, 4, 1), 70))))
    load.load_intraday(store, first, name, d(4), answers=answers)
    show = lambda: sorted((r.user_id, r.query_date.day, r.date_time_utc.astimezone(UTC).hour, r.hr, r.pull_status)
                          for r in store.df(name).collect())
    assert [(u, q, h, s) for u, q, h, _, s in show()] == [
        ("a", 1, 1, "fetched"), ("a", 1, 2, "fetched"), ("a", 2, 23, "no_data"), ("a", 3, 23, "denied"),
        ("a", 4, 1, "fetched")]
    # A newer batch wins row by row; a day that was fetched once has no placeholder any more.
    second = frame(spark, name, ("a", d(1), 2, hr_body((at(2024, 1, 1, 1), 99))),
                   ("a", d(2), 2, hr_body((at(2024, 1, 2, 1), 99))), ("a", d(3), 2, hr_body((at(2024, 1, 3, 5), 63))),
                   ("b", d(3), 2, hr_body((at(2024, 1, 3, 6), 80))),
                   ("a", d(4), 2, hr_body((at(2024, 1, 4, 1), 71), (at(2024, 1, 4, 9), 72))))
    load.load_intraday(store, second, name, d(5))
    assert show() == [
        ("a", 1, 1, 99.0, "fetched"), ("a", 1, 2, 61.0, "fetched"), ("a", 2, 1, 99.0, "fetched"),
        ("a", 3, 5, 63.0, "fetched"), ("a", 4, 1, 71.0, "fetched"), ("a", 4, 9, 72.0, "fetched"),
        ("b", 3, 6, 80.0, "fetched")]
    assert load.load_intraday(store, second, name, d(5)) == 0


def test_newer_batch_settles_a_day_within_one_load(spark, store):
    name = "heart_rate_detailed"
    both = frame(spark, name, ("a", D(2024, 1, 2), 1, {}), ("a", D(2024, 1, 2), 2, hr_body((at(2024, 1, 2, 1), 60))))
    load.load_intraday(store, both, name, D(2024, 1, 5))
    assert [(r.hr, r.pull_status) for r in store.df(name).collect()] == [(60.0, "fetched")]


def test_any_cut_and_order_of_loads_gives_one_table(spark, tmp_path):
    d = lambda i: D(2024, 1, i)
    run, weigh = d(31), lambda *days: {"dailyWeightSummaries": [
        {"summaryDate": f"2024-01-{i:02d}", "allWeightMetrics": [{"weight": w}]} for i, w in days]}
    landed = {
        "steps": [("a", d(20), 1, steps_body((20, 1))), ("a", d(10), 1, steps_body((10, 2))), ("a", d(10), 3, steps_body((10, 3))),
                  ("b", d(10), 2, steps_body((10, 4)))],
        "health_stats": [("a", d(1), 1, weigh((1, 1000.0))), ("a", d(4), 2, weigh((4, 4000.0))), ("a", d(9), 3, weigh((9, 9000.0), (4, 5000.0)))],
        "heart_rate_detailed": [("a", d(1), 1, {}), ("a", d(1), 2, hr_body((at(2024, 1, 1, 1), 60))), ("a", d(1), 3, {}), ("a", d(2), 1, {}),
                                ("b", d(1), 1, hr_body((at(2024, 1, 1, 1), 70))), ("b", d(1), 4, hr_body((at(2024, 1, 1, 1), 71), (at(2024, 1, 1, 2), 72)))]}
    want = {}
    for k, cut in enumerate((None, 1, -1, 2)):
        s = TableStore(spark, f"file:{tmp_path}/{k}")
        s.create_all()
        for name, rows in landed.items():
            parts = [rows] if cut is None else [rows[i:i + abs(cut)] for i in range(0, len(rows), abs(cut))][::1 if cut > 0 else -1]
            for part in parts:
                (load.load_intraday if "detailed" in name else load.load_daily)(s, frame(spark, name, *part), name, run)
            got = sorted(map(repr, s.df(name).drop("id").collect()))
            assert want.setdefault(name, got) == got
    days = {r.date.day: r.weight for r in s.df("health_stats").collect()}
    assert sorted(days) == list(range(1, 10)) and days[4] == pytest.approx(5000 * 0.00220462) and days[2] is None
    assert [(r.user_id, r.query_date.day, r.hr, r.pull_status) for r in s.df("heart_rate_detailed").orderBy("user_id", "date_time_utc").collect()] == [
        ("a", 1, 60.0, "fetched"), ("a", 2, None, "no_data"), ("b", 1, 71.0, "fetched"), ("b", 1, 72.0, "fetched")]


def test_stream_cap_does_not_matter(spark, tmp_path):
    root, name = str(tmp_path / "landing"), "heart_rate_detailed"
    drop_file(root, name, 1, "a", "2024-01-01", {})
    drop_file(root, name, 2, "a", "2024-01-01", hr_body((at(2024, 1, 1, 1), 60)))
    drop_file(root, name, 3, "a", "2024-01-02", {})
    for cap in (1, 2, 10_000):
        s = TableStore(spark, f"file:{tmp_path}/db{cap}")
        s.create_all()
        q = load_available(s, f"file:{root}", name, f"file:{tmp_path}/check{cap}", D(2024, 1, 9), files_per_trigger=cap)
        q.awaitTermination(120)
        assert q.exception() is None
        assert sorted((r.query_date.day, r.hr, r.pull_status) for r in s.df(name).collect()) == [(1, 60.0, "fetched"), (2, None, "no_data")]


def test_load_arguments(spark, store):
    d = lambda i: D(2024, 1, i)
    body = frame(spark, "steps", ("a", d(1), 1, steps_body((1, 1), (2, 2), (3, 3), (9, 9))))
    assert load.load_daily(store, body, "steps", d(20), dates=[d(2), d(9)], end=d(8)) == 1
    assert load.load_daily(store, body, "Steps", d(20), end=d(3)) == 2
    for call in (lambda: load.load_daily(store, body, "steps", d(20), start=d(5), end=d(4)),
                 lambda: load.load_intraday(store, body, "heart_rate", d(1), start=d(2)), lambda: load.load_daily(store, body, "spo2_detailed", d(3))):
        with pytest.raises(ValueError):
            call()


def test_repeated_responses_of_activities(spark):
    from restwave.operators import activities
    acts = lambda *ids: json.dumps([{"activityId": str(i), "startTime": f"2024-01-0{i}", "activityType": "running"} for i in ids])
    lists = spark.createDataFrame([("a", 1, acts(3, 2, 1)), ("a", 2, acts(4, 3, 2))], "user_id string, batch int, body string")
    assert sorted(r.activityId for r in activities.activity_list(lists, 3).collect()) == ["2", "3", "4"]
    sets = lambda n: json.dumps({"exerciseSets": [{"reps": n}]})
    twice = spark.createDataFrame([("a", "7", 1, sets(5)), ("a", "7", 2, sets(6)), ("a", "7", 2, sets(6))], "user_id string, activityId string, batch int, body string")
    assert [r.reps for r in activities.strength_sets(twice).collect()] == [6]


def test_nothing_aborts_and_nothing_is_lost_silently(spark, store, tmp_path):
    d = lambda i: D(2024, 1, i)
    item = {"startGMT": "2024-01-01T23:45:00.0Z", "endGMT": "bad", "steps": 12}
    body = frame(spark, "steps_detailed", ("a", d(1), 1, [item, {**item, "startGMT": "2024-01-01T10:00:00+02:00"}, {**item, "startGMT": "soon"}]), ("a", d(2), 1, "{broken"))
    assert load.load_intraday(store, body, "steps", d(9)) == 2
    assert sorted((r.date_time_utc.astimezone(UTC).hour, r.end_gmt) for r in store.df("steps_detailed").collect()) == [(8, None), (23, None)]
    far = frame(spark, "heart_rate_detailed", ("a", d(1), 1, hr_body((1e30, 60), (1e17, 61), (at(2024, 1, 1, 1), 62))))
    assert load.load_intraday(store, far, "heart_rate", d(9)) == 1
    uri = f"file:{tmp_path}/lost"
    assert load.quarantine(store, body, "steps_detailed", uri) == 2 and load.quarantine(store, far, "heart_rate_detailed", uri) == 2
    steps = frame(spark, "steps", ("a", d(1), 1, {"values": [{"calendarDate": "never", "values": {}}, {"calendarDate": "2024-01-01", "values": {}}]}))
    assert load.quarantine(store, steps, "steps", uri) == 1
    assert sorted((r.metric, r.place, r.reason) for r in spark.read.parquet(uri).where("place is not null").collect()) == [
        ("heart_rate_detailed", 0, "instant"), ("heart_rate_detailed", 1, "instant"), ("steps", 0, "date"), ("steps_detailed", 2, "instant")]


def test_flat_intraday_load(spark, store):
    item = {"startGMT": "2024-01-01T10:00:00.0", "endGMT": "2024-01-01T10:15:00.0", "steps": 12}
    body = frame(spark, "steps_detailed", ("a", D(2024, 1, 1), 1, [item]), ("a", D(2024, 1, 2), 1, []),
                 ("a", D(2024, 1, 3), 1, [{**item, "steps": 0}]))
    load.load_intraday(store, body, "steps_detailed", D(2024, 1, 9))
    got = sorted((r.query_date.day, r.steps, r.pull_status, r.start_gmt) for r in store.df("steps_detailed").collect())
    assert got == [(1, 12.0, "fetched", D(2024, 1, 1)), (2, None, "no_data", None)]


def test_update_dispatch(spark, store):
    landed = {"steps": frame(spark, "steps", ("a", D(2024, 1, 1), 1, steps_body((1, 1))))}
    give = lambda name: landed.get(name, landed["steps"].where("false"))
    assert load.update(store, give, "Steps", D(2024, 2, 1)) == 1
    counts = load.update_all(store, give, D(2024, 2, 1))
    assert list(counts) == [table(m).name for m in UPDATE_ORDER] and sum(counts.values()) == 0  # stored already
    for bad in ("Nothing", "Activity"):
        with pytest.raises(ValueError):
            load.update(store, give, bad, D(2024, 2, 1))


def test_streaming_load(spark, store, tmp_path):
    root, name = str(tmp_path / "landing"), "heart_rate_detailed"
    drop_file(root, name, 1, "a", "2024-01-01", hr_body((at(2024, 1, 1, 1), 60)))
    drop_file(root, name, 1, "a", "2024-01-02", {})

    def run():
        q = load_available(store, f"file:{root}", name, f"file:{tmp_path}/check", D(2024, 1, 9))
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.query_date.day, r.hr, r.pull_status) for r in store.df(name).collect())

    assert run() == [(1, 60.0, "fetched"), (2, None, "no_data")]
    drop_file(root, name, 2, "a", "2024-01-03", hr_body((at(2024, 1, 3, 1), 62)))
    assert run() == [(1, 60.0, "fetched"), (2, None, "no_data"), (3, 62.0, "fetched")]


def test_process_and_publish(spark, store, tmp_path, make):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(5)]
    store.upsert("steps", make("user_id string, date date, total_steps double, step_goal double",
                               *[("a", d, float(i), 10.0) for i, d in enumerate(days)]))
    store.upsert("sleep", make("user_id string, date date, deep_time double, local_sleep_start_time double",
                               *[("a", d, 3600.0, None) for d in days]))
    files = FrameStore(spark, f"file:{tmp_path}/out")
    publish.process(store, files, bandwidths=(1, 14))
    publish.publish_series(files)
    assert files.read("processed/sleep.parquet").first().deep_time == 1.0
    wide = files.read("moving_averages/steps.parquet")
    assert wide.count() == 5 and wide.columns[2:6] == ["step_goal_gaussian_1", "step_goal_gaussian_14",
                                                      "step_goal_boxcar_1", "step_goal_boxcar_14"]
    assert {r.date: r.total_steps_boxcar_1 for r in wide.collect()} == {d: float(i) for i, d in enumerate(days)}
    mart = files.read("dashboards/metric_timeseries/steps.parquet")
    assert mart.count() == 5 * 3 * 4
    assert mart.where("is_default and series = 'step_goal'").first().smooth == pytest.approx(10.0)
    assert files.read("dashboards/metric_timeseries/health_stats.parquet").isEmpty()
