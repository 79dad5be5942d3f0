"""Versions of stored tables, compacted landed files, and loads of what is new."""

import datetime as dt
import os
import re
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from restwave.plans import load
from restwave.schemas import INTRADAY_PAYLOADS, PART
from restwave.sources import tables
from restwave.sources.landing import LANDED, BodyStore, from_paths, land, read_landed
from restwave.sources.snapshots import ConcurrentWrite, Manifest, Snapshots, new_commit
from restwave.sources.tables import TableStore
from restwave.streaming import landing as streams
from restwave.streaming.landing import apply_batch
from test_stores_loads import at, drop_file, frame, hr_body, steps_body

D = dt.date
STEPS = "user_id string, date date, total_steps double"


@pytest.fixture
def store(spark, tmp_path):
    s = TableStore(spark, f"file:{tmp_path}/db")
    for name in ("steps", "heart_rate_detailed", "activities"):
        s.create(name)
    return s


def show(df):
    return sorted((r.user_id, r.date, r.total_steps) for r in df.collect())


def test_a_reader_keeps_its_version(store, make, monkeypatch):
    first = make(STEPS, ("a", D(2024, 1, 1), 1.0), ("a", D(2024, 2, 1), 2.0))
    assert store.upsert("steps", first) == 2 and store.version("steps") == 1
    held, before = store.df("steps"), show(store.df("steps"))
    second = make(STEPS, ("a", D(2024, 1, 1), 9.0), ("b", D(2024, 3, 1), 3.0))
    with monkeypatch.context() as m:  # fails after its rows were written, before they are published
        m.setattr(Snapshots, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert("steps", second)
    assert store.version("steps") == 1 and show(store.df("steps")) == show(held) == before
    for _ in range(2):  # and a repeat
        store.upsert("steps", second)
    assert show(held) == before == show(store.df("steps", 1))
    assert show(store.df("steps")) == [("a", D(2024, 1, 1), 9.0), ("a", D(2024, 2, 1), 2.0), ("b", D(2024, 3, 1), 3.0)]
    assert [m.operation for m in store.history("steps")] == ["create", "upsert", "upsert", "upsert"]
    with pytest.raises(ValueError):
        store.df("steps", 17)
    with pytest.raises(ValueError):
        store.df("sleep")  # never created


def test_every_row_is_written_once(store, make):
    store.upsert("steps", make(STEPS, ("a", D(2024, 1, 1), 1.0)))
    store.upsert("steps", make(STEPS, ("a", D(2024, 1, 2), 2.0)))
    root = store.uri("steps")[5:]
    files = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    assert len(files) == 2 and not os.listdir(os.path.join(store.base[5:], "_staging"))
    assert len({f.split(f"{PART}=2024-01/")[1].split("/")[0] for f in files}) == 2


def test_a_second_writer_is_noticed(store, make):
    rows = make(STEPS, ("a", D(2024, 1, 1), 1.0), ("a", D(2024, 2, 1), 2.0))
    store.upsert("steps", rows)
    s, base = store.snapshots("steps"), store.snapshots("steps").manifest()
    store.upsert("steps", make(STEPS, ("a", D(2024, 1, 1), 5.0)))  # meanwhile
    commit = new_commit()
    stored = store._stored("steps", base)
    s.write(stored, commit)
    with pytest.raises(ConcurrentWrite):
        s.publish(base, commit, ["2024-01"], "upsert")
    assert s.publish(base, commit, ["2024-02"], "upsert").version == 3  # others' months stay as they are
    assert show(store.df("steps")) == [("a", D(2024, 1, 1), 5.0), ("a", D(2024, 2, 1), 2.0)]
    assert not s._publish(Manifest(2))


def test_a_clash_is_never_published(store, make):
    schema = "user_id string, activityId string"
    store.add_records("activities", make(schema, ("a", "1"), ("a", "2")))
    before = store.version("activities")
    for rows in ([("a", "3"), ("a", "3")], [("a", "2"), ("a", "9")], [("a", None)]):
        with pytest.raises(ValueError):
            store.add_records("activities", make(schema, *rows))
    assert store.version("activities") == before and store.df("activities").count() == 2
    named = {c for m in store.history("activities") for commits in m.parts.values() for c in commits}
    kept = {d for _, dirs, _ in os.walk(store.uri("activities")[5:]) for d in dirs if d.startswith("commit=")}
    assert kept == {f"commit={c}" for c in named}


def test_expired_versions_are_deleted(store, make):
    for i in range(4):
        store.upsert("steps", make(STEPS, ("a", D(2024, 1, 1), float(i)), ("a", D(2024, 2 + i % 2, 1), 1.0)))
    want = show(store.df("steps"))
    assert store.expire("steps", keep=2) == 0  # all young: a writer may be about to publish them
    assert store.snapshots("steps").versions() == [3, 4] and show(store.df("steps", 3)) != want == show(store.df("steps"))
    assert store.expire("steps", keep=1, grace_seconds=0) > 0 and show(store.df("steps")) == want
    with pytest.raises(ValueError):
        store.expire("steps", keep=0)


# --- landed files ---

def old(root):
    """Sets the directories' times back, as if their files had landed long ago."""
    for d, _, _ in os.walk(root):
        os.utime(d, (time.time() - 100, time.time() - 100))


def test_compaction_takes_each_file_once(spark, tmp_path, monkeypatch):
    root, bodies = str(tmp_path / "landing"), BodyStore(spark, f"file:{tmp_path}/bodies")
    assert bodies.compact(f"file:{root}", "steps") == 0 and bodies.newest("steps") == 0 and bodies.scan("steps").isEmpty()
    drop_file(root, "steps", 1, "a", "2024-01-01", steps_body((1, 5)))
    drop_file(root, "steps", 2, "x+y", "2024-01-02", "{}")
    assert bodies.compact(f"file:{root}", "steps") == 2
    old(root)
    assert bodies.compact(f"file:{root}", "steps") == 0
    opened = []
    monkeypatch.setattr("restwave.sources.landing.from_paths", lambda files, file=False: opened.append(files) or (_ for _ in ()).throw(AssertionError))
    assert bodies.compact(f"file:{root}", "steps") == 0 and not opened  # nothing changed: no directory is opened
    monkeypatch.undo()
    drop_file(root, "steps", 1, "b", "2024-01-03", "{}")  # late, in a directory seen before
    drop_file(root, "steps", 3, "a", "2024-01-01", "{}")
    assert bodies.compact(f"file:{root}", "steps") == 2 and bodies.compact(f"file:{root}", "steps", recheck=True) == 0
    got = sorted((r.batch, r.user_id, r.arrival) for r in bodies.scan("steps").collect())
    assert [(b, u) for b, u, _ in got] == [(1, "a"), (1, "b"), (2, "x+y"), (3, "a")]
    first, second = got[0][2], got[1][2]
    assert [a for *_, a in got] == [first, second, first, second] and second > first
    assert bodies.scan("steps", after=first).count() == 2 and bodies.scan("steps", until=first).count() == 2
    same = ["user_id", "metric", "query_date", "batch", "body"]
    assert sorted(bodies.scan("steps").select(same).collect()) == sorted(read_landed(spark, f"file:{root}", "steps").select(same).collect())


def test_landing_writes_what_reading_gives(spark, tmp_path):
    rows = frame(spark, "steps", ("a/b c", D(2024, 1, 1), 1, "{}"), ("é+1", D(2024, 1, 2), 2, '{"values": []}'))
    assert land(rows, f"file:{tmp_path}") == 2
    got = read_landed(spark, f"file:{tmp_path}", "steps")
    trimmed = got.withColumn("body", F.rtrim(F.translate("body", "\n", "")))
    assert sorted(trimmed.collect()) == sorted(rows.collect()) and os.listdir(tmp_path) == ["metric=steps"]


def test_tasks_write_landed_files_to_a_shared_folder(spark, tmp_path, monkeypatch):
    calls = []
    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda *a, **k: (calls.append(a), text(*a, **k)))
    (tmp_path / "metric=steps" / "batch=1").mkdir(parents=True)
    (tmp_path / "metric=steps" / "batch=1" / ".b_2024-01-01.json.crc").write_bytes(b"stale")
    rows = [("b", D(2024, 1, 1), 1, "{}"), ("b", D(2024, 1, 1), 1, "{}"), (None, D(2024, 1, 2), 1, None), ("x:%*[]", D(2024, 1, 2), 2, "ü\n")]
    landed = spark.createDataFrame([(u, "steps", d, b, x) for u, d, b, x in rows], LANDED)
    assert land(landed, f"file:{tmp_path}") == 3 and land(landed.limit(0), f"file:{tmp_path}") == 0
    assert land(landed.where("batch = 2"), f"file:{tmp_path}") == 1  # once more replaces it
    assert not calls  # no draft that the driver moves file by file
    got = {(r.user_id, r.query_date.day, r.batch, r.body) for r in read_landed(spark, f"file:{tmp_path}", "steps").collect()}
    assert got == {("b", 1, 1, "{}\n{}\n"), ("x:%*[]", 2, 2, "ü\n\n")}
    assert sorted(os.listdir(tmp_path / "metric=steps" / "batch=1")) == ["__HIVE_DEFAULT_PARTITION___2024-01-02.json", "b_2024-01-01.json"]


# --- loads of what is new ---

def test_arrivals_are_opened_once(spark, store, tmp_path):
    bodies, run, name = BodyStore(spark, f"file:{tmp_path}/bodies"), D(2024, 1, 31), "steps"
    assert load.load_new(store, bodies, name, run) == 0
    bodies.append(name, frame(spark, name, ("a", D(2024, 1, 1), 5, steps_body((1, 1), (3, 3))), ("b", D(2024, 1, 1), 5, "{broken")))
    assert load.load_new(store, bodies, name, run) == 2
    version, seen = store.version(name), store.marks(name)[load.ARRIVAL]
    assert load.load_new(store, bodies, name, run) == 0 and store.version(name) == version
    # late: an older batch adds the day that was missing and displaces nothing
    bodies.append(name, frame(spark, name, ("a", D(2024, 1, 1), 4, steps_body((1, 100), (2, 2)))))
    due = bodies.scan(name, seen, bodies.newest(name))
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*arrival#\d+L > {seen}\b", plan)
    assert load.load_new(store, bodies, name, run) == 1
    assert {r.date.day: r.total_steps for r in store.df(name).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}
    assert [(r.user_id, r.reason) for r in store.lost(name).collect()] == [("b", "body")]


def test_restart_leaves_out_ranges_before_the_last_date(spark, store, tmp_path):
    bodies, run = BodyStore(spark, f"file:{tmp_path}/bodies"), D(2024, 3, 31)
    body = lambda day, steps: {"values": [{"calendarDate": day, "values": {"totalSteps": steps}}]}
    bodies.append("steps", frame(spark, "steps", ("a", D(2024, 2, 1), 1, body("2024-02-20", 1))))
    load.load_new(store, bodies, "steps", run)
    bodies.append("steps", frame(spark, "steps", ("a", D(2024, 1, 1), 2, body("2024-01-02", 2)), ("a", D(2024, 1, 25), 2, body("2024-02-21", 3)),
                                 ("c", D(2024, 1, 1), 2, body("2024-01-02", 4))))
    assert load.load_new(store, bodies, "steps", run, restart=True) == 2
    assert sorted(r.total_steps for r in store.df("steps").collect()) == [1.0, 3.0, 4.0]


def test_settled_days_are_left_out_by_key(spark, store, tmp_path):
    bodies, name, p = BodyStore(spark, f"file:{tmp_path}/bodies"), "heart_rate_detailed", INTRADAY_PAYLOADS["heart_rate_detailed"]
    d = lambda i: D(2024, 1, i)
    answers = spark.createDataFrame([("a", "DENIED")], "user_id string, status string")
    bodies.append(name, frame(spark, name, ("a", d(1), 1, hr_body((at(2024, 1, 1, 1), 60))), ("a", d(2), 1, {}), ("a", d(3), 1, {p.available: 50}), ("b", d(3), 1, {p.available: 50})))
    load.load_new(store, bodies, name, d(9), answers=answers)
    bodies.append(name, frame(spark, name, *[(u, d(i), 2, hr_body((at(2024, 1, i, 5), 90 + i))) for u in "ab" for i in (1, 2, 3, 4)]))
    due = bodies.scan(name, store.marks(name)[load.ARRIVAL])
    kept = load.unsettled(store, due, name)
    assert sorted((r.user_id, r.query_date.day) for r in kept.collect()) == [("a", 3), ("a", 4), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
    lines = load.unsettled(store, due, name)._jdf.queryExecution().executedPlan().toString().split("\n")
    anti = next(i for i, line in enumerate(lines) if "LeftAnti" in line)
    scans = [line.split("FileScan parquet ")[1].split("]")[0] for line in lines[anti:] if "FileScan parquet" in line]
    assert len(scans) == 2 and not any("body#" in s for s in scans)  # only keys meet the settled days
    load.load_new(store, bodies, name, d(9))
    assert sorted((r.user_id, r.query_date.day, r.hr, r.pull_status) for r in store.df(name).collect() if r.hr) == [
        ("a", 1, 60.0, "fetched"), ("a", 3, 93.0, "fetched"), ("a", 4, 94.0, "fetched"), *[("b", i, 90.0 + i, "fetched") for i in (1, 2, 3, 4)]]


def test_a_micro_batch_is_read_once_for_both_sinks(spark, store, tmp_path, monkeypatch):
    days = [("a", D(2024, 1, i), i, steps_body((i, i))) for i in range(1, 5)] + [("b", D(2024, 1, 1), 1, "{broken")]
    land(frame(spark, "steps", *days), f"file:{tmp_path}/landing")
    held, key = [], "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    monkeypatch.setattr(streams, "apply_batch", lambda store, batch, epoch, *a: (
        held.append((batch.storageLevel.useMemory, batch.sparkSession.conf.get(key))), apply_batch(store, batch, epoch, *a)))
    query = streams.load_available(store, f"file:{tmp_path}/landing", "steps", f"file:{tmp_path}/check", D(2024, 1, 9), files_per_trigger=3)
    query.awaitTermination(120)
    assert query.exception() is None and held == [(True, spark.conf.get("spark.sql.shuffle.partitions"))] * 2
    assert spark.conf.get(key) == before and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert sorted(r.total_steps for r in store.df("steps").collect()) == [1.0, 2.0, 3.0, 4.0]
    assert [(r.user_id, r.reason) for r in store.lost("steps").collect()] == [("b", "body")]


def test_a_repeated_micro_batch_changes_neither_sink(spark, store, monkeypatch):
    good = frame(spark, "steps", ("a", D(2024, 1, 1), 1, steps_body((1, 1))), ("b", D(2024, 1, 1), 1, "{broken"))
    run = lambda epoch, rows: apply_batch(store, rows, epoch, "steps", "s", D(2024, 1, 9))
    with monkeypatch.context() as m:  # fails between the sinks
        m.setattr(tables.TableStore, "add_lost", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run(0, good)
    assert run(0, good) == 0 and run(0, good) == 0  # the rows are there; the quarantine follows once
    assert store.df("steps").count() == 1 and store.lost("steps").count() == 1
    other = frame(spark, "steps", ("a", D(2024, 1, 2), 1, steps_body((2, 2))))
    assert run(0, other) == 0 and run(1, other) == 1 and store.lost().count() == 1
    assert LANDED.startswith("user_id")


# --- many small batches ---

VERSIONED = f"{STEPS}, step_goal double, total_distance double, date_pulled date, _rank int, _batch bigint, _asked date, _entry int, _item int"


def test_deferred_upserts_give_what_merged_ones_give(spark, tmp_path, make, monkeypatch):
    monkeypatch.setattr(tables, "DEFERRED", 3)
    row = lambda u, d, x, batch, rank=1, item=0: (u, d, x, None, float("nan"), D(2024, 3, batch + 1), rank, batch, D(2024, 1, 1), 0, item)
    jan, feb = D(2024, 1, 5), D(2024, 2, 5)
    batches = [[row("a", jan, 1.0, 2), row("b", jan, 2.0, 2)],
               [row("a", jan, 9.0, 1), row("b", jan, 3.0, 3), row("new", feb, 4.0, 3)],  # older, newer, another month
               [row("b", jan, 5.0, 3), row("a", feb, 6.0, 0, 0), row("c", jan, 6.5, 4)],  # the same version: the first stays
               [row("a", feb, None, 0, 0, 1), row("c", jan, 7.0, 4, 1, 1)], [row("d", jan, 8.0, 5)]]
    shown, counts = [], []
    for defer in (False, True):
        store = TableStore(spark, f"file:{tmp_path}/db{defer}")
        store.create("steps")
        store.add_records("steps", make("id bigint, user_id string, date date, step_goal double", (7, "c", jan, 1.0)))
        counts.append([store.upsert("steps", make(VERSIONED, *b), {"m": i}, defer) for i, b in enumerate(batches)])
        store.upsert("steps", make(STEPS, ("d", jan, 10.0)))  # merges January and has no version
        assert store.upsert("steps", make(VERSIONED, row("e", jan, 1.0, 1)), {"m": 9}, defer) == 1
        assert store.upsert("steps", make(VERSIONED), {"m": 10}, defer) == 0 and store.marks("steps")["m"] == 10
        shown.append(sorted(map(tuple, store._stored("steps").select("id", "user_id", "date", "total_steps", "total_distance", "date_pulled", "_rank", "_batch", "_item", PART).collect()), key=repr))
        with pytest.raises(ValueError):
            store.upsert("steps", make(VERSIONED, row(None, jan, 1.0, 1)), None, defer)
    assert shown[0] == shown[1] and counts == [[2, 2, 2, 2, 1], [2, 3, 3, 2, 1]]
    done = [m.operation for m in store.history("steps")]
    assert done == ["create", "insert", "defer", "defer", "defer", "merge", "defer", "merge", "defer", "upsert", "defer", "mark"]
    now = store._manifest("steps")
    assert {v: len(c) for v, c in now.deltas.items()} == {"2024-01": 1} and show(store.df("steps", 4)) == show(store.df("steps", 5))
    before = [show(store.df("steps", v)) for v in (3, now.version)]
    assert store.merge("steps") == ["2024-01"] and store.merge("steps") == []
    assert [show(store.df("steps", v)) for v in (3, now.version)] == before and show(store.df("steps")) == before[-1]
    store.expire("steps", keep=2, grace_seconds=0)
    assert show(store.df("steps", now.version)) == before[-1] == show(store.df("steps"))


def test_a_merge_gives_way_to_another_writer(store, make, monkeypatch):
    row = ("a", D(2024, 1, 1), 1.0, None, None, D(2024, 1, 2), 1, 1, D(2024, 1, 1), 0, 0)
    store.upsert("steps", make(VERSIONED, row), defer=True)
    write = Snapshots.write
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "write", lambda s, rows, commit: (
            m.undo(), write(s, rows, commit), store.upsert("steps", make(STEPS, ("a", D(2024, 1, 1), 5.0)))))
        assert store.merge("steps") == []
    assert show(store.df("steps")) == [("a", D(2024, 1, 1), 5.0)] and not store._manifest("steps").deltas


def test_the_newest_version_is_found_without_a_list(store, make, monkeypatch):
    store.upsert("steps", make(STEPS, ("a", D(2024, 1, 1), 1.0)))
    assert store.version("steps") == 1
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "versions", lambda s: 1 / 0)
        assert store.upsert("steps", make(STEPS, ("a", D(2024, 1, 1), 2.0))) == 1 and store.version("steps") == 2
    store.drop("steps")
    with pytest.raises(ValueError):
        store.version("steps")
    store.create("steps")
    assert store.version("steps") == 0


def test_a_stream_adds_micro_batches_without_rewriting(spark, store, tmp_path, monkeypatch):
    land(frame(spark, "steps", *[("a", D(2024, 1, i), i, steps_body((1, i), (i, i))) for i in range(1, 5)]), f"file:{tmp_path}/landing")
    sessions, made = [], streams.stream_landed
    monkeypatch.setattr(streams, "stream_landed", lambda s, *a: (sessions.append(s), made(s, *a))[1])
    query = streams.load_available(store, f"file:{tmp_path}/landing", "steps", f"file:{tmp_path}/check", D(2024, 1, 9), files_per_trigger=1)
    query.awaitTermination(120)
    assert query.exception() is None and show(store.df("steps")) == [("a", D(2024, 1, 1), 4.0), *[("a", D(2024, 1, i), float(i)) for i in (2, 3, 4)]]
    assert [m.operation for m in store.history("steps")] == ["create", *["defer"] * 4] and len(store._manifest("steps").deltas["2024-01"]) == 4
    # the session in which the source lists each micro-batch keeps its few tasks
    assert sessions[0].conf.get(streams.LISTING) == "4" != spark.conf.get(streams.LISTING)


def test_tasks_list_and_read_landed_files(spark, tmp_path):
    rows = [("a b+", D(2024, 1, 1), 1, "{}"), ("ü/%", D(2024, 1, 2), 2, "é\n")]
    land(frame(spark, "steps", *rows), f"file:{tmp_path}")
    folder = tmp_path / "metric=steps" / "batch=1"
    for name, body in ((".h_2024-01-01.json", b"x"), ("_h_2024-01-01.json", b"x"), ("empty_2024-01-01.json", b""), ("odd.json", b"x"), ("bad_2024-01-03.json", b"\xff{")):
        (folder / name).write_bytes(body)
    (folder / "_gone").mkdir()
    (folder / "_gone" / "metric=steps").mkdir()
    got = read_landed(spark, f"file:{tmp_path}", "steps")
    assert "MapInArrow" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "FileScan" not in plan
    told = lambda df: sorted(map(tuple, df.withColumn("body", F.hex("body")).collect()))
    assert told(got) == told(from_paths(spark.read.text(f"file:{tmp_path}/metric=steps", wholetext=True, recursiveFileLookup=True)))
    assert [r.user_id for r in got.orderBy("user_id").collect()] == ["a b+", "bad", "ü/%"] and got.where("batch = 2").count() == 1
