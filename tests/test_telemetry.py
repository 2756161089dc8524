import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from treeline.operators import telemetry
from treeline.streaming import progress

KINDS = ("start", "pause", "resume", "complete", "fail", "cancel")


class Operation:
    """The life cycle one event at a time."""

    def __init__(self):
        self.status, self.start, self.end = "pending", None, None

    def on(self, kind, t):
        if kind == "start":
            self.status, self.start, self.end = "running", t, None
        elif kind in ("complete", "fail", "cancel"):
            self.status, self.end = {"complete": "completed", "fail": "failed", "cancel": "cancelled"}[kind], t
        elif kind == "pause" and self.status == "running":
            self.status = "paused"
        elif kind == "resume" and self.status == "paused":
            self.status = "running"
        return self.status


@pytest.fixture(scope="module")
def life():
    rnd = random.Random(11)
    ids = [rnd.choice([1, 1, 2, 3, 4, rnd.randrange(5, 40)]) for _ in range(900)]
    weights = (2, 4, 4, 1, 1, 1)
    return [(i, t, rnd.choices(KINDS, weights)[0]) for t, i in enumerate(ids)]


def events(spark, life):
    return spark.createDataFrame(life, "id bigint, t bigint, kind string").withColumn("ts", F.timestamp_seconds("t")).drop("t")


@pytest.fixture(scope="module")
def folded(life):
    ops, history = {}, []
    for i, t, kind in life:
        history.append((i, t, ops.setdefault(i, Operation()).on(kind, t)))
    return {i: (o.status, o.start, o.end) for i, o in ops.items()}, history


def _epoch(v):
    return None if v is None else int(v.timestamp())


def test_life_cycle(spark, life, folded):
    got = telemetry.life_cycle(events(spark, life).repartition(7)).collect()
    assert {r["id"]: (r["status"], _epoch(r["start_time"]), _epoch(r["end_time"])) for r in got} == folded[0]


@pytest.mark.parametrize("limit", [20, 10**6])
def test_status_history(spark, life, folded, limit):
    got = telemetry.status_history(events(spark, life), limit=limit)
    assert sorted((r["id"], _epoch(r["ts"]), r["status"]) for r in got.collect()) == sorted(folded[1])


def test_stream_gives_the_batch_result(spark, life, folded, tmp_path):
    """Several micro-batches, each with events of all times: late events count as well."""
    source = str(tmp_path / "events")
    events(spark, life).repartition(5).write.parquet(source)
    stream = progress.read_stream(spark, source, events(spark, life).schema, "*.parquet", files_per_trigger=1)
    updates = progress.run_available(progress.live_status(stream), "update", "status")
    assert updates.select("batch").distinct().count() == 5
    now = progress.last_update(updates, ["id"])
    assert {r["id"]: r["status"] for r in now.collect()} == {i: s for i, (s, _, _) in folded[0].items()}
    # the latest snapshot over batches
    last = progress.last_update(progress.run_available(progress.progress_state(stream), "update", "last"), ["id"])
    want = {i: (t, k) for i, t, k in life}
    assert {r["id"]: (_epoch(r["ts"]), r["kind"]) for r in last.collect()} == want


def test_first_seen_and_resume(spark, tmp_path):
    source = str(tmp_path / "files")
    rows = [(f"/f{i}", i % 4, f"h{i % 6}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, size int, hash string, t bigint").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.repartition(4).write.parquet(source)
    stream = progress.read_stream(spark, source, df.schema, "*.parquet", files_per_trigger=1)
    seen = progress.run_available(progress.first_seen(stream, ["size", "hash"], "1 hour"), "append", "seen")
    assert seen.select("size", "hash").count() == df.select("size", "hash").distinct().count() == 12
    known = df.filter("hash IN ('h0', 'h1')")
    fresh = progress.run_available(progress.not_yet_known(stream, known, ["size", "hash"]), "append", "fresh")
    assert fresh.count() == df.filter("hash NOT IN ('h0', 'h1')").count()


def samples(spark, points):
    df = spark.createDataFrame(points, "id string, t double, items bigint, bytes bigint, total_items bigint")
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))).drop("t")


def test_speed_and_eta(spark):
    one = [("one", 0.0, 5, 0, 10)]
    same = [("same", 1.0, 5, 0, 0), ("same", 1.0, 9, 0, 0)]
    many = [("many", float(t), t * t, 0, 200) for t in range(12)]
    timed = telemetry.eta(telemetry.speed(samples(spark, one + same + many), ("ts", "items")))
    got = {(r["id"], r["items"]): (r["speed"], r["eta"]) for r in timed.collect()}
    assert got["one", 5] == (0, None) and got["same", 9] == (0, None)
    # twelve samples: from the third (4 at 2 s) to the last (121 at 11 s)
    assert got["many", 121] == (13, 6)
    assert got["many", 0] == (0, None) and got["many", 9] == (3, 63)
    done = [("d", 0.0, 0, 0, 5), ("d", 1.0, 5, 0, 5)]
    assert [r["eta"] for r in telemetry.eta(telemetry.speed(samples(spark, done))).orderBy("ts").collect()] == [None, None]


@pytest.mark.parametrize("limit", [4, 10**6])
def test_speed_of_a_hot_operation(spark, limit):
    rnd = random.Random(4)
    points, total = [], 0
    for t in range(200):
        total += rnd.randrange(50)
        points.append(("hot", t + rnd.random() / 2, total, total * 3, 10**6))
    got = telemetry.speed(samples(spark, points), limit=limit).orderBy("ts").collect()
    micros = [int(p[1] * 1e6) for p in points]
    for i, r in enumerate(got):
        j = max(0, i - 9)
        want = 0 if i == j else int((points[i][2] - points[j][2]) / ((micros[i] - micros[j]) / 1e6))
        assert r["speed"] == want
    rates = telemetry.instant_rate(samples(spark, points), limit=limit).orderBy("ts").collect()
    assert rates[0]["items_per_sec"] == 0
    for i in range(1, 200):
        grown, span = points[i][2] - points[i - 1][2], (micros[i] - micros[i - 1]) / 1e6
        assert abs(rates[i]["items_per_sec"] - (grown / span if grown > 0 else 0)) < 1e-9


def test_steps(spark):
    rows = [("o", 1, None), ("o", 2, "scan"), ("o", 3, None), ("o", 4, "remove")]
    df = spark.createDataFrame(rows, "id string, ts int, step string")
    got = telemetry.step_progress(df, limit=2).orderBy("ts").collect()
    assert [(r["steps_completed"], r["current_step"]) for r in got] == [
        (0, "Initializing"), (1, "scan"), (1, "scan"), (2, "remove")]


def test_eviction(spark):
    rows = [("run", "running", 1), ("old", "failed", 1), ("new", "completed", 99), ("open", "failed", None)]
    ops = spark.createDataFrame(rows, "id string, status string, t bigint").withColumn("end_time", F.timestamp_seconds("t"))
    kept = telemetry.evict_finished(ops, F.timestamp_seconds(F.lit(100)), timedelta(seconds=50))
    assert sorted(r["id"] for r in kept.collect()) == ["new", "open", "run"]


def test_stream_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = progress.read_stream(spark, str(tmp_path / "none"), "id bigint, ts timestamp")
    assert progress.run_available(stream, "append", "none").count() == 0
