"""Chunked files, plug-ins in SQL, digests without contents, and streams with state of their own."""

import hashlib
import os
import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from treeline.operators import dedup
from treeline.plans.registry import expose
from treeline.sources import chunks, listing
from treeline.streaming import keyed, progress


@pytest.fixture()
def odd(tmp_path):
    data = {".env": b"secret", "_build/x": random.Random(1).randbytes(10_000), "a/zero": b"", "a/exact": b"z" * 2000,
            "a/b/.hid/long.bin": random.Random(2).randbytes(25_001), "a/b/new\nline": b"odd name"}
    for name, value in data.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(value)
    os.symlink(tmp_path / "in" / ".env", tmp_path / "in" / "link")
    return tmp_path / "in", data


def test_chunks_hold_every_byte(spark, odd):
    root, data = odd
    rows = chunks.read_files(spark, [str(root)], chunk_bytes=1000, partition_bytes=70_000).collect()
    found = {}
    for r in sorted(rows):
        found.setdefault(os.path.relpath(r.path, root), []).append(r)
    assert set(found) == set(data)
    for name, some in found.items():
        assert b"".join(r.content for r in some) == data[name] and [r.chunk for r in some] == list(range(len(some)))
        assert [r.offset for r in some] == [1000 * i for i in range(len(some))] and all(r.length == len(r.content) for r in some)
        assert {r.size for r in some} == {len(data[name])} and all(r.error is None and r.mod_time is not None for r in some)
    whole = {os.path.relpath(r.path, root): r for r in chunks.whole_digests(chunks.read_files(spark, [str(root)], chunk_bytes=999)).collect()}
    assert {n: r.hash for n, r in whole.items()} == {n: hashlib.sha256(v).hexdigest() for n, v in data.items()}
    assert whole["_build/x"].chunks == 11 and whole["a/zero"].chunks == 1


def test_partitions_have_about_equal_bytes(spark, odd):
    root, data = odd
    plan = chunks.plan_chunks(listing.scan_tree(spark, [str(root)]).filter("NOT is_dir"), str(root.parent / "plan"), 1000, 100_000, limit=5)
    sizes = [sum(r["length"] + chunks.OPENING for r in chunks._planned(e.path)) for e in os.scandir(plan) if e.name.startswith("part=")]
    assert len(sizes) > 20 and max(sizes) <= 100_000 + 1000 + chunks.OPENING


def test_refused_files_are_not_opened(spark, odd):
    root, data = odd
    (root / "a" / "exact").chmod(0)
    plan = chunks.plan_chunks(listing.scan_tree(spark, [str(root)]).filter("NOT is_dir"), str(root.parent / "plan"), 1 << 20)
    reader = chunks._Reader({"plan": plan})
    ds = chunks.ds
    given = [ds.StringStartsWith(("name",), "."), ds.GreaterThan(("size",), 5), ds.Not(ds.EqualTo(("name",), "x")),
             ds.EqualTo(("content",), b""), ds.GreaterThan(("mod_time",), None)]
    assert list(reader.pushFilters(given)) == given[3:]
    opened, real = [], open
    try:
        chunks.open = lambda path, *a: opened.append(os.path.basename(path)) or real(path, *a)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        del chunks.open
    assert opened == [".env"] and [r["content"] for r in rows] == [b"secret"]
    df = chunks.read_files(spark, [str(root)]).filter(F.col("name").startswith(".") & (F.col("size") > 5))
    assert df.count() == 1 and "Filter" not in df._jdf.queryExecution().executedPlan().toString().split("Scan")[0]


def test_files_that_cannot_be_read_are_rows(spark, odd):
    root, data = odd
    (root / "link").unlink()
    plan = chunks.plan_chunks(listing.scan_tree(spark, [str(root)]).filter("NOT is_dir"), str(root.parent / "plan"), 4096)
    (root / "_build" / "x").unlink()
    (root / ".env").write_bytes(b"s")
    reader = chunks._Reader({"plan": plan})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    bad = {r["name"]: r for r in rows if r["error"]}
    assert set(bad) == {"x", ".env"} and all(r["content"] is None for r in bad.values()) and "shorter" in bad[".env"]["error"]
    with pytest.raises(ValueError, match="mount"):
        chunks.read_files(spark, ["s3://bucket/x"])
    assert chunks.read_files(spark, [str(root / "a" / "b" / ".hid" / "none")]).filter("error IS NULL").count() == 0


def test_scan_content_has_hidden_names(spark, odd, monkeypatch):
    root, data = odd
    got = {os.path.relpath(r.path, root): bytes(r.content) for r in listing.scan_content(spark, str(root)).collect()}
    assert got == data
    assert [r.name for r in listing.scan_content(spark, f"file:{root}", "*.bin").collect()] == ["long.bin"]
    monkeypatch.setattr(listing, "WHOLE_BYTES", 5000)
    large = {r.name: r.error for r in listing.scan_content(spark, str(root)).filter("content IS NULL").collect()}
    assert large == {"x": "too large for one value", "long.bin": "too large for one value"}


def test_tasks_follow_the_folders(spark, tmp_path, monkeypatch):
    assert listing.listing_tasks(spark, 10_000) == 50 and listing.listing_tasks(spark, 3) == spark.sparkContext.defaultParallelism
    for i in range(60):
        (tmp_path / f"d{i}" / "e").mkdir(parents=True)
    monkeypatch.setattr(listing, "FOLDERS_PER_TASK", 4)
    asked, real = [], listing.listing_tasks
    monkeypatch.setattr(listing, "listing_tasks", lambda s, n: asked.append((n, real(s, n))) or asked[-1][1])
    assert listing.scan_tree(spark, [str(tmp_path)]).count() == 121
    assert asked == [(1, 8), (60, 15), (60, 15)]


def test_first_difference_and_chunk_roots(spark):
    base = b"abcdefgh" * 100
    rows = [("/a", base, True), ("/b", base, False), ("/c", base[:500] + b"X" + base[501:], False), ("/d", base[:300], False), ("/e", None, False)]
    files = spark.createDataFrame([(p, c) for p, c, _ in rows], "path string, content binary")
    members = spark.createDataFrame([(p, "g", 800, k) for p, _, k in rows], "path string, group_id string, size bigint, keep boolean")
    got = {r.path: (r.identical, r.differs_at) for r in dedup.verify_bytes(files, members, chunk_bytes=64).collect()}
    assert got["/a"] == got["/b"] == (True, None) and got["/c"] == (False, 448) and got["/d"] == (False, 256) and got["/e"][0] is False
    roots = {r.path: r.root for r in files.select("path", dedup.chunk_root(dedup.chunk_digests("content", 64)).alias("root")).collect()}
    parts = b"".join(hashlib.sha256(base[i : i + 64]).digest() for i in range(0, 800, 64))
    assert roots["/a"] == roots["/b"] == hashlib.sha256(parts.hex().upper().encode()).hexdigest() != roots["/c"]


def _moved(df):
    """The columns that the plan's exchanges carry."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return " ".join(re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]", text))


def test_contents_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"/{i}", bytes(rng.choices(range(256), k=4000)) if i % 3 else b"same" * 1000, i) for i in range(300)]
    files = spark.createDataFrame(rows, "path string, content binary, t int").repartition(4).select(
        "path", "content", F.length("content").cast("bigint").alias("size"), F.timestamp_seconds("t").alias("mod_time"))
    files.write.parquet(path := f"{spark.sparkContext.getCheckpointDir()}/contents-{rng.random()}")
    files = spark.read.parquet(path)
    before, moved, cut = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: moved.append(_moved(df)) or cut(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups, members = dedup.staged_duplicates(files, "blake2b")
        checked = dedup.verify_bytes(files, members)
        moved.append(_moved(checked))
        assert groups.first().files == 100 and checked.filter("identical").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(moved) and "content" not in " ".join(moved) and "strong" in " ".join(moved)


def test_unreadable_files_stay_as_rows(spark, tmp_path):
    for name in ("a", "b", "c", "d"):
        (tmp_path / name).write_bytes(b"x" * 50)
    inv = listing.scan_tree(spark, [str(tmp_path)]).filter("NOT is_dir")
    inv = spark.createDataFrame(inv.collect(), listing.LISTING)  # as it was
    (tmp_path / "c").unlink()
    groups, members = dedup.staged_file_duplicates(inv)
    got = {os.path.basename(r.path): r for r in members.collect()}
    assert groups.first().files == 3 and set(got) == {"a", "b", "c", "d"}
    assert got["c"].error and got["c"].group_id is None and not got["a"].error and got["d"].identical


def test_plugins_in_sql(spark):
    class Twice:
        name, version, schema = "twice", "1", "k bigint, n int"

        def validate(self, times=2):
            if times < 0:
                raise ValueError("negative")

        def rows(self, row, times=2):
            for i in range(times):
                yield row["id"], i

    expose(spark, Twice(), times=3)
    spark.range(2).createOrReplaceTempView("some_ids")
    assert sorted(map(tuple, spark.sql("SELECT * FROM twice(TABLE(some_ids))").collect())) == [(k, n) for k in range(2) for n in range(3)]
    with pytest.raises(ValueError, match="negative"):
        expose(spark, Twice(), times=-1)


BASE = 1_000_000_000


def _lots(spark, folder, lots, schema):
    for lot in lots:  # a watermark begins at 1970, so nothing is that old
        spark.createDataFrame(lot, schema).withColumn("ts", F.timestamp_seconds(F.col("t") + BASE)).drop("t").coalesce(1).write.mode("append").parquet(str(folder))
    first = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").schema
    return progress.read_stream(spark, str(folder), first, "*.parquet", files_per_trigger=1)


def test_state_of_finished_operations_leaves(spark, tmp_path):
    hour = 3600
    lots = [
        [(i, 0, "start") for i in range(50)] + [(99, 0, "start")],
        [(i, hour, "complete") for i in range(40)] + [(99, 2 * hour, "start")],
        [(99, 40 * hour, "pause"), (3, hour // 2, "pause")],  # far ahead; one event late
        [(99, 90 * hour, "resume"), (5, 89 * hour, "start")],  # 5 begins anew before its state has gone
    ]
    watch = []
    stream = _lots(spark, tmp_path, lots, "id bigint, t bigint, kind string")
    out = keyed.retained_status(stream, timedelta(hours=10), "60 hours")
    updates = progress.run_available(out, "update", "retained", watch).collect()
    states = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in watch]
    assert max(states) == 51 and states[-1] == 12  # ten still run, 99, and 5
    evicted = [r for r in updates if r.evicted]
    assert sorted(r.id for r in evicted) == [i for i in range(40) if i != 5] and all(r.status == "completed" and r.end_us == (BASE + hour) * 1_000_000 for r in evicted)
    assert {r.events for r in evicted if r.id == 3} == {3}
    last = {r.id: r for r in sorted(updates, key=lambda r: r.batch)}
    assert last[99].status == "running" and last[45].status == "running" and not last[45].evicted


def test_silent_operations_are_reported(spark, tmp_path):
    lots = [[("a", 5, "running"), ("b", 7, "running")], [("b", 12, "idle"), ("a", 3, "idle")], [("c", 55, "running")], [("a", 58, "idle"), ("z", 100, "idle")]]
    watch = []
    stream = _lots(spark, tmp_path, lots, "id string, t bigint, status string")
    report = keyed.running_report(stream, timedelta(seconds=10), "20 seconds")
    rows = progress.run_available(report, "append", "silent", watch).collect()
    got = sorted((r.id, r.window_us // 1_000_000 - BASE, r.samples, r.last_us // 1_000_000 - BASE) for r in rows)
    a = [("a", 0, 2, 5)] + [("a", w, 0, 5) for w in (10, 20, 30, 40)]
    assert got == a + [("b", 0, 1, 7)] + [("c", 50, 1, 55), ("c", 60, 0, 55), ("c", 70, 0, 55)]
    assert sum(s["numRowsTotal"] for s in watch[-1]["stateOperators"]) == 2  # c runs, z has a sample that may still count


def test_operations_share_the_calls_and_states_of_their_group(spark, tmp_path):
    hour, many = 3600, 4000
    lots = [
        [(i, 0, "start") for i in range(many)] + [(None, 0, "start")],
        [(i, hour, "complete") for i in range(0, many, 2)] + [(None, hour, "fail")],
        [(1, 40 * hour, "pause")],
        [(1, 90 * hour, "resume")],
    ]
    watch = []
    stream = _lots(spark, tmp_path, lots, "id bigint, t bigint, kind string")
    updates = progress.run_available(keyed.retained_status(stream, timedelta(hours=10), "20 hours"), "update", "shared", watch).collect()
    assert 0 < max(s["numRowsTotal"] for p in watch for s in p["stateOperators"]) <= keyed.GROUPS < many
    gone = [r.id for r in updates if r.evicted]
    assert len(gone) == many // 2 + 1 and set(gone) == {None, *range(0, many, 2)}
    last = {r.id: r.status for r in sorted(updates, key=lambda r: r.batch)}
    assert all(last[i] == ("completed" if i % 2 == 0 else "running") for i in range(many)) and last[None] == "failed"


def test_reports_of_operations_that_share_a_group(spark, tmp_path):
    many = 4000
    lots = [[(i, 5, "running") for i in range(many)] + [(None, 5, "running")], [(i, 12, "idle") for i in range(1, many)], [(0, 58, "idle"), (1, 90, "idle")], [(2, 95, "idle")]]
    watch = []
    stream = _lots(spark, tmp_path, lots, "id bigint, t bigint, status string")
    report = keyed.running_report(stream, timedelta(seconds=10), "20 seconds")
    rows = progress.run_available(report, "append", "shared-report", watch).collect()
    got = sorted((-1 if r.id is None else r.id, r.window_us // 1_000_000 - BASE, r.samples) for r in rows)
    silent = [(w, int(w == 0)) for w in range(0, 70, 10)]
    want = [(-1, *x) for x in silent] + [(0, *x) for x in silent[:5]] + [(i, 0, 1) for i in range(1, many)]
    assert [r for r in got if r[1] < 60] == sorted(r for r in want if r[1] < 60)
    assert 0 < max(s["numRowsTotal"] for p in watch for s in p["stateOperators"]) <= keyed.GROUPS < many


def _reports(samples, step, end):
    """What running_report is to say of (id, t, status) up to the interval end ``end``."""
    out, by_id = [], {}
    for key, t, status in samples:
        by_id.setdefault(key, []).append((t, status))
    for key, got in by_id.items():
        for tick in range(min(got)[0] // step * step + step, end + 1, step):
            last = max((x for x in got if x[0] < tick), key=lambda x: (x[0], x[1] or ""))
            if last[1] == "running":
                out.append((str(key), tick - step, sum(tick - step <= t < tick for t, _ in got), last[0]))
    return sorted(out)


def _said(rows):
    return sorted((str(r.id), r.window_us // 1_000_000 - BASE, r.samples, r.last_us // 1_000_000 - BASE) for r in rows)


def test_reports_of_late_and_equal_samples(spark, tmp_path):
    rng = random.Random(11)
    lots = []
    for n in range(5):
        places = [(rng.choice([None, *range(30)]), rng.randrange(max(0, 200 * n - 300), 200 * n + 200)) for _ in range(400)]
        lots.append([(k, t, rng.choice(["running", "running", "idle", "stopped"]) if t % 7 else None) for k, t in places])
    lots.append([(99, 2003, "idle")])
    stream = _lots(spark, tmp_path, lots, "id bigint, t bigint, status string")
    report = keyed.running_report(stream, timedelta(seconds=10), "500 seconds")
    rows = progress.run_available(report, "append", "late-report").collect()
    assert _said(rows) == _reports([x for lot in lots for x in lot], 10, 1500)


def test_silence_leaves_the_function_as_one_row(spark, tmp_path):
    lots = [[(1, 5, "running"), (2, 7, "running"), (2, 95_004, "idle"), (3, 8, "idle")], [(1, 200_000, "idle")]]
    stream = _lots(spark, tmp_path, lots, "id bigint, t bigint, status string")
    report = keyed.running_report(stream, timedelta(seconds=10), "15 seconds")
    assert "Generate explode(sequence" in report._jdf.queryExecution().analyzed().toString()
    rows = progress.run_available(report, "append", "silence").collect()
    assert len(rows) > 5 * keyed.RUN and _said(rows) == _reports([x for lot in lots for x in lot], 10, 199_980)


def test_sample_without_a_time_is_in_no_interval(spark, tmp_path):
    lots = [[(1, 5, "running"), (1, None, "idle"), (2, None, "running")], [(3, 100, "idle")]]
    stream = _lots(spark, tmp_path, lots, "id bigint, t bigint, status string")
    report = keyed.running_report(stream, timedelta(seconds=10), "65 seconds")
    rows = progress.run_available(report, "append", "timeless").collect()
    assert _said(rows) == [("1", w, int(w == 0), 5) for w in (0, 10, 20)]


def test_keys_are_looked_up_not_read_again(spark, tmp_path):
    rng = random.Random(7)
    lots = [[(rng.randrange(300), i) for _ in range(100)] for i in range(20)]
    for lot in lots:
        spark.createDataFrame(lot, "k bigint, v int").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = progress.read_stream(spark, str(tmp_path), "k bigint, v int", "*.parquet", files_per_trigger=1)
    watch = []
    got = progress.run_unseen(stream, ["k"], "seen", watch).collect()
    keys = {k for lot in lots for k, _ in lot}
    assert sorted(r.k for r in got) == sorted(keys)
    assert [p["numInputRows"] for p in watch] == [100] * 20  # a micro-batch reads its own rows
    assert sum(s["numRowsUpdated"] for p in watch for s in p["stateOperators"]) == len(keys)


def test_subscribers_get_every_row_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, j) for j in range(10)], "id bigint, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = progress.read_stream(spark, str(tmp_path / "in"), "id bigint, v int", "*.parquet", files_per_trigger=1)
    calls, broken = [], [True]

    def first(rows, number):
        calls.append(number)
        rows.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    def second(rows):
        if broken and len(calls) == 2:
            raise RuntimeError("killed")

    for attempt in range(2):
        query = progress.subscribe(stream, {"*": first, 1: second}, str(tmp_path / "state"))
        try:
            query.awaitTermination()
        except Exception:
            assert attempt == 0
            broken.clear()
    assert calls == [0, 1, 2]  # the batch that failed at the second handler is not handed to the first again
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_frequency_signature_of_a_wave(spark):
    import math

    from treeline.operators.signatures import frequency_signature

    wave = [math.cos((2 * x + 1) * 3 * math.pi / 16) * math.cos((2 * y + 1) * 2 * math.pi / 16) for y in range(8) for x in range(8)]
    row = spark.createDataFrame([(wave,)], "v array<double>").select(frequency_signature("v").alias("s")).first().s
    bits = sum(v << 16 * i for i, v in enumerate(row))
    assert bits >> (2 * 8 + 3) & 1  # row frequency 2, column frequency 3 stands out
