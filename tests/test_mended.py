"""Cases off the given tables that were once wrong."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeline.operators import content, dedup, ownership, snapshot, tree
from treeline.plans.registry import builtin_registry
from treeline.plans.workflow import validate_workflows
from treeline.skew import skew_join
from treeline.sources import listing, tables
from treeline.streaming import progress

INV = "path string, name string, size bigint, mod_time timestamp, is_dir boolean, mode bigint, error string"


def inventory(spark, *rows):
    """Paths; a directory ends with '/', one that could not be listed with '/!'."""
    out = []
    for r in rows:
        path = r.rstrip("/!") or "/"
        out.append((path, path.rsplit("/", 1)[-1], 1, None, r.endswith(("/", "/!")), 0, "denied" if r.endswith("!") else None))
    return spark.createDataFrame(out, INV)


def paths(df):
    return sorted(r[0] for r in df.select("path").collect())


def test_unreadable_folders_are_not_empty(spark):
    inv = inventory(spark, "/a/", "/a/b/", "/a/b/locked/!", "/a/c/", "/d/", "/d/e/")
    assert paths(tree.empty_dirs(inv)) == ["/a/c", "/d/e"]
    assert paths(tree.empty_trees(inv)) == ["/a/c", "/d", "/d/e"]
    assert "/a/b/locked" not in paths(tree.plan_cleanup(inv, cascade=True).withColumnRenamed("source_path", "path"))


def test_cascade_is_applied_and_stops_at_what_stays(spark):
    inv = inventory(spark, "/a/", "/a/b/", "/a/b/c/", "/x/", "/x/y/", "/x/f")
    gone = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/x",), ("/x/y",)], "path string")
    assert paths(snapshot.apply_remove(inv, gone)) == ["/x", "/x/f"]


def test_copy_of_a_missing_source_makes_nothing(spark):
    inv = inventory(spark, "/a/", "/a/f")
    copies = spark.createDataFrame([("/nope", "/new/deep/x"), ("/a", "/a/b")], "source string, target string")
    assert paths(snapshot.apply_copy(inv, copies, F.current_timestamp())) == ["/a", "/a/f"]


def test_slashes_at_the_end_of_roots(spark):
    inv = inventory(spark, "/a/", "/a/f", "/ab/")
    roots = spark.createDataFrame([("/a/",)], "path string")
    assert paths(tables.under_roots(inv, roots)) == paths(tables.under_roots(inv, ["/a//"])) == ["/a", "/a/f"]
    for recursive in (True, False):
        plan = ownership.plan_ownership(inv, ["/a/"], 1, 2, recursive=recursive)
        assert sorted(r.source_path for r in plan.collect()) == ["/a", "/a/f"]


def test_ownership_by_names(spark):
    inv = inventory(spark, "/a/", "/b/").withColumns({"uid": F.lit(0), "gid": F.lit(0)})
    users = spark.createDataFrame([("ann", 7, 8)], "user string, uid int, gid int")
    groups = spark.createDataFrame([("staff", 9)], "`group` string, gid int")
    run = lambda **c: builtin_registry().run("ownership", inv, users, groups, roots=["/a"], **c).collect()
    assert [(r.uid, r.gid) for r in run(target_user="ann", target_group="staff")] == [(7, 9)]
    assert [(r.uid, r.gid) for r in run(target_user="ann")] == [(7, 8)]
    with pytest.raises(ValueError, match="user not found"):
        run(target_user="bob")


def test_repeated_paths_do_not_multiply_lookups(spark):
    inv = inventory(spark, "/a/f", "/a/f")
    assert tables.lookup(spark.createDataFrame([("/a/f",), ("/n",)], "path string"), inv).count() == 2


def test_names_that_are_no_utf8(spark, tmp_path):
    raw = os.fsencode(str(tmp_path)) + b"/caf\xe9 \xff.txt"
    with open(raw, "wb") as out:
        out.write(b"text")
    inv = listing.scan_tree(spark, [str(tmp_path)]).filter("NOT is_dir")
    row = inv.first()
    assert inv.count() == 1 and row.error is None and os.fsencode(listing.on_disk(row.path)) == raw
    assert listing.hash_files(inv.select("path"), "crc32").first().error is None
    with pytest.raises(ValueError):
        listing.scan_tree(spark, ["s3a://bucket/x"])


@pytest.fixture
def twins(tmp_path):
    data = {"one": b"a" * 90, "two": b"a" * 90, "head": b"a" * 80 + b"b" * 10, "other": b"c" * 90, "alone": b"x" * 7, "t.tmp": b"a" * 90}
    for name, value in data.items():
        (tmp_path / name).write_bytes(value)
    return tmp_path


def test_staged_file_duplicates(spark, twins, monkeypatch):
    inv = listing.scan_tree(spark, [str(twins)]).filter("NOT is_dir")
    read = []
    hash_files = listing.hash_files

    def spying(files, *args, **kwargs):
        read.append(sorted(os.path.basename(r.path) for r in files.collect()))
        return hash_files(files, *args, **kwargs)

    monkeypatch.setattr(listing, "hash_files", spying)
    groups, members = dedup.staged_file_duplicates(inv, first_bytes=50, exclude=["*.tmp"])
    assert groups.count() == 1
    got = members.collect()
    assert sorted(os.path.basename(r.path) for r in got) == ["one", "two"] and all(r.identical for r in got)
    assert read == [["head", "one", "other", "two"], ["head", "one", "two"]]  # what is alone in its size is never opened
    (twins / "two").unlink()
    gone = listing.same_bytes(members.drop("identical")).collect()
    assert {r.identical for r in gone} >= {None}


def test_staged_duplicates_of_a_column(spark):
    rows = [("/a", b"xx", 1), ("/b", b"xx", 2), ("/c", b"yy", 1), ("/d", b"alone", 1), ("/e", b"", 1), ("/f", b"", 1)]
    files = spark.createDataFrame(rows, "path string, content binary, t int").select(
        "path", "content", F.length("content").cast("bigint").alias("size"), F.timestamp_seconds("t").alias("mod_time"))
    groups, members = dedup.staged_duplicates(files)
    plain = dedup.duplicate_groups(dedup.with_digests(files))
    assert sorted(map(str, groups.collect())) == sorted(map(str, plain.select(*groups.columns).collect()))
    assert sorted(r.path for r in members.filter("keep").collect()) == ["/a", "/e"]
    assert dedup.staged_duplicates(files, min_size=1, exclude=["b"])[0].count() == 0


def test_long_chains_of_steps(spark):
    n = 1000
    steps = spark.createDataFrame([("w", f"s{i}", "cleanup") for i in range(n)] + [("c", f"s{i}", "cleanup") for i in range(5)],
                                  "workflow string, step string, type string")
    links = [("w", f"s{i + 1}", f"s{i}") for i in range(n - 1)] + [("c", "s0", "s1"), ("c", "s1", "s0"), ("c", "s2", "s1"), ("c", "s4", "s3")]
    found = validate_workflows(steps, spark.createDataFrame(links, "workflow string, step string, depends_on string"), builtin_registry())
    assert sorted(map(tuple, found.collect())) == [("c", f"s{i}", "cycle") for i in range(3)]


@pytest.mark.parametrize("files", [1, 5])
def test_late_finishes_count_however_batches_fall(spark, tmp_path, files):
    rows = [("a", 0, "start"), ("a", 30, "complete"), ("b", 2, "start"), ("b", 40, "start"), ("b", 22, "complete"), ("c", 90, "start")]
    frame = spark.createDataFrame(rows, "id string, hour int, kind string").select(
        "id", F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), "kind").coalesce(1)
    for i in range(files):
        frame.filter(F.lit(files == 1) | (F.col("kind") == "complete") & (F.lit(i) == files - 2)
                     | (F.col("kind") != "complete") & (F.lit(i) == 0) & (F.col("id") != "c")
                     | (F.col("id") == "c") & (F.lit(i) == files - 1)).write.mode("append").parquet(str(tmp_path / "in"))
    stream = progress.read_stream(spark, str(tmp_path / "in"), frame.schema, "*.parquet", files_per_trigger=1)
    out = progress.run_available(progress.evict_finished_stream(stream, "12 hours", "24 hours"), "append", "late")
    assert sorted((r.id, r.kind) for r in out.collect()) == [("a", "complete"), ("b", "complete")]


def test_keys_seen_in_any_batch_before_are_known(spark, tmp_path):
    for part in ([("x", 1), ("y", 2)], [("x", 3), ("z", 4)], [("z", 5), ("y", 6), ("w", 7), ("w", 8)]):
        spark.createDataFrame(part, "k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = progress.read_stream(spark, str(tmp_path), "k string, v int", "*.parquet", files_per_trigger=1)
    assert sorted(r.k for r in progress.run_unseen(stream, ["k"], "seen").collect()) == ["w", "x", "y", "z"]


def test_classifier_on_labels_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = content.train_classifier(docs, labels.filter("doc_id % 5 <> 0"))
    got = content.classify_content(docs, model).join(labels.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "id"), "id").collect()
    assert sum(r["class"] == r.quality for r in got) >= 0.85 * len(got)


def _plain_keywords(rows, k):
    words = {}
    for key, text in rows:
        words.setdefault(key, Counter()).update((text or "").lower().split())
    df = Counter(t for of in words.values() for t in of)
    best = []
    for key, of in words.items():
        scored = sorted((-round(tf * math.log(len(rows) / df[t]), 9), t, tf) for t, tf in of.items())
        best += [(key, t, tf, df[t], rank) for rank, (_, t, tf) in enumerate(scored[:k], 1)]
    return sorted(best, key=str)


@pytest.mark.parametrize("frequent", [0, 4, 1000])
def test_keywords_shuffle_only_terms_that_may_be_best(spark, monkeypatch, frequent):
    pick = random.Random(7)
    common = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(pick.choices(common, range(40, 0, -1), k=60)) + f" rare{i} Rare{i} rare{i} " + "x" * (70 + i % 2)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (3, "again and Again"), (None, "w1 nothing"), (None, "w1 none"), (103, "a b c d e f g")]
    joined = []

    def spying(left, *args, **kwargs):
        joined.append(left.count())
        return skew_join(left, *args, **kwargs)

    monkeypatch.setattr(content, "skew_join", spying)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.term, r.tf, r.df, r["rank"]) for r in content.keywords(docs, 3, frequent=frequent).collect()]
    assert sorted(got, key=str) == _plain_keywords(rows, 3)
    every = sum(len(set((t or "").lower().split())) for _, t in rows)
    if frequent == 1000:
        assert joined[0] < every / 3
