import pytest
from pyspark.sql import functions as F

from treeline.functions import rules
from treeline.operators import arrange, conflicts, dedup, ownership, report, snapshot, tree
from treeline.sources import tables

def now():
    return F.timestamp_seconds(F.lit(2_000_000_000))


def inventory(spark, *paths):
    """Paths ending in '/' are directories; all ancestors are added."""
    found = {}
    for p in paths:
        is_dir, clean = p.endswith("/"), p.rstrip("/")
        found[clean] = found.get(clean, False) or is_dir
        parts = clean.split("/")
        for i in range(2, len(parts)):
            found["/".join(parts[:i])] = True
    rows = [(p, p.rsplit("/", 1)[1], 0 if d else len(p), n, d, 420) for n, (p, d) in enumerate(sorted(found.items()))]
    df = spark.createDataFrame(rows, "path string, name string, size bigint, t bigint, is_dir boolean, mode bigint")
    return df.withColumn("t", F.timestamp_seconds("t")).withColumnRenamed("t", "mod_time")


def paths_of(df, column="path"):
    return sorted(r[0] for r in df.select(column).collect())


def test_empty_directories(spark):
    inv = inventory(spark, "/r/empty/", "/r/hid/.x", "/r/up/down/", "/r/.git/", "/r/f.txt")
    assert paths_of(tree.empty_dirs(inv)) == ["/r/.git", "/r/empty", "/r/up/down"]
    assert paths_of(tree.empty_trees(inv)) == ["/r/.git", "/r/empty", "/r/up", "/r/up/down"]
    assert paths_of(tree.plan_cleanup(inv, ("EMP",)), "source_path") == ["/r/up/down"]


def test_applied_cleanup_leaves_nothing_to_do(spark):
    inv = inventory(spark, "/r/a/", "/r/b/c/", "/r/f")
    after = snapshot.apply_plan(inv, tree.plan_cleanup(inv), now())
    assert paths_of(after) == ["/r", "/r/b", "/r/f"]
    assert paths_of(tree.empty_dirs(after)) == ["/r/b"]


def test_failed_removals_are_skipped(spark):
    inv = inventory(spark, "/r/a/", "/r/b/")
    failed = spark.createDataFrame([("/r/a", "busy")], "path string, error string")
    plan = tree.plan_cleanup(inv, failed=failed)
    assert report.cleanup_summary(plan).first()["summary"] == "Cleanup completed: 1 directories removed, 1 skipped"
    assert paths_of(snapshot.apply_plan(inv, plan, now())) == ["/r", "/r/a"]
    assert paths_of(snapshot.backup_manifest(plan, "/bak"), "target_path") == ["/bak/r/b"]


def test_remove_tree_stops_at_the_separator(spark):
    inv = inventory(spark, "/a/b/x", "/a/bc/y")
    gone = spark.createDataFrame([("/a/b",)], "path string")
    assert paths_of(snapshot.apply_remove_tree(inv, gone)) == ["/a", "/a/bc", "/a/bc/y"]
    # a directory with children is not removed by a plain remove
    assert paths_of(snapshot.apply_remove(inv, gone)) == paths_of(inv)


@pytest.mark.parametrize("limit", [2, 1000])
def test_move(spark, limit):
    inv = inventory(spark, "/a/b/x", "/a/b/c/y", "/a/bc", "/z/x")
    moves = spark.createDataFrame(
        [("/a/b", "/z"), ("/a/b/c", "/q/c"), ("/z", "/z/inside")], "source string, target string")
    after = snapshot.apply_move(inv, moves, limit)
    assert paths_of(after) == ["/a", "/a/bc", "/q/c", "/q/c/y", "/z", "/z/x"]
    # the moved file replaced the one that was there
    assert after.filter("path = '/z/x'").first()["size"] == len("/a/b/x")


def test_copy_makes_parents(spark):
    inv = inventory(spark, "/a/b/x")
    copies = spark.createDataFrame([("/a/b", "/n/m/b"), ("/a/b/x", "/n/k")], "source string, target string")
    after = snapshot.apply_copy(inv, copies, now())
    assert paths_of(after) == ["/", "/a", "/a/b", "/a/b/x", "/n", "/n/k", "/n/m", "/n/m/b", "/n/m/b/x"]
    diff = snapshot.snapshot_diff(inv, after)
    assert {r["change"] for r in diff.collect()} == {"added"} and diff.count() == 6


@pytest.mark.parametrize("limit", [2, 1000])
def test_scopes(spark, limit):
    inv = inventory(spark, "/a/b/x", "/a/bc/y", "/d/e")
    roots = spark.createDataFrame([("/a/b",), ("/a/b/x",), ("/d",)], "path string")
    want = ["/a/b", "/a/b/x", "/d", "/d/e"]
    assert paths_of(tables.under_roots(inv, roots, limit)) == want
    assert paths_of(tables.under_roots(inv, ["/a/b", "/a/b/", "/a/b/x", "/d"])) == want
    assert paths_of(tables.under_roots(inv, ["/"])) == paths_of(inv)
    top = spark.createDataFrame([("/",), ("/a",)], "path string")
    assert paths_of(tables.under_roots(inv, top, limit)) == paths_of(inv)
    assert tables.covered_by(inv, top.withColumnRenamed("path", "root"), limit).count() == 7 + 5
    many = ["/a/b"] + [f"/none/{i}" for i in range(100)]
    assert paths_of(tables.under_roots(inv, many, limit)) == ["/a/b", "/a/b/x"]


def test_depth_limits(spark):
    inv = inventory(spark, "/a/b/c/x")
    direct = inv.filter(rules.within_scope("path", F.lit("/a"), recursive=False))
    assert paths_of(direct) == ["/a", "/a/b"]
    assert paths_of(inv.filter(rules.within_depth("path", F.lit("/a"), 2))) == ["/a", "/a/b", "/a/b/c"]
    plan = ownership.plan_ownership(inv, ["/a"], 1, 2, recursive=False)
    assert paths_of(plan, "source_path") == ["/a", "/a/b"]


def test_principals(spark):
    requests = spark.createDataFrame(
        [(1, "ann", ""), (2, "ann", "ops"), (3, "bob", ""), (4, "ann", "no"), (5, None, "no")],
        "request_id int, user string, group string")
    users = spark.createDataFrame([("ann", 10, 20)], "user string, uid int, gid int")
    groups = spark.createDataFrame([("ops", 30)], "group string, gid int")
    got = ownership.resolve_principals(requests, users, groups, ("me", 1, 2), limit=1).orderBy("request_id").collect()
    assert [(r["uid"], r["gid"], r["error"]) for r in got] == [
        (10, 20, None), (10, 30, None), (None, None, "user not found: bob"),
        (None, None, "group not found: no"), (1, 2, None)]


@pytest.mark.parametrize("limit", [2, 1000])
def test_conflicts(spark, limit):
    plan = spark.createDataFrame(
        [(f"/s/{i:02d}.txt", "/t/a.txt", i, 1) for i in range(12)] + [("/s/x", "/t/b", 5, 1), ("/t/c", "/t/c", 5, 1)],
        "source_path string, target_path string, mod_time int, size int")
    inv = inventory(spark, "/t/b", "/t/c", "/t/a_3.txt")
    found = {r["source_path"]: r for r in conflicts.find_conflicts(plan, inv, limit).collect()}
    assert len(found) == 13 and "/t/c" not in found and found["/s/x"]["target_exists"]

    named = {r["source_path"]: (r["new_path"], r["status"])
             for r in conflicts.rename_on_conflict(plan, inv, limit).collect()}
    assert named["/s/00.txt"] == ("/t/a.txt", "planned")
    # the number 3 is taken, so it is left out
    assert named["/s/02.txt"] == ("/t/a_2.txt", "renamed") and named["/s/03.txt"] == ("/t/a_4.txt", "renamed")
    assert named["/s/11.txt"] == ("/t/a_12.txt", "renamed") and len({p for p, _ in named.values()}) == len(named)
    assert named["/s/x"] == ("/t/b_1", "renamed") and named["/t/c"] == ("/t/c", "planned")

    def status(how):
        return {r["source_path"]: r["status"] for r in conflicts.resolve_conflicts(plan, inv, how, limit).collect()}

    skip, over = status("skip"), status("overwrite")
    assert [s for s, v in skip.items() if v == "planned"] and skip["/s/00.txt"] == "planned" and skip["/s/x"] == "skipped"
    assert list(skip.values()).count("planned") == 2
    assert over["/s/11.txt"] == "overwrite" and over["/s/x"] == "overwrite" and over["/s/00.txt"] == "skipped"
    with pytest.raises(ValueError):
        conflicts.resolve_conflicts(plan, inv, "merge")


def test_applied_move_plan(spark):
    inv = inventory(spark, "/s/a.txt", "/s/b.jpg", "/dest/documents/a.txt")
    sources = tables.under_roots(inv, ["/s"])
    plan = arrange.plan_consolidation(sources, inv, "/dest", conflict="rename", move=True)
    after = snapshot.apply_plan(inv, plan, now())
    assert paths_of(after.filter("NOT is_dir")) == [
        "/dest/documents/a.txt", "/dest/documents/a_1.txt", "/dest/images/b.jpg"]


@pytest.mark.parametrize("algorithm", ["md5", "blake2b", "xxhash64"])
def test_groups_do_not_depend_on_the_algorithm_or_partitions(spark, algorithm):
    data = [(f"/f{i:03d}", 0 if i % 3 == 0 else 4, i, "" if i % 3 == 0 else f"{i % 7:04d}") for i in range(90)]
    files = spark.createDataFrame(data, "path string, size int, mod_time int, content string")
    hashed = dedup.with_digests(files.repartition(7), algorithm)
    groups = dedup.duplicate_groups(hashed, algorithm)
    got = sorted((r["files"], r["saveable_size"], r["survivor"]) for r in groups.collect())
    assert got[-1] == (30, 0, "/f000") and len(got) == 8 and sum(g[0] for g in got) == 90
    # a hot group is split and still whole
    members = dedup.duplicate_members(hashed, groups, limit=4)
    assert members.count() == 90 and members.filter("keep").count() == 8
    checked = dedup.verify_bytes(files, members, limit=4)
    assert checked.count() == 90 and checked.filter("NOT identical").count() == 0
    staged = dedup.same_fast_hash(dedup.same_size(hashed, 5), 5)
    assert staged.count() == 90


def test_byte_check_finds_false_twins(spark):
    files = spark.createDataFrame([("/a", 1, "x"), ("/b", 1, "y")], "path string, size int, content string")
    members = spark.createDataFrame(
        [("g", "/a", 1, True), ("g", "/b", 1, False)], "group_id string, path string, size int, keep boolean")
    got = {r["path"]: r["identical"] for r in dedup.verify_bytes(files, members).collect()}
    assert got == {"/a": True, "/b": False}


def test_preview(spark):
    df = spark.createDataFrame([(f"/{i:03d}",) for i in range(25)], "path string")
    rows = report.preview(df, 20).collect()
    assert len(rows) == 20 and rows[0]["more"] == 5
    assert report.preview(df, 100).first()["more"] == 0


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([("/a", 5, 1), ("/b", 5, 1)], "path string, mod_time int, size int")
    new = spark.createDataFrame([("/a", 5, 2), ("/b", 4, 2), ("/c", 1, 2)], "path string, mod_time int, size int")
    got = {r["path"]: r["size"] for r in tables.upsert_inventory(old, new).collect()}
    assert got == {"/a": 2, "/b": 1, "/c": 2}


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    inv = inventory(spark, "/a/b/x", "/d/e")
    inv.write.parquet(str(tmp_path / "inv"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    stored = spark.read.parquet(str(tmp_path / "inv"))
    kept = tables.under_roots(stored, ["/a/b"]).filter("NOT is_dir AND size >= 5").select("path", "size")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    for pushed in ("StringStartsWith(path,/a/b/)", "GreaterThanOrEqual(size,5)", "is_dir,"):
        assert pushed in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<path:string,size:bigint,is_dir:boolean>" in plan
    # one shuffle, with a partial aggregate before it
    groups = dedup.duplicate_groups(stored.withColumn("hash", F.col("name")))
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan
