import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from treeline.operators.tree import empty_dirs
from treeline.plans.registry import Registry, builtin_registry
from treeline.plans.workflow import run_workflow, validate_workflows
from treeline.sources import listing, tables


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a" / "empty").mkdir(parents=True)
    (tmp_path / "a" / ".hidden").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "_x.bin").write_bytes(random.Random(1).randbytes(100_000))
    (tmp_path / "b" / ".dot").write_text("hello")
    (tmp_path / "b" / "zero").write_text("")
    os.symlink(tmp_path / "b", tmp_path / "a" / "link")
    return tmp_path


def test_scan_tree_sees_what_is_there(spark, folder):
    rows = listing.scan_tree(spark, [str(folder)]).collect()
    got = {os.path.relpath(r["path"], folder): r for r in rows}
    assert sorted(got) == [".", "a", "a/.hidden", "a/empty", "a/link", "b", "b/.dot", "b/_x.bin", "b/zero"]
    assert got["a"]["is_dir"] and got["a"]["mode"] >> 31 == 1 and got["a"]["mode"] & 0o777 == os.stat(folder / "a").st_mode & 0o777
    # the link is recorded, not followed
    assert not got["a/link"]["is_dir"] and got["a/link"]["mode"] >> 27 & 1
    assert got["b/_x.bin"]["size"] == 100_000 and abs(got["b/zero"]["mod_time"].timestamp() - os.stat(folder / "b/zero").st_mtime) < 1e-3
    inv = listing.scan_tree(spark, [str(folder), str(folder / "a")])
    assert inv.count() == 9
    assert sorted(os.path.basename(r["path"]) for r in empty_dirs(inv).collect()) == [".hidden", "empty"]


def test_missing_roots_are_errors(spark, folder):
    row = listing.scan_tree(spark, [str(folder / "nowhere")]).first()
    assert row["error"] and row["size"] is None


@pytest.mark.parametrize("algorithm", ["md5", "sha512", "blake2b", "xxhash64", "crc32"])
def test_chunked_digests_equal_whole_ones(spark, folder, algorithm):
    inv = listing.scan_tree(spark, [str(folder / "b")]).filter("NOT is_dir").select("path", "size")
    gone = spark.createDataFrame([(str(folder / "gone"), 1)], "path string, size bigint")
    chunked = {r["path"]: r for r in listing.hash_files(inv.unionByName(gone), algorithm, chunk_size=999).collect()}
    assert chunked[str(folder / "gone")]["error"]
    whole = spark.createDataFrame([(str(p), bytearray(p.read_bytes())) for p in (folder / "b").iterdir()], "path string, content binary")
    for r in listing.hash_manifest(whole.withColumn("size", F.length("content")), algorithm).collect():
        assert chunked[r["path"]]["hash"] == r["hash"]


def test_partial_digest(spark, folder):
    inv = listing.scan_tree(spark, [str(folder / "b")]).filter("name = '_x.bin'").select("path", "size")
    got = listing.hash_files(inv, "md5", chunk_size=64, first_bytes=100).first()["hash"]
    assert got == hashlib.md5((folder / "b" / "_x.bin").read_bytes()[:100]).hexdigest()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_results_round_trip(spark, tmp_path, fmt):
    rows = [("a", 'x "quoted",\nline', None, 1.5), ("b", "", True, None), ("c", "  blanks\t ", True, 2.0), (None, "\\back\\", False, 0.0),
            ("d", "\\N", None, None), ("\\N", "\\\\N", None, 0.5), ("e", None, False, 1.0), ("f", "x\\N", True, 1.0)]
    df = spark.createDataFrame(rows, "id string, text string, ok boolean, x double")
    tables.write_results(df, str(tmp_path / fmt), fmt)
    back = tables.read_results(spark, str(tmp_path / fmt), df.schema, fmt)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_registry(spark):
    registry = builtin_registry()
    assert {"cleanup", "deduplication", "consolidation", "ownership"} <= set(registry.supported())
    with pytest.raises(ValueError, match="operation type nothing not supported"):
        registry.run("nothing")
    inv = spark.createDataFrame([("/a", True, 0)], "path string, is_dir boolean, size bigint")
    with pytest.raises(ValueError, match="target_user"):
        registry.run("ownership", inv, roots=["/"], uid=1, gid=1)
    assert registry.run("ownership", inv, target_user="ann", roots=["/"], uid=1, gid=1).count() == 1

    class Half:
        name, version = "half", "1"

        def validate(self, **config):
            if config.get("by", 2) == 0:
                raise ValueError("by zero")

        def execute(self, df, by=2):
            return df.withColumn("size", F.col("size") / by)

    registry.register_plugin(Half())
    assert registry.run("half", inv, by=4).first()["size"] == 0
    with pytest.raises(ValueError, match="by zero"):
        registry.run("half", inv, by=0)


def _number_registry():
    registry = Registry()
    registry.register_operator("add", lambda df, by: df.withColumn("x", F.col("x") + int(by)))
    registry.register_operator("join", lambda a, b: a.unionByName(b))
    return registry


def test_workflow_order_variables_and_conditions(spark):
    spec = {
        "variables": {"step": 5},
        "steps": [
            {"id": "c", "type": "join", "inputs": ["a", "b"]},
            {"id": "b", "type": "add", "inputs": ["a"], "config": {"by": "${step}"}},
            {"id": "a", "type": "add", "inputs": ["numbers"], "config": {"by": 1}, "condition": "count(*) > 1"},
            {"id": "no", "type": "add", "inputs": ["a"], "config": {"by": 1}, "condition": "min(x) > ${step}"},
            {"id": "after", "type": "add", "inputs": ["no"], "config": {"by": 1}},
        ],
    }
    outputs, skipped = run_workflow(_number_registry(), spec, {"numbers": spark.range(2).withColumnRenamed("id", "x")})
    assert sorted(r["x"] for r in outputs["c"].collect()) == [1, 2, 6, 7]
    assert sorted(skipped) == ["after", "no"]
    with pytest.raises(ValueError, match="unknown"):
        run_workflow(_number_registry(), {"steps": [{"id": "a", "type": "add", "inputs": ["x"]}]}, {})


def test_workflow_problems(spark):
    steps = [(1, s, "add") for s in "abcde"] + [(1, "f", "fly"), (2, "a", "join")]
    links = [(1, "b", "a"), (1, "c", "b"), (1, "b", "c"), (1, "d", "c"), (1, "e", "zz"), (2, "a", "a")]
    got = validate_workflows(
        spark.createDataFrame(steps, "workflow int, step string, type string"),
        spark.createDataFrame(links, "workflow int, step string, depends_on string"), _number_registry())
    assert sorted(map(tuple, got.collect())) == [
        (1, "b", "cycle"), (1, "c", "cycle"), (1, "d", "cycle"), (1, "e", "missing dependency zz"),
        (1, "f", "unknown type fly"), (2, "a", "cycle")]
