"""Contents of files as chunks, through a Spark data source of its own.

The listing comes from the executors. A Spark job cuts the files into chunks and deals them,
in order of path and offset, into partitions of about equal bytes; that plan is a table in
the shared folder, one folder a partition. A reader's task opens the files of its partition
only. Filters on what the listing knows are pushed into the reader, so files they refuse are
never opened. Hidden names and files of any size are read like all others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from datetime import timezone
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import datasource as ds

from treeline.session import scratch
from treeline.skew import ROWS_PER_TASK, running
from treeline.sources.listing import hasher, on_disk, scan_tree

CHUNK_BYTES, PARTITION_BYTES = 64 << 20, 128 << 20
#: What opening a file counts for when partitions are planned.
OPENING = 64 << 10
#: A reader hands rows on when their contents have so many bytes.
_BATCH_BYTES = 16 << 20

_KINDS = {"path": T.StringType(), "name": T.StringType(), "size": T.LongType(), "mod_time": T.TimestampType(), "chunk": T.IntegerType(),
          "offset": T.LongType(), "length": T.LongType(), "content": T.BinaryType(), "error": T.StringType()}
CHUNKS = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])
_ARROW = pa.schema([
    ("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mod_time", pa.timestamp("us", tz="UTC")), ("chunk", pa.int32()),
    ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_LISTED = ("path", "name", "size", "mod_time", "chunk", "offset")


class _Folder(ds.InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _test(given: ds.Filter, row: dict) -> bool:
    """Whether a planned chunk passes a pushed filter; nulls pass only tests for null."""
    if isinstance(given, ds.Not):
        inner = given.child
        known = isinstance(inner, ds.IsNull) or row[inner.attribute[0]] is not None
        return known and not _test(inner, row)
    value = row[given.attribute[0]]
    if isinstance(given, ds.IsNull):
        return value is None
    if value is None:
        return False
    tests = {
        ds.IsNotNull: lambda: True, ds.EqualTo: lambda: value == given.value, ds.In: lambda: value in given.value,
        ds.GreaterThan: lambda: value > given.value, ds.GreaterThanOrEqual: lambda: value >= given.value,
        ds.LessThan: lambda: value < given.value, ds.LessThanOrEqual: lambda: value <= given.value,
        ds.StringStartsWith: lambda: value.startswith(given.value), ds.StringEndsWith: lambda: value.endswith(given.value),
        ds.StringContains: lambda: given.value in value,
    }
    return tests[type(given)]()


_SIMPLE = (ds.IsNull, ds.IsNotNull, ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual,
           ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)


def _pushable(given: ds.Filter) -> bool:
    inner = given.child if isinstance(given, ds.Not) else given
    # times stay with Spark, which knows the session's zone
    return isinstance(inner, _SIMPLE) and len(inner.attribute) == 1 and inner.attribute[0] in _LISTED and inner.attribute[0] != "mod_time"


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.plan, self.contents = options["plan"], options.get("contents", "true") == "true"
        self.tests: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for given in filters:
            if _pushable(given):
                self.tests.append(given)
            else:
                yield given

    def partitions(self) -> Sequence[ds.InputPartition]:
        found = [e.path for e in os.scandir(self.plan) if e.name.startswith("part=")] if os.path.isdir(self.plan) else []
        return [_Folder(p) for p in sorted(found)] or [_Folder("")]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in _planned(partition.path):
            if not all(_test(t, row) for t in self.tests):
                continue
            row["content"] = None
            if self.contents and row["error"] is None:
                try:
                    with open(on_disk(row["path"]), "rb") as file:
                        file.seek(row["offset"])
                        row["content"] = file.read(row["length"])
                    if len(row["content"]) < row["length"]:
                        row |= {"content": None, "error": "shorter than listed"}
                except OSError as exc:
                    row["error"] = str(exc)
            rows.append(row)
            held += len(row["content"] or b"") + 1024
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _planned(folder: str) -> list[dict]:
    """A partition's chunks in order; there are few, as they have a partition's bytes."""
    if not folder:
        return []
    files = [e.path for e in os.scandir(folder) if e.name.endswith(".parquet")]
    rows = [r for f in files for r in pq.ParquetFile(f).read().to_pylist()]
    for r in rows:
        if r["mod_time"] is not None and r["mod_time"].tzinfo is None:
            r["mod_time"] = r["mod_time"].replace(tzinfo=timezone.utc)
    return sorted(rows, key=lambda r: (r["path"], r["offset"]))


class FileChunks(ds.DataSource):
    """``spark.read.format("treeline_files")`` with the option ``plan``: a folder that ``plan_chunks`` wrote."""

    @classmethod
    def name(cls) -> str:
        return "treeline_files"

    def schema(self) -> T.StructType:
        return CHUNKS

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))


def mounted(path: str) -> str:
    """The path of a mount; a URI of another scheme than file is refused."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: only folders of a mount that all executors share can be read")
    return path


def plan_chunks(
    files: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, partition_bytes: int = PARTITION_BYTES,
    limit: int = ROWS_PER_TASK,
) -> str:
    """Write the plan for files (path, name, size, mod_time, error) to ``folder``: chunks of at
    most ``chunk_bytes``, and partitions that end with the chunk that fills ``partition_bytes``."""
    last = F.greatest(F.coalesce("size", F.lit(0)) - 1, F.lit(0)).cast("bigint")
    cut = files.select("path", "name", "size", "mod_time", "error", F.posexplode(
        F.sequence(F.lit(0).cast("bigint"), last, F.lit(chunk_bytes).cast("bigint"))).alias("chunk", "offset"))
    cut = cut.withColumn("length", F.least(F.coalesce("size", F.lit(0)) - F.col("offset"), F.lit(chunk_bytes)).cast("bigint"))
    placed = running(cut.withColumn("all", F.lit(0)), ["all"], ["path", "offset"], {"upto": ("sum", F.col("length") + OPENING)}, limit)
    part = F.floor((F.col("upto") - F.col("length") - OPENING) / partition_bytes).cast("bigint")
    columns = [c for c in CHUNKS.fieldNames() if c != "content"]
    placed.select(*columns, part.alias("part")).repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def read_files(
    spark: SparkSession, roots: Sequence[str], pattern: str = "*", chunk_bytes: int = CHUNK_BYTES,
    partition_bytes: int = PARTITION_BYTES, contents: bool = True,
) -> DataFrame:
    """All files below ``roots`` whose name matches ``pattern`` as chunks: path, name, size,
    mod_time, chunk (from 0), offset, length, content and error.

    An empty file is one empty chunk. What cannot be listed or read has its error in its row
    and no content. Links are not followed. Roots and the session's shared folder have to lie on
    a mount that all executors share. Without ``contents`` no file is opened.
    """
    return load_chunks(spark, planned(spark, roots, pattern, chunk_bytes, partition_bytes), contents)


def planned(
    spark: SparkSession, roots: Sequence[str], pattern: str = "*", chunk_bytes: int = CHUNK_BYTES, partition_bytes: int = PARTITION_BYTES,
) -> str:
    """The folder of a plan for all files below ``roots``, as ``read_files`` describes them."""
    listed = scan_tree(spark, [mounted(r) for r in roots])
    links = F.shiftright(F.coalesce("mode", F.lit(0)), 27).bitwiseAND(F.lit(1)) == 1
    wanted = listed.filter(~F.coalesce("is_dir", F.lit(False)) & ~links)
    if pattern != "*":
        matches = F.udf(lambda name: fnmatchcase(name or "", pattern), "boolean")
        wanted = wanted.filter(matches("name"))
    return plan_chunks(wanted, scratch(spark, "files"), chunk_bytes, partition_bytes)


def load_chunks(spark: SparkSession, plan: str, contents: bool = True) -> DataFrame:
    """The chunks of a plan; filters on what it knows reach the reader."""
    spark.dataSource.register(FileChunks)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"plan": mounted(plan), "contents": str(contents).lower()}
    return spark.read.format("treeline_files").options(**options).load()


def whole_digests(chunks: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """path, size, chunks, hash and error: the digest of each whole file from its chunks, which
    pass one task in order. Contents move for it; ``hash_files`` reads each file in one task instead."""
    schema = "path string, size bigint, chunks bigint, hash string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def done() -> pa.RecordBatch:
            path, size, count, read, state, error = now
            whole = state.hexdigest() if error is None and read == (size or 0) else None
            row = {"path": path, "size": size, "chunks": count, "hash": whole, "error": error}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("path", pa.string()), ("size", pa.int64()), ("chunks", pa.int64()), ("hash", pa.string()), ("error", pa.string())]))

        for batch in batches:
            for path, size, content, error in zip(*[batch.column(i) for i in range(4)], strict=True):
                if now is None or path.as_py() != now[0]:
                    if now is not None:
                        yield done()
                    now = [path.as_py(), size.as_py(), 0, 0, hasher(algorithm), None]
                now[2] += 1
                now[5] = now[5] or error.as_py()
                if content.is_valid:
                    data = content.as_py()
                    now[3] += len(data)
                    now[4].update(data)
        if now is not None:
            yield done()

    ordered = chunks.select("path", "size", "content", "error", "offset").repartition("path").sortWithinPartitions("path", "offset")
    return ordered.select("path", "size", "content", "error").mapInArrow(run, schema)
