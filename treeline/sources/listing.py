"""Turning folders into inventories, and reading file contents."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.hashing import digest
from treeline.functions.paths import base_name
from treeline.schema import ALGORITHMS
from treeline.session import scratch

LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mod_time", T.TimestampType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("mode", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

# Bit numbers of the portable file mode, next to the nine permission bits.
_TYPE_BITS = {
    stat.S_IFDIR: 31,
    stat.S_IFLNK: 27,
    stat.S_IFBLK: 26,
    stat.S_IFIFO: 25,
    stat.S_IFSOCK: 24,
    stat.S_IFCHR: 21,
}
_FLAG_BITS = {stat.S_ISUID: 23, stat.S_ISGID: 22, stat.S_ISVTX: 20}


# Bytes of a file name that are not UTF-8 stand for private characters in the inventory.
_RAW = {0xDC00 + b: 0x10FF00 + b for b in range(0x80, 0x100)}
_BACK = {v: k for k, v in _RAW.items()}


def shown(path: str) -> str:
    """A path of this system as it can be stored; every name has one form."""
    return path.translate(_RAW)


def on_disk(path: str) -> str:
    """The path of this system that ``shown`` has made."""
    return path.translate(_BACK)


def portable_mode(st_mode: int) -> int:
    mode = st_mode & 0o777
    kind = _TYPE_BITS.get(stat.S_IFMT(st_mode))
    if kind is not None:
        mode |= 1 << kind
    if stat.S_ISCHR(st_mode):
        mode |= 1 << 26
    for flag, bit in _FLAG_BITS.items():
        if st_mode & flag:
            mode |= 1 << bit
    return mode


def _record(path: str, name: str, st: os.stat_result | None, error: str | None) -> tuple:
    path, name = shown(path), shown(name)
    if st is None:
        return (path, name, None, None, None, None, error)
    when = datetime.fromtimestamp(st.st_mtime, tz=timezone.utc)
    return (path, name, st.st_size, when, stat.S_ISDIR(st.st_mode), portable_mode(st.st_mode), error)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=LISTING.fieldNames())
    out["mod_time"] = pd.to_datetime(out["mod_time"], utc=True).dt.tz_localize(None)
    for column in ("size", "mode"):
        out[column] = out[column].astype("Int64")
    out["is_dir"] = out["is_dir"].astype("boolean")
    return out


_ROWS_PER_BATCH = 20_000
#: Folders that a task lists.
FOLDERS_PER_TASK = 200


def _list_children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for folder in batch["path"]:
            try:
                with os.scandir(on_disk(folder)) as entries:
                    for entry in entries:
                        try:
                            rows.append(
                                _record(entry.path, entry.name, entry.stat(follow_symlinks=False), None)
                            )
                        except OSError as exc:
                            rows.append(_record(entry.path, entry.name, None, str(exc)))
                        if len(rows) >= _ROWS_PER_BATCH:
                            yield _frame(rows)
                            rows = []
            except OSError as exc:
                rows.append(_record(folder, os.path.basename(folder), None, str(exc)))
    if rows:
        yield _frame(rows)


def _stat_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            name = os.path.basename(path.rstrip("/")) or path
            try:
                rows.append(_record(path, name, os.lstat(on_disk(path)), None))
            except OSError as exc:
                rows.append(_record(path, name, None, str(exc)))
        if rows:
            yield _frame(rows)


def listing_tasks(spark: SparkSession, folders: int) -> int:
    """As many tasks as cores, and more where there are more folders than those should list."""
    return max(spark.sparkContext.defaultParallelism, 2, -(-folders // FOLDERS_PER_TASK))


def scan_tree(spark: SparkSession, roots: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Inventory of folders on a mount that all executors share.

    Level by level: the folders of one level are spread over the executors, a few hundred to
    a task (or over ``tasks`` tasks), their entries are written to the shared scratch folder, and the next level starts from
    what was written. The driver only learns how many folders a level has. Roots are
    included, hidden names too, and symbolic links are recorded and not followed. There is
    one row per path; that of an entry or folder that could not be read has ``error`` set.
    Names that are not UTF-8 are kept in a form of their own (``on_disk`` gives it back).
    Overlapping roots count once.
    """
    for root in roots:
        if "://" in root:
            raise ValueError(f"{root}: only folders of a mount that all executors share can be listed")
    out = scratch(spark, "scan")
    level = 0
    frontier = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string").distinct()
    listed = frontier.mapInPandas(_stat_paths, LISTING)
    while True:
        here = f"{out}/level={level}"
        listed.write.mode("overwrite").parquet(here)
        written = spark.read.schema(LISTING).parquet(here)
        folders = written.filter("is_dir").select("path")
        count = folders.count()
        if not count:
            break
        listed = folders.repartition(tasks or listing_tasks(spark, count)).mapInPandas(_list_children, LISTING)
        level += 1
    found = spark.read.schema(LISTING).parquet(*[f"{out}/level={i}" for i in range(level + 1)])
    # a folder that could not be listed has its own row and one with the error
    merged = found.groupBy("path").agg(*[F.max(c).alias(c) for c in LISTING.fieldNames() if c != "path"])
    return merged.select(*LISTING.fieldNames())


#: Files of more bytes do not fit a value.
WHOLE_BYTES = 2_000_000_000


def scan_content(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root`` with their whole content as one value, and ``error``.

    On a mount that all executors share hidden names are read as well; a file that cannot be
    read, or has more than two billion bytes, is a row with an error (``read_files`` has the
    chunks of such files). Below a URI of another scheme Spark's own file source reads: it
    skips names starting with '.' or '_'.
    """
    if "://" in root and not root.startswith("file:"):
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(root)
        )
        return raw.select(
            "path",
            base_name("path").alias("name"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("mod_time"),
            F.lit(False).alias("is_dir"),
            "content",
            F.lit(None).cast("string").alias("error"),
        )
    from treeline.sources.chunks import load_chunks, planned

    # longer files are cut, and cut ones are not opened
    plan = planned(spark, [root], pattern, chunk_bytes=WHOLE_BYTES)
    whole = load_chunks(spark, plan).filter(F.col("size").isNull() | (F.col("size") <= WHOLE_BYTES))
    rows = whole.select("path", "name", "size", "mod_time", F.lit(False).alias("is_dir"), "content", "error")
    large = load_chunks(spark, plan, contents=False).filter((F.col("chunk") == 0) & (F.col("size") > WHOLE_BYTES))
    return rows.unionByName(large.select(
        "path", "name", "size", "mod_time", F.lit(False).alias("is_dir"), "content",
        F.lit("too large for one value").alias("error")))


def hash_manifest(files: DataFrame, algorithm: str, content: str = "content") -> DataFrame:
    """Digest of every file whose content is a column; contents never reach a shuffle."""
    return files.select(
        "path",
        "size",
        digest(content, algorithm).alias("hash"),
        F.lit(algorithm.lower()).alias("hash_type"),
    )


def hasher(algorithm: str):
    import hashlib
    import zlib

    if algorithm == "blake2b":
        return hashlib.blake2b(digest_size=32)
    if algorithm == "xxhash64":
        import xxhash

        return xxhash.xxh64(seed=0)
    if algorithm == "crc32":

        class _Crc:
            value = 0

            def update(self, chunk: bytes) -> None:
                self.value = zlib.crc32(chunk, self.value)

            def hexdigest(self) -> str:
                return f"{self.value:08x}"

        return _Crc()
    return hashlib.new(algorithm)


def same_bytes(members: DataFrame, chunk_size: int = 16 * 1024 * 1024) -> DataFrame:
    """Add ``identical``: whether the file at ``path`` has the bytes of the one at
    ``survivor``; null where one of them cannot be read. Nothing but paths is shuffled."""
    schema = T.StructType([*members.schema.fields, T.StructField("identical", T.BooleanType())])

    def equal(a: str, b: str) -> bool | None:
        if a == b:
            return True
        try:
            with open(on_disk(a), "rb") as one, open(on_disk(b), "rb") as other:
                while True:
                    chunk = one.read(chunk_size)
                    if chunk != other.read(chunk_size):
                        return False
                    if not chunk:
                        return True
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [equal(a, b) for a, b in zip(batch["path"], batch["survivor"], strict=True)]
            yield batch.assign(identical=pd.array(found, dtype="boolean"))

    return members.mapInPandas(run, schema)


def hash_files(
    files: DataFrame, algorithm: str = "blake2b", chunk_size: int = 64 * 1024 * 1024,
    first_bytes: int | None = None,
) -> DataFrame:
    """Digest of files on a shared mount, read in chunks on the executors.

    Adds ``hash`` and ``error``. For files too large for a column; with ``first_bytes``
    only the head is read, which gives a partial hash for an early dedup stage.
    """
    algorithm = algorithm.lower()
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    schema = T.StructType(
        [*files.schema.fields, T.StructField("hash", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, errors = [], []
            for path in batch["path"]:
                try:
                    state, left = hasher(algorithm), first_bytes
                    with open(on_disk(path), "rb") as handle:
                        while left is None or left > 0:
                            chunk = handle.read(chunk_size if left is None else min(chunk_size, left))
                            if not chunk:
                                break
                            state.update(chunk)
                            left = None if left is None else left - len(chunk)
                    hashes.append(state.hexdigest())
                    errors.append(None)
                except OSError as exc:
                    hashes.append(None)
                    errors.append(str(exc))
            yield batch.assign(hash=hashes, error=errors)

    return files.mapInPandas(run, schema)
