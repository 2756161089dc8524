"""Exact duplicates in stages: size, fast hash, cryptographic hash, byte check.

Only (path, size, digest) rows are shuffled. Where contents are a column the digests
are computed in the scan; where they are files, each stage decides what is read next.
``manifest`` writes the digests once, so that later stages do not read contents again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.columns import as_col
from treeline.functions.hashing import digest, fast_hash
from treeline.functions.rules import path_allowed, size_between
from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK, skew_join


def _repeated(files: DataFrame, keys: list[str], limit: int) -> DataFrame:
    seen = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen")).filter("_seen > 1")
    return skew_join(files, seen, keys, "left_semi", ["path"], limit, rows_per_key="_seen")


def same_size(files: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Stage 1: files whose size occurs at least twice."""
    return _repeated(files, ["size"], limit)


def same_fast_hash(files: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Stage 2: of those, files whose fast hash (column ``fast``) occurs at least twice."""
    return _repeated(files, ["size", "fast"], limit)


def with_digests(files: DataFrame, algorithm: str = "blake2b", content: str = "content") -> DataFrame:
    """Replace the content by its digests, within the scan.

    ``digest`` may be a Python function (blake2b); asking for the fast hash and the
    cryptographic one together keeps it at one pass over the content.
    """
    return files.select(
        "path", "size", "mod_time", fast_hash(content).alias("fast"),
        digest(content, algorithm).alias("hash"),
    )


def manifest(files: DataFrame, algorithm: str = "blake2b", content: str = "content") -> DataFrame:
    """The digests of all files as a materialised table: one pass over the contents."""
    return cut_lineage(with_digests(files, algorithm, content))


def duplicate_groups(hashed: DataFrame, algorithm: str = "blake2b") -> DataFrame:
    """Stage 3: groups of equal size and digest. One shuffle of pre-aggregated rows, so
    a group with a third of all files costs one row per task.

    The survivor is the oldest file, the path breaking ties.
    """
    return (
        hashed.groupBy("size", "hash")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("total_size"),
            F.min(F.struct("mod_time", "path")).alias("_first"),
        )
        .filter("files > 1")
        .select(
            F.col("hash").alias("id"),
            "size",
            "files",
            "total_size",
            ((F.col("files") - 1) * F.col("size")).alias("saveable_size"),
            F.lit(algorithm).alias("hash_type"),
            F.lit(1.0).alias("confidence"),
            F.col("_first.path").alias("survivor"),
        )
    )


#: Places of the table that lets a scan skip rows; a byte each goes to every task.
_PLACES = 1 << 18


def maybe_among(keys: DataFrame, column: str) -> Column:
    """Whether a row's ``column`` may be in ``keys``: false for most others, while these are
    few against a table of fixed size, and never false for one of them."""
    place = F.pmod(F.xxhash64(column), F.lit(_PLACES)).cast("int")
    table = bytearray(_PLACES)
    for row in keys.select(place.alias("place")).distinct().collect():  # at most _PLACES rows
        table[row.place] = 1
    return F.substr(F.lit(bytes(table)), place + 1, F.lit(1)) == F.lit(b"\x01")


def chunk_digests(content: Column | str, chunk_bytes: int) -> Column:
    """The SHA-256 of each chunk of a content, in order; an empty content is one empty chunk."""
    data = as_col(content).cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(chunk_bytes))
    return F.transform(starts, lambda at: F.unhex(F.sha2(F.substr(data, at + 1, F.lit(chunk_bytes)), 256)))


def chunk_root(digests: Column | str) -> Column:
    """One digest for a file from those of its chunks."""
    joined = F.array_join(F.transform(as_col(digests), lambda d: F.hex(d)), "")
    return F.sha2(joined, 256)


def staged_duplicates(
    files: DataFrame, algorithm: str = "blake2b", content: str = "content", exclude: Iterable[str] = (),
    min_size: int = 0, max_size: int = 0, limit: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of files with a content column, after the filters, in stages.

    Only files whose size repeats go on; a table of fixed size tells the scan which those may
    be, so contents are digested where they are read and never shuffled. (path, size, digests)
    alone are grouped.
    """
    kept = files.filter(path_allowed("path", exclude) & size_between("size", min_size, max_size))
    sizes = cut_lineage(kept.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("size"))
    digests = [fast_hash(content).alias("fast"), digest(content, "sha256").alias("strong"), digest(content, algorithm).alias("hash")]
    keyed = cut_lineage(
        kept.filter(maybe_among(sizes, "size")).select("path", "size", "mod_time", *digests).join(sizes, "size", "left_semi"))
    groups = cut_lineage(
        keyed.groupBy("size", "fast", "strong", "hash")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"), F.min(F.struct("mod_time", "path")).alias("_first"))
        .filter("files > 1")
    )
    shown = groups.select(
        F.col("hash").alias("id"), "size", "files", "total_size", ((F.col("files") - 1) * F.col("size")).alias("saveable_size"),
        F.lit(algorithm).alias("hash_type"), F.lit(1.0).alias("confidence"), F.col("_first.path").alias("survivor"),
    )
    keys = groups.select("size", "fast", "strong", F.col("hash").alias("group_id"), F.col("_first.path").alias("survivor"), "files")
    members = skew_join(keyed, keys, ["size", "fast", "strong"], "inner", ["path"], limit, rows_per_key="files").select(
        "group_id", "path", "size", "mod_time", "survivor", (F.col("path") == F.col("survivor")).alias("keep"))
    return shown, members


def staged_file_duplicates(
    files: DataFrame, algorithm: str = "blake2b", first_bytes: int = 64 * 1024, exclude: Iterable[str] = (),
    min_size: int = 0, max_size: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of files (path, size, mod_time) on a mount that all executors share:
    size, then a hash of the first bytes, then the digest, then a comparison of the bytes.

    Each stage reads only what the one before left; a file of a unique size is never opened,
    and files of at most ``first_bytes`` are read once before the comparison. ``members``
    has ``identical``: whether the bytes equal the survivor's, null where they cannot be read.
    A file that could not be read in some stage is a member without a group, with ``error``.
    """
    from treeline.sources.listing import hash_files, same_bytes

    kept = files.select("path", "size", "mod_time").filter(
        path_allowed("path", exclude) & size_between("size", min_size, max_size))
    first = cut_lineage(hash_files(same_size(kept), "xxhash64", first_bytes=first_bytes))
    heads = first.filter("error IS NULL")
    likely = same_fast_hash(heads.select("path", "size", "mod_time", F.col("hash").alias("fast")))
    second = cut_lineage(hash_files(likely.select("path", "size", "mod_time"), algorithm))
    hashed = second.filter("error IS NULL").drop("error")
    groups = duplicate_groups(hashed, algorithm)
    members = same_bytes(duplicate_members(hashed, groups)).withColumn("error", F.lit(None).cast("string"))
    failed = first.filter("error IS NOT NULL").unionByName(second.filter("error IS NOT NULL")).drop("hash")
    return groups, members.unionByName(failed, allowMissingColumns=True)


def duplicate_members(
    hashed: DataFrame, groups: DataFrame, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Every file of every group with its group id and survivor."""
    keyed = groups.select("size", F.col("id").alias("hash"), "survivor", "files")
    joined = skew_join(
        hashed.select("path", "size", "mod_time", "hash"), keyed, ["size", "hash"], "inner",
        ["path"], limit, rows_per_key="files",
    )
    return joined.select(
        F.col("hash").alias("group_id"), "path", "size", "mod_time", "survivor",
        (F.col("path") == F.col("survivor")).alias("keep"),
    )


def plan_dedup(members: DataFrame) -> DataFrame:
    """Keep the survivor of each group, remove the others."""
    return members.select(
        F.col("path").alias("source_path"),
        F.lit(None).cast("string").alias("target_path"),
        F.when(F.col("keep"), "keep").otherwise("remove").alias("action"),
        F.lit("planned").alias("status"),
        F.when(F.col("keep"), "oldest of its group")
        .otherwise(F.concat(F.lit("duplicate of "), F.col("survivor"))).alias("reason"),
        "size",
    )


def verify_bytes(
    files: DataFrame, members: DataFrame, content: str = "content", limit: int = ROWS_PER_TASK, chunk_bytes: int = 64 * 1024
) -> DataFrame:
    """Stage 4: compare each member's content with that of its group's survivor, chunk by chunk.

    The chunks' SHA-256 digests are computed where contents are read, so that digests alone
    move; ``differs_at`` is the offset of the first chunk that is not the same. A table of
    fixed size lets the scan skip most files that are no members; a hot group's survivor is
    copied per slot.
    """
    digests = files.filter(maybe_among(members, "path")).select("path", chunk_digests(content, chunk_bytes).alias("_own"))
    fetched = digests.join(members.select("path", "group_id", "size", "keep"), "path")
    kept = fetched.filter("keep").select("group_id", "size", F.col("_own").alias("_kept"))
    checked = skew_join(fetched, kept, ["group_id", "size"], "inner", ["path"], limit)
    same = F.col("_own").eqNullSafe(F.col("_kept"))
    pairs = F.arrays_zip("_own", "_kept")
    first = F.array_position(F.transform(pairs, lambda p: p["_own"].eqNullSafe(p["_kept"])), False)
    return checked.select(
        "group_id", "path", "size", same.alias("identical"), F.when(~same, (first - 1) * chunk_bytes).alias("differs_at"))


def dedup_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("saveable_size"), F.lit(0)).alias("saveable_size"),
    )


def largest_groups(groups: DataFrame, count: int) -> DataFrame:
    """The groups with most to save: a top-k, no full sort."""
    return groups.orderBy(F.desc("saveable_size"), "id", "size").limit(count)
