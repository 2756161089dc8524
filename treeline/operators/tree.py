"""Directory structure: children, empty directories, cleanup plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import ancestors, parent_of
from treeline.functions.rules import cleanup_allows


def dir_children(inv: DataFrame) -> DataFrame:
    """Number and bytes of the direct children per directory; sums collapse map-side."""
    entries = inv.filter(F.col("path") != "/")
    return entries.groupBy(parent_of("path").alias("parent")).agg(
        F.count(F.lit(1)).alias("children"),
        F.count_if(F.col("is_dir")).alias("child_dirs"),
        F.sum("size").alias("child_bytes"),
    )


def count_dirs(inv: DataFrame, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> DataFrame:
    keep = cleanup_allows("path", exclude, include)
    return inv.agg(
        F.count_if(F.col("is_dir") & keep).alias("total_directories"),
        F.count(F.lit(1)).alias("items_scanned"),
    )


def _readable(inv: DataFrame) -> Column:
    """Records whose listing did not fail; an inventory without ``error`` has no failures."""
    return F.col("error").isNull() if "error" in inv.columns else F.lit(True)


def empty_dirs(inv: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Directories without any recorded child. Hidden and excluded children count, and a
    directory that could not be listed (``error`` is set) is not known to be empty.

    Only the distinct parents are shuffled, so a huge folder is one row per task.
    """
    parents = inv.filter(F.col("path") != "/").select(parent_of("path").alias("path")).distinct()
    dirs = inv.filter(F.col("is_dir") & _readable(inv))
    if allowed is not None:
        dirs = dirs.filter(allowed)
    return dirs.join(parents, "path", "left_anti")


def empty_trees(inv: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Directories with no file anywhere below them, and nothing that could not be listed.

    Every folder that holds a file marks its ancestors as used; no recursion. So does what
    is neither known to be a directory nor readable, itself included.
    """
    files = inv.filter(~F.coalesce("is_dir", F.lit(False))).select(parent_of("path").alias("dir"))
    holders = files.unionByName(inv.filter(~_readable(inv)).select(F.col("path").alias("dir"))).distinct()
    used = holders.select(
        F.explode(F.array_append(ancestors("dir"), F.col("dir"))).alias("path")
    ).distinct()
    dirs = inv.filter("is_dir")
    if allowed is not None:
        dirs = dirs.filter(allowed)
    return dirs.join(used, "path", "left_anti")


def plan_cleanup(
    inv: DataFrame,
    exclude: Iterable[str] = (),
    include: Iterable[str] = (),
    dry_run: bool = False,
    failed: DataFrame | None = None,
    cascade: bool = False,
) -> DataFrame:
    """Plan rows for empty directories.

    ``failed`` (path, error) lists removals known to fail: those rows are skipped and
    carry the error. ``cascade`` takes whole empty subtrees instead of one level.
    """
    find = empty_trees if cascade else empty_dirs
    targets = find(inv, cleanup_allows("path", exclude, include)).select("path")
    if failed is None or dry_run:
        targets = targets.withColumn("error", F.lit(None).cast("string"))
    else:
        targets = targets.join(failed.select("path", "error"), "path", "left")
    removed = F.lit("would_remove" if dry_run else "removed")
    return targets.select(
        F.col("path").alias("source_path"),
        F.lit(None).cast("string").alias("target_path"),
        F.lit("remove").alias("action"),
        F.when(F.col("error").isNull(), removed).otherwise("skipped").alias("status"),
        F.coalesce(
            F.concat(F.lit("failed to remove directory "), "path", F.lit(": "), "error"),
            F.lit("empty directory"),
        ).alias("reason"),
        F.lit(0).cast("bigint").alias("size"),
    )
