"""Applying plans to an inventory snapshot. All functions return a new inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import ancestors, base_name, is_under, parent_of
from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK
from treeline.sources.tables import covered_by

# Fixed value: permissions of a created directory (0755), with the directory bit.
DIR_MODE = 0o755 | 1 << 31


def apply_remove(inv: DataFrame, targets: DataFrame) -> DataFrame:
    """Remove paths, deepest first: a directory stays if anything below it stays.

    What stays are the records that are no target; their ancestors stay with them.
    """
    gone = targets.select("path").distinct()
    rest = inv.join(gone, "path", "left_anti").filter(F.col("path") != "/")
    holders = rest.select(parent_of("path").alias("dir")).distinct()
    used = holders.select(F.explode(F.array_append(ancestors("dir"), F.col("dir"))).alias("path")).distinct()
    return inv.join(gone.join(used, "path", "left_anti"), "path", "left_anti")


def apply_remove_tree(inv: DataFrame, targets: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Remove paths with all that is below them; '/a/b' does not touch '/a/bc'."""
    roots = targets.select(F.col("path").alias("root")).distinct()
    gone = covered_by(inv, roots, limit).select("path").distinct()
    return inv.join(gone, "path", "left_anti")


def _rewritten() -> Column:
    return F.concat("target", F.substr("path", F.length("root") + 1, F.length("path")))


def _possible(pairs: DataFrame) -> DataFrame:
    """A tree cannot go below itself."""
    return pairs.filter(~is_under("target", "source")).select(
        F.col("source").alias("root"), "target"
    )


def _one_per_path(rows: DataFrame, columns: list[str], rank: list[str]) -> DataFrame:
    newest = F.max_by(F.struct(*columns), F.struct(*rank))
    return rows.groupBy("path").agg(newest.alias("_r")).select(*[F.col(f"_r.{c}") for c in columns])


def apply_move(inv: DataFrame, moves: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Rename ``source`` to ``target`` with everything below; the deepest matching
    source decides. What was at the new path is replaced; of several movers to one
    path the one with the latest (mod_time, old path) stays."""
    hits = covered_by(inv, _possible(moves), limit)
    # read for the rows that move and for those that stay, so the join runs once
    best = cut_lineage(
        hits.groupBy("path")
        .agg(F.max(F.struct(F.length("root").alias("n"), "root", "target")).alias("_m"))
        .select("path", F.col("_m.root").alias("root"), F.col("_m.target").alias("target"))
    )
    moved = (
        inv.join(best, "path")
        .withColumn("_old", F.col("path"))
        .withColumn("path", _rewritten())
        .withColumn("name", base_name("path"))
    )
    moved = _one_per_path(moved, inv.columns, ["mod_time", "_old"])
    stay = inv.join(best.select("path"), "path", "left_anti")
    return stay.join(moved.select("path"), "path", "left_anti").unionByName(moved)


def apply_copy(
    inv: DataFrame, copies: DataFrame, now: Column, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Copy a file or a whole directory; mode stays, mod_time is ``now``, and missing
    parents are created. One source may go to several targets."""
    hits = cut_lineage(covered_by(inv, _possible(copies), limit))
    made = (
        inv.join(hits, "path")
        .withColumn("_old", F.col("path"))
        .withColumn("path", _rewritten())
        .withColumn("name", base_name("path"))
        .withColumn("mod_time", now)
    )
    made = _one_per_path(made, inv.columns, ["_old"])
    merged = inv.join(made.select("path"), "path", "left_anti").unionByName(made)
    # only copies that were made need folders: a missing source makes none
    return apply_create_dirs(merged, made.select(parent_of("path").alias("path")).distinct(), now)


def apply_create_dirs(inv: DataFrame, dirs: DataFrame, now: Column) -> DataFrame:
    """Create directories and their missing parents."""
    wanted = dirs.select(
        F.explode(F.array_append(ancestors("path"), F.col("path"))).alias("path")
    ).distinct()
    fresh = wanted.join(inv.select("path"), "path", "left_anti")
    given = {
        "path": F.col("path"), "name": base_name("path"), "size": F.lit(0), "mod_time": now,
        "is_dir": F.lit(True), "mode": F.lit(DIR_MODE),
    }
    rows = fresh.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in inv.schema.fields
        ]
    )
    return inv.unionByName(rows)


def apply_ownership(inv: DataFrame, plan: DataFrame) -> DataFrame:
    """Set uid and gid where the plan changed them; other rows keep theirs."""
    done = plan.filter(F.col("status") == "changed").select(
        F.col("source_path").alias("path"), F.col("uid").alias("_uid"), F.col("gid").alias("_gid")
    )
    joined = inv.join(done, "path", "left")
    keep = [c for c in inv.columns if c not in ("uid", "gid")]
    before = {c: F.col(c) if c in inv.columns else F.lit(None).cast("bigint") for c in ("uid", "gid")}
    return joined.select(
        *keep,
        *[F.coalesce(f"_{c}", before[c]).cast("bigint").alias(c) for c in ("uid", "gid")],
    )


def apply_plan(inv: DataFrame, plan: DataFrame, now: Column, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Apply the copies, moves and removals of a plan, in this order; skipped and
    conflicting rows do nothing.

    The plan is materialised, since it was made from the same inventory, and so is the
    snapshot between two kinds of action: the plan of a query stays small.
    """
    live = cut_lineage(
        plan.filter(~F.col("status").isin("skipped", "conflict", "would_remove")).select(
            "action", F.col("source_path").alias("source"), F.col("target_path").alias("target")
        )
    )
    present = {row["action"] for row in live.select("action").distinct().collect()}  # a few names
    steps = {
        "copy": lambda snap, rows: apply_copy(snap, rows, now, limit),
        "move": lambda snap, rows: apply_move(snap, rows, limit),
        "remove": lambda snap, rows: apply_remove(snap, rows.select(F.col("source").alias("path"))),
    }
    todo = [name for name in steps if name in present]
    for turn, name in enumerate(todo):
        rows = live.filter(F.col("action") == name).select("source", "target")
        inv = steps[name](inv, rows)
        if turn < len(todo) - 1:
            inv = cut_lineage(inv)
    return inv


def backup_manifest(plan: DataFrame, backup_dir: str) -> DataFrame:
    """Copies to make before the removals of a plan."""
    removals = plan.filter((F.col("action") == "remove") & (F.col("status") != "skipped"))
    return removals.select(
        "source_path",
        F.concat(F.lit(backup_dir.rstrip("/")), "source_path").alias("target_path"),
        F.lit("copy").alias("action"),
        F.lit("planned").alias("status"),
        F.lit("backup before removal").alias("reason"),
        "size",
    )


def snapshot_diff(
    before: DataFrame, after: DataFrame, compare: tuple[str, ...] = ("size", "mod_time", "is_dir")
) -> DataFrame:
    """Added, removed and modified paths between two inventories: one join on path."""
    b = before.select("path", F.struct(*compare).alias("_b"))
    a = after.select("path", F.struct(*compare).alias("_a"))
    both = b.join(a, "path", "full")
    change = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    )
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")
