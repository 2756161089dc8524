"""Conflicts between planned targets and with the inventory, and their resolution.

Plans here have the columns source_path, target_path, mod_time and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import stem_and_suffix
from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK, running, skew_join


def _contested(plan: DataFrame, inv: DataFrame) -> DataFrame:
    """One row per target that several sources share or that exists already, with the
    first and last claimant by (mod_time, source)."""
    claim = F.struct("mod_time", "source_path")
    targets = plan.groupBy("target_path").agg(
        F.count(F.lit(1)).alias("sharers"),
        F.min(claim).alias("_first"),
        F.max(claim).alias("_last"),
    )
    present = inv.select(F.col("path").alias("target_path")).distinct().withColumn("target_exists", F.lit(True))
    return (
        targets.join(present, "target_path", "left")
        .select(
            "target_path",
            "sharers",
            F.coalesce("target_exists", F.lit(False)).alias("target_exists"),
            F.col("_first.source_path").alias("first_source"),
            F.col("_last.source_path").alias("last_source"),
        )
        .filter("sharers > 1 OR target_exists")
    )


def find_conflicts(plan: DataFrame, inv: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Plan rows whose target exists already (other than as their own source) or is
    shared with another source."""
    hits = skew_join(
        plan, _contested(plan, inv), ["target_path"], "inner", ["source_path"], limit
    )
    taken = F.col("target_exists") & (F.col("source_path") != F.col("target_path"))
    return (
        hits.withColumn("target_exists", taken)
        .filter("sharers > 1 OR target_exists")
        .select("source_path", "target_path", "sharers", "target_exists")
    )


def _taken_numbers(paths: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """(target_path, n): the numbered names of contested targets that someone holds."""
    stem, suffix = stem_and_suffix("path")
    number = F.regexp_extract(stem, r"_([1-9][0-9]{0,17})\z", 1)
    named = paths.filter(number != "").select(
        F.concat(F.substr(stem, F.lit(1), F.length(stem) - F.length(number) - 1), suffix).alias("target_path"),
        number.cast("bigint").alias("n"),
    )
    return skew_join(named.distinct(), targets, ["target_path"], "left_semi", ["n"], limit)


def rename_on_conflict(
    plan: DataFrame, inv: DataFrame, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Give every source a name of its own; adds ``new_path`` and ``status``.

    A source that is its own target stays where it is. The others are numbered by source
    path: the first keeps the name, unless something has it already, and each further one
    becomes ``stem_<n>ext`` with the least n that nobody has: no file of the inventory, no
    target of the plan, no source before it.
    """
    plan = cut_lineage(plan)
    own = F.col("source_path") == F.col("target_path")
    held = inv.select("path").unionByName(plan.filter(own).select(F.col("target_path").alias("path"))).distinct()
    present = held.select(F.col("path").alias("target_path"), F.lit(1).alias("_taken"))
    numbered = running(
        plan.filter(~own), ["target_path"], ["source_path"], {"_turn": ("sum", F.lit(1))}, limit
    )
    ranked = skew_join(numbered, present, ["target_path"], "left", ["source_path"], limit)
    claims = cut_lineage(
        ranked.withColumn("_no", F.col("_turn") - 1 + F.coalesce("_taken", F.lit(0))).drop("_turn", "_taken")
    )
    names = held.unionByName(plan.select(F.col("target_path").alias("path"))).distinct()
    wanted = claims.filter("_no > 0").select("target_path").distinct()
    taken = cut_lineage(_taken_numbers(names, wanted, limit))
    # below the j-th taken number there are n - j free ones; the k-th free one is behind all with n - j < k
    order = running(taken, ["target_path"], ["n"], {"_j": ("sum", F.lit(1))}, limit)
    marks = order.select("target_path", (F.col("n") - F.col("_j")).alias("_at"), F.lit(1).alias("_mark"),
                         F.col("n").cast("string").alias("_row"))
    asked = claims.filter("_no > 0").select("target_path", F.col("_no").alias("_at"), F.lit(0).alias("_mark"),
                                            F.col("source_path").alias("_row"))
    both = running(cut_lineage(marks.unionByName(asked)), ["target_path"], ["_at", "_mark", "_row"],
                   {"_skipped": ("sum", F.col("_mark"))}, limit)
    skipped = both.filter("_mark = 0").select("target_path", F.col("_row").alias("source_path"), "_skipped")
    stem, suffix = stem_and_suffix("target_path")
    number = (F.col("_no") + F.coalesce("_skipped", F.lit(0))).cast("bigint").cast("string")
    moved = claims.join(skipped, ["target_path", "source_path"], "left").select(
        *plan.columns,
        F.when(F.col("_no") == 0, F.col("target_path")).otherwise(F.concat(stem, F.lit("_"), number, suffix)).alias("new_path"),
        F.when(F.col("_no") == 0, "planned").otherwise("renamed").alias("status"),
    )
    stays = plan.filter(own).select(*plan.columns, F.col("target_path").alias("new_path"), F.lit("planned").alias("status"))
    return moved.unionByName(stays)


def resolve_conflicts(
    plan: DataFrame, inv: DataFrame, resolution: str, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Apply skip, overwrite or rename; adds ``new_path`` and ``status``.

    skip: an existing file wins, else the first claimant by (mod_time, source).
    overwrite: the last claimant wins, also over an existing file.
    """
    if resolution == "rename":
        return rename_on_conflict(plan, inv, limit)
    if resolution not in ("skip", "overwrite"):
        raise ValueError(f"unknown conflict resolution: {resolution}")
    joined = skew_join(
        plan, _contested(plan, inv), ["target_path"], "left", ["source_path"], limit
    )
    taken = F.coalesce("target_exists", F.lit(False)) & (F.col("source_path") != F.col("target_path"))
    if resolution == "skip":
        status = (
            F.when(taken, "skipped")
            .when(F.col("sharers") > 1, F.when(F.col("source_path") == F.col("first_source"), "planned")
                  .otherwise("skipped"))
            .otherwise("planned")
        )
    else:
        status = (
            F.when((F.col("sharers") > 1) & (F.col("source_path") != F.col("last_source")), "skipped")
            .when(taken | (F.col("sharers") > 1), "overwrite")
            .otherwise("planned")
        )
    return joined.select(*plan.columns, F.col("target_path").alias("new_path"), status.alias("status"))


def conflict_resolutions(resolved: DataFrame, resolution: str) -> DataFrame:
    """The child table of a plan: one row per conflict that was resolved."""
    touched = resolved.filter("status <> 'planned'")
    return touched.select(
        "source_path",
        "target_path",
        F.lit(resolution).alias("resolution"),
        F.when(F.col("new_path") != F.col("target_path"), F.col("new_path")).alias("new_name"),
    )
