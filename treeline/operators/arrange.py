"""Plans that move files: consolidation and organisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import kinds, labels, paths
from treeline.operators.conflicts import find_conflicts, resolve_conflicts
from treeline.skew import ROWS_PER_TASK, skew_join

STRATEGIES = ("flat", "date", "type", "pattern")


def _category() -> Column:
    return kinds.category(kinds.mime_type(paths.extension("path")))


def _pattern_target(pattern: str) -> Column:
    """'{category}/{date}/{name}' and the like as one expression."""
    known = {
        "name": paths.base_name("path"),
        "category": _category(),
        "ext": F.ltrim(paths.extension("path"), F.lit(".")),
        "date": labels.date_bucket("mod_time"),
        "year": F.date_format("mod_time", "yyyy"),
        "month": F.date_format("mod_time", "MM"),
        "day": F.date_format("mod_time", "dd"),
        "parent": paths.base_name(paths.parent_of("path")),
    }
    parts = []
    for text, key in re.findall(r"([^{}]+)|\{(\w+)\}", pattern):
        if key and key not in known:
            raise ValueError(f"unknown placeholder: {key}")
        parts.append(known[key] if key else F.lit(text))
    return F.concat(*parts)


def target_path(dest: str, strategy: str, pattern: str | None = None, root: str | None = None) -> Column:
    """Where a file goes. With ``root`` the structure below it is kept."""
    name = paths.base_name("path")
    base = F.lit(dest.rstrip("/"))
    if strategy == "flat":
        folder = base
    elif strategy == "date":
        folder = F.concat_ws("/", base, labels.date_bucket("mod_time"))
    elif strategy == "type":
        folder = F.concat_ws("/", base, _category())
    elif strategy == "pattern":
        return F.concat(base, F.lit("/"), _pattern_target(pattern or "{name}"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    if root is not None:
        start = 1 if root == "/" else len(root.rstrip("/")) + 2
        inside = F.substr("path", F.lit(start), F.length("path"))
        return F.concat_ws("/", folder, inside)
    return F.concat_ws("/", folder, name)


def plan_consolidation(
    files: DataFrame,
    inv: DataFrame,
    dest: str,
    strategy: str = "type",
    conflict: str = "skip",
    move: bool = False,
    pattern: str | None = None,
    root: str | None = None,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Move or copy all files into ``dest``. ``inv`` is what exists already."""
    plan = files.filter(~F.col("is_dir")).select(
        F.col("path").alias("source_path"),
        target_path(dest, strategy, pattern, root).alias("target_path"),
        "mod_time",
        "size",
    )
    done = resolve_conflicts(plan, inv, conflict, limit)
    return done.select(
        "source_path",
        F.col("new_path").alias("target_path"),
        F.lit("move" if move else "copy").alias("action"),
        "status",
        F.when(F.col("status") == "planned", f"by {strategy}")
        .otherwise(F.concat(F.lit(f"by {strategy}, target contested: "), "target_path"))
        .alias("reason"),
        "size",
    )


def consolidation_totals(plan: DataFrame) -> DataFrame:
    """Files and bytes that will be written."""
    live = plan.filter(~F.col("status").isin("skipped", "conflict"))
    return live.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
    )


def learned_rules(inv: DataFrame) -> DataFrame:
    """Per extension the folder that holds most of its files, with support and share.

    Two aggregations; a common extension arrives as one row per folder.
    """
    files = inv.filter(~F.col("is_dir")).select(
        paths.extension("path").alias("ext"), paths.parent_of("path").alias("folder")
    )
    per_folder = files.groupBy("ext", "folder").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "folder"))
    return (
        per_folder.groupBy("ext")
        .agg(best.alias("b"), F.sum("n").alias("total"))
        .select(
            "ext",
            F.col("b.folder").alias("folder"),
            (-F.col("b.neg")).alias("support"),
            (-F.col("b.neg") / F.col("total")).alias("confidence"),
        )
    )


def suggest_organization(
    inv: DataFrame,
    dest: str,
    strategy: str = "type",
    rules: DataFrame | None = None,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """One suggestion per file, with reason, confidence, tags and number of conflicts.

    type, date and project (top directory) are narrow. smart takes ``rules`` (ext,
    folder, confidence), keeps the best rule per extension and falls back on type.
    """
    files = inv.filter(~F.col("is_dir")).withColumns(
        {"ext": paths.extension("path"), "category": _category(), "name": paths.base_name("path")}
    )
    base = F.lit(dest.rstrip("/"))
    by_type = F.concat_ws("/", base, F.col("category"), F.col("name"))
    known = F.when(F.col("category") == "other", F.lit(0.5)).otherwise(F.lit(0.9))
    if strategy == "type":
        target, why, sure = by_type, F.concat(F.lit("category "), "category"), known
    elif strategy == "date":
        target = F.concat_ws("/", base, labels.date_bucket("mod_time"), F.col("name"))
        why, sure = F.lit("modification date"), F.lit(0.9)
    elif strategy == "project":
        top = F.element_at(F.split(F.ltrim("path", F.lit("/")), "/"), 1)
        target = F.concat_ws("/", base, top, F.col("name"))
        why, sure = F.concat(F.lit("project "), top), F.lit(0.7)
    elif strategy == "smart":
        if rules is None:
            raise ValueError("strategy smart needs a table of rules")
        best = rules.groupBy("ext").agg(
            F.min(F.struct((-F.col("confidence")).alias("neg"), "folder")).alias("_b")
        )
        files = skew_join(files, best, ["ext"], "left", ["path"], limit)
        has = F.col("_b").isNotNull()
        target = F.when(has, F.concat_ws("/", F.col("_b.folder"), F.col("name"))).otherwise(by_type)
        why = F.when(has, F.concat(F.lit("rule for "), "ext")).otherwise(
            F.concat(F.lit("category "), "category")
        )
        sure = F.when(has, -F.col("_b.neg")).otherwise(known)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    suggested = files.select(
        F.col("path").alias("source_path"),
        target.alias("target_path"),
        why.alias("reason"),
        sure.alias("confidence"),
        "category",
        F.array("category", F.ltrim("ext", F.lit("."))).alias("tags"),
        "mod_time",
    )
    clashes = find_conflicts(suggested, inv, limit).select(
        "source_path",
        (F.col("sharers") - 1 + F.col("target_exists").cast("bigint")).alias("conflicts"),
    )
    return (
        suggested.join(clashes, "source_path", "left")
        .withColumn("conflicts", F.coalesce("conflicts", F.lit(0).cast("bigint")))
        .drop("mod_time")
        .withColumnRenamed("target_path", "suggested_path")
    )
