"""Summaries and previews of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many entries a preview shows.
PREVIEW_ROWS = {"changed": 20, "skipped": 10, "errors": 5}


def plan_counts(plan: DataFrame) -> DataFrame:
    """Rows and bytes per action and status."""
    return plan.groupBy("action", "status").agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def cleanup_summary(plan: DataFrame, dry_run: bool = False) -> DataFrame:
    head, verb = ("Cleanup (dry run)", "would be removed") if dry_run else ("Cleanup completed", "removed")
    done = "would_remove" if dry_run else "removed"
    counts = plan.agg(
        F.count_if(F.col("status") == done).alias("removed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    return counts.withColumn(
        "summary",
        F.format_string(f"{head}: %d directories {verb}, %d skipped", "removed", "skipped"),
    )


def ownership_summary(plan: DataFrame, dry_run: bool = False) -> DataFrame:
    state = "dry run" if dry_run else "completed"
    counts = plan.agg(
        F.count_if(F.col("status") == "changed").alias("changed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status").isin("skipped", "error")).alias("errors"),
    )
    return counts.withColumn(
        "summary",
        F.format_string(
            f"Ownership change ({state}): %d items changed, %d skipped, %d errors",
            "changed", "skipped", "errors",
        ),
    )


def preview(df: DataFrame, rows: int, order: str = "path") -> DataFrame:
    """The first rows by ``order`` and how many more there are."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(order).limit(rows).withColumn("more", F.greatest(total - rows, F.lit(0)))
