"""Derived columns of an inventory, and counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import kinds, labels, paths, rules


def enrich(inv: DataFrame) -> DataFrame:
    """All path, kind and size columns in one narrow pass."""
    with_ext = inv.withColumns(
        {
            "name": paths.base_name("path"),
            "parent": paths.parent_of("path"),
            "depth": paths.depth("path"),
            "ext": paths.extension("path"),
            "is_hidden": rules.is_hidden("path"),
            "size_h": labels.size_label("size"),
        }
    )
    with_mime = with_ext.withColumn("mime_type", kinds.mime_type(F.col("ext")))
    mime = F.col("mime_type")
    return with_mime.withColumns(
        {
            "category": kinds.category(mime),
            **{f"is_{k}": kinds.mime_is(mime, k) for k in ("image", "video", "audio", "text")},
        }
    )


def type_census(enriched: DataFrame) -> DataFrame:
    """Files and bytes per category and extension, with subtotals and the total."""
    return (
        enriched.rollup("category", "ext")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
             F.grouping_id().alias("level"))
    )


def scope_estimate(inv: DataFrame) -> DataFrame:
    """Counts and bytes an operation over this input would touch."""
    return inv.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("is_dir")).alias("directories"),
        F.count_if(~F.col("is_dir")).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    )
