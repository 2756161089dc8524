"""Exact deduplication by skew-safe combining, with DataFrame functions only.

1. Local: the partial aggregation of each input partition leaves one row per text.
2. Salted: partitions are dealt over ``salts`` groups, so a text that a third of all
   rows share meets in many tasks of at most (partitions / salts) rows.
3. Global: the at most ``salts`` winners of a text are combined.

Every combining stage groups by the whole normalised text beside its digest, so texts
are merged only when they are equal. Rows find their group by digest keys alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.session import cut_lineage

#: Runs that differ from one space; replacing them equals replacing every run.
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
SALTS = 64


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _first(key: str, tag: str) -> Column:
    """Orders rows by id, null ids last, then by tag."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(tag).alias("tag"))


def text_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text of rows (id, text, digest, second): its least id and size.

    ``rows`` must have deterministic content; the salt is the input partition.
    """
    keys = ["digest", "second", "text"]
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("salt", *keys)
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    )
    # by digest: the texts of one digest meet in one task, whose rows are at most salts a text
    return (
        salted.repartition("digest", "second")
        .groupBy(*keys)
        .agg(F.min("id").alias("keep_id"), F.sum("size").alias("group_size"))
    )


def _one_text_each(groups: DataFrame) -> DataFrame:
    """Stops the job should two texts agree in digest and second hash."""
    size = F.when(F.count(F.lit(1)) == 1, F.sum("group_size")).otherwise(
        F.raise_error(F.lit("two texts share both digests")).cast("bigint")
    )
    return groups.groupBy("digest", "second").agg(F.min("keep_id").alias("keep_id"), size.alias("group_size"))


def exact_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, digest.

    Rows belong together when their normalised texts are equal. The row with the least
    key stays; null keys come last; of rows that repeat key and text exactly one stays.
    Null and empty texts are equal to each other. An empty table gives an empty result.
    Other columns are not read, whatever their names.

    ``digest`` may be weak: rows find their group by it and a second hash of the text,
    and the job stops, instead of merging, should two texts agree in both.
    """
    plain = docs.select(F.col(key).alias("id"), normalised(text).alias("text"))
    keyed = plain.select("id", "text", digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("second"))
    rows = cut_lineage(keyed.select("id", "digest", "second").withColumn("tag", F.monotonically_increasing_id()))
    found = _one_text_each(text_groups(keyed, salts))
    first = rows.groupBy("digest", "second").agg(F.min(_first("id", "tag")).alias("first"))
    groups = cut_lineage(
        found.join(first, ["digest", "second"]).select(
            "digest", "second", "keep_id", "group_size", F.col("first.tag").alias("first_tag")
        )
    )
    # rows of a hot text are split by Spark's skew join: one group row meets all of them
    return rows.join(groups, ["digest", "second"]).select(
        F.col("id").alias(key), "keep_id", "group_size",
        (F.col("tag") == F.col("first_tag")).alias("kept"), "digest",
    )


def one_row(row: str, docs: DataFrame) -> Column:
    """The least of equal-keyed structs ``row`` of all columns of ``docs``; by their JSON where
    some column has no order."""
    def orderable(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(orderable(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return orderable(kind.elementType)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return (F.min(row) if orderable(docs.schema) else F.min_by(row, F.to_json(row))).alias(row)


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Of rows that repeat key and
    text one stays; where all keys of a text are null, one of its rows stays."""
    t = normalised(text)
    names = docs.columns
    spare = "_" * (max(map(len, names)) + 1)  # helper names that cannot clash
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        sha256_of(t).alias("digest"), F.xxhash64(t).alias("second"),
    )
    groups = exact_groups(docs, key, text, salts)
    def of(kind: str) -> DataFrame:
        some = groups.filter(kind).select("digest", "second", "keep_id")
        joined = keyed.join(some, ["digest", "second"])
        return joined.filter(F.col(f"row.`{key}`").eqNullSafe(F.col("keep_id")))

    out = of("single").select("row")
    if not groups.filter("NOT single").isEmpty():
        one = of("NOT single").groupBy("digest", "second").agg(one_row("row", docs))
        out = out.unionByName(one.select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(f"{spare}{i}") for i, c in enumerate(names)]).toDF(*names)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, second, keep_id, group_size and ``single``: whether
    exactly one row of the text has that key. Materialised, as rows are matched with it again."""
    plain = docs.select(F.col(key).alias("id"), normalised(text).alias("text"))
    keyed = plain.select("id", "text", sha256_of(F.col("text")).alias("digest"), F.xxhash64("text").alias("second"))
    found = _one_text_each(text_groups(keyed, salts))
    again = (
        keyed.groupBy("id", "digest", "second").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("id").alias("keep_id"), "digest", "second", F.lit(True).alias("again"))
    )
    marked = found.alias("f").join(
        again.alias("a"),
        [F.col("f.digest") == F.col("a.digest"), F.col("f.second") == F.col("a.second"),
         F.col("f.keep_id").eqNullSafe(F.col("a.keep_id"))], "left",
    )
    return cut_lineage(
        marked.select("f.digest", "f.second", "f.keep_id", "f.group_size", F.col("a.again").isNull().alias("single"))
    )
