"""Inventory and result tables: lookups, upserts, filters, and readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.paths import as_root, is_under, separators
from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK, skew_join

_PREDICATE_ROOTS = 64
_CSV_NULL = "\\N"
# Everything is quoted, quotes are doubled, blanks stay, and a null is not an empty text.
_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def under_roots(
    inv: DataFrame, roots: Sequence[str] | DataFrame, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Records at or below any root, each once however many roots cover it.

    A short list of roots becomes a predicate that reaches the scan. A table of roots
    (column ``path``) is joined on the record's ancestors, never by a prefix comparison.
    Slashes at the end of a root do not matter either way.
    """
    if not isinstance(roots, DataFrame):
        roots = list(dict.fromkeys(r.rstrip("/") or "/" for r in roots))
        if not roots:
            return inv.limit(0)
        if len(roots) <= _PREDICATE_ROOTS:
            keep = is_under("path", F.lit(roots[0]))
            for root in roots[1:]:
                keep = keep | is_under("path", F.lit(root))
            return inv.filter(keep)
        roots = inv.sparkSession.createDataFrame([(r,) for r in roots], "path string")
    hits = covered_by(inv, roots.select(as_root("path").alias("root")).distinct(), limit)
    return inv.join(hits.select("path").distinct(), "path", "left_semi")


def covered_by(inv: DataFrame, roots: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """(path, root, ...) for every record and every root at or above it.

    An equi-join on the record's ancestors, but only on those at the depths that roots
    have: roots of one depth cost one row per record. A root may cover a large share of
    all records, so hot roots are spread over slots. The roots are written once, since
    they are read for their depths and for the join.
    """
    roots = cut_lineage(roots)
    level = F.when(F.col("root") == "/", 0).otherwise(separators("root"))
    # as many entries as there are different depths
    levels = roots.agg(F.collect_set(level.cast("int"))).scalar()
    own = F.when(F.col("path") == "/", 0).otherwise(separators("path"))
    lines = (
        inv.select("path", levels.alias("_levels"))
        .select("path", F.explode(F.filter("_levels", lambda n: n <= own)).alias("_n"))
        .select(
            "path",
            F.when(F.col("_n") == 0, "/")
            .otherwise(F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("_n") + 1))
            .alias("root"),
        )
    )
    return skew_join(lines, roots, ["root"], "inner", ["path"], limit)


def union_roots(inventories: Sequence[DataFrame]) -> DataFrame:
    """Append scans of several roots; a path seen by more than one counts once."""
    out = inventories[0]
    for more in inventories[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.dropDuplicates(["path"])


def lookup(inv: DataFrame, paths: DataFrame) -> DataFrame:
    """Each requested path with its record, or with ``found`` false."""
    known = inv.dropDuplicates(["path"]).withColumn("found", F.lit(True))
    return paths.join(known, "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing_paths(paths: DataFrame, inv: DataFrame) -> DataFrame:
    return (
        paths.join(inv.select("path"), "path", "left_anti")
        .withColumn("error", F.concat(F.lit("path does not exist: "), "path"))
    )


def existing_paths(paths: DataFrame, inv: DataFrame) -> DataFrame:
    return paths.join(inv.select("path"), "path", "left_semi")


def upsert_inventory(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest record per path; of equally old ones the incoming record wins.

    An aggregate, not a window, so repeated saves of one path collapse map-side.
    """
    both = existing.withColumn("_turn", F.lit(0)).unionByName(incoming.withColumn("_turn", F.lit(1)))
    columns = existing.columns
    newest = F.max_by(F.struct(*columns), F.struct("mod_time", "_turn"))
    return both.groupBy("path").agg(newest.alias("_r")).select(*[F.col(f"_r.{c}") for c in columns])


def list_results(results: DataFrame, equal: dict[str, object]) -> DataFrame:
    for column, value in equal.items():
        results = results.filter(F.col(column) == F.lit(value))
    return results


def explode_errors(results: DataFrame) -> DataFrame:
    return results.select("id", F.explode("errors").alias("e")).select("id", "e.*")


def explode_files(results: DataFrame) -> DataFrame:
    return results.select("id", F.explode("files_affected").alias("path"))


def explode_details(results: DataFrame) -> DataFrame:
    return results.select("id", F.explode("details").alias("key", "value"))


def _marked(text):
    """A text that is the null marker, or that with more backslashes, gets one backslash more."""
    return F.when(F.regexp_like(text, F.lit(r"\A\\+N\z")), F.concat(F.lit("\\"), text)).otherwise(text)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """Write as parquet, orc, json or csv. Nested columns go to csv as JSON text."""
    if fmt == "csv":
        nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
        text = [F.to_json(c) if c in nested else F.col(c).cast("string") for c in df.columns]
        df = df.select(*[F.coalesce(_marked(t), F.lit(_CSV_NULL)).alias(c) for t, c in zip(text, df.columns)])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**_CSV, quoteAll=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_results(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        found = reader.options(**_CSV, multiLine=True, nullValue=_CSV_NULL).load(path)
        plain = {
            f.name: F.when(F.regexp_like(f.name, F.lit(r"\A\\{2,}N\z")), F.substr(f.name, F.lit(2))).otherwise(F.col(f.name))
            for f in found.schema.fields if f.dataType.typeName() == "string"
        }
        return found.withColumns(plain) if plain else found
    return reader.load(path)


def save_duplicates(groups: DataFrame, members: DataFrame, folder: str) -> None:
    write_results(groups, f"{folder}/dup_groups")
    write_results(members, f"{folder}/dup_members")


def load_duplicates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/dup_groups"), spark.read.parquet(f"{folder}/dup_members")
