"""Inventories, samples and settings derived from the given tables, in Spark and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.paths import ancestors
from treeline.session import prepare
from treeline.skew import skew_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same question for the reference database."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Let all cores share a heavy per-row computation over a scan with fewer splits than
    cores, such as a file of one row group. Scans with enough splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


EXTENSIONS = (".txt", ".md", ".html", ".json", ".pdf", ".jpg", ".png", ".mp3", ".mp4", ".zip", ".gz",
              ".js", ".bin", ".log", ".tmp", ".css")
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
DAY_ZERO = 1704067200  # 2024-01-01 00:00:00 UTC


def _hours(col: str):
    return F.timestamp_seconds(F.lit(DAY_ZERO) + F.col(col) * 3600)


def _ext():
    return F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 16 + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file with its text as content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/f"), "doc_id", _ext()).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        _hours("doc_id").alias("mod_time"),
        F.lit(False).alias("is_dir"),
        F.lit(420).cast("bigint").alias("mode"),
        F.col("text").alias("content"),
        "doc_id",
    )


# The same as SQL, to follow WITH. Times are microseconds since 1970.
FILES_SQL = f"""inv AS (
  SELECT '/data/' || lang || '/' || source || '/f' || doc_id || ext AS path, strlen(text) AS size,
         {DAY_ZERO}000000 + doc_id * 3600000000 AS mod_us, ext, text AS content, doc_id
  FROM (SELECT *, ({_EXT_SQL})[doc_id % 16 + 1] AS ext FROM documents))"""

CATEGORY_SQL = """CASE WHEN ext IN ('.jpg', '.png') THEN 'images' WHEN ext = '.mp4' THEN 'videos'
  WHEN ext = '.mp3' THEN 'audio' WHEN ext IN ('.txt', '.md', '.html', '.css', '.pdf') THEN 'documents'
  WHEN ext IN ('.zip', '.gz') THEN 'archives' ELSE 'other' END"""

_LEAF_NAMES = ["d"] * 5 + [".d"] + ["d"] * 5 + ["node_modules"] + ["d"] * 2 + [".git", "d"]


def _leaf():
    kind = F.element_at(F.array(*[F.lit(n) for n in _LEAF_NAMES]), (F.col("doc_id") % 16 + 1).cast("int"))
    name = F.when(kind.isin("d", ".d"), F.concat(kind, "doc_id")).otherwise(kind)
    return F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/b"),
                    (F.col("doc_id") % 8).cast("string"), F.lit("/"), name)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory per document; labelled documents have a file in theirs, hidden for
    quality 0. So directories of unlabelled documents are empty."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", _leaf().alias("leaf"), _ext().alias("ext"), F.octet_length("text").cast("bigint").alias("size")
    )
    dirs = (
        docs.select(F.explode(F.array_append(ancestors("leaf"), F.col("leaf"))).alias("path"))
        .filter("path <> '/'")
        .distinct()
        .select("path", F.lit(0).cast("bigint").alias("size"),
                F.timestamp_seconds(F.lit(DAY_ZERO)).alias("mod_time"), F.lit(True).alias("is_dir"),
                F.lit(0o755 | 1 << 31).cast("bigint").alias("mode"))
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = docs.join(labels, "doc_id").select(
        F.concat("leaf", F.when(F.col("quality") == 1, "/f").otherwise("/.f"), "doc_id", "ext").alias("path"),
        "size",
        _hours("doc_id").alias("mod_time"),
        F.lit(False).alias("is_dir"),
        F.lit(420).cast("bigint").alias("mode"),
    )
    both = dirs.unionByName(held)
    return both.withColumn("name", F.substring_index("path", "/", -1))


_LEAF_SQL = ("'/data/' || lang || '/' || source || '/b' || (doc_id % 8) || '/' || CASE WHEN kind IN ('d', '.d') "
             "THEN kind || doc_id ELSE kind END")
_KIND_SQL = "([" + ", ".join(f"'{n}'" for n in _LEAF_NAMES) + "])[doc_id % 16 + 1]"
TREE_SQL = f"""leaves AS (
  SELECT doc_id, lang, source, {_LEAF_SQL} AS leaf, ({_EXT_SQL})[doc_id % 16 + 1] AS ext, strlen(text) AS size
  FROM (SELECT *, {_KIND_SQL} AS kind FROM documents)),
tree AS (
  SELECT DISTINCT path, 0 AS size, {DAY_ZERO}000000 AS mod_us, true AS is_dir, {0o755 | 1 << 31} AS mode FROM (
    SELECT leaf AS path FROM leaves UNION ALL SELECT regexp_replace(leaf, '/[^/]*$', '') FROM leaves
    UNION ALL SELECT '/data/' || lang || '/' || source FROM leaves UNION ALL SELECT '/data/' || lang FROM leaves
    UNION ALL SELECT '/data')
  UNION ALL
  SELECT leaf || CASE WHEN quality = 1 THEN '/f' ELSE '/.f' END || doc_id || ext, size,
         {DAY_ZERO}000000 + doc_id * 3600000000, false, 420
  FROM leaves JOIN labels USING (doc_id))"""
PARENT_SQL = "regexp_replace(path, '/[^/]*$', '')"
BASE_SQL = "regexp_extract(path, '([^/]*)$', 1)"
CLEANUP_OK_SQL = f"""NOT ({BASE_SQL} IN ('.git', '.svn', '.hg', 'node_modules', '__pycache__', '.DS_Store')
  OR {BASE_SQL} LIKE '.%')"""

KINDS = {"signup": "start", "view": "pause", "click": "resume", "purchase": "complete", "error": "fail"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


def kind_column():
    out = F.lit(None).cast("string")
    for event, kind in KINDS.items():
        out = F.when(F.col("event_type") == event, kind).otherwise(out)
    return out


def increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress increments per user: an event did some items and bytes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "ts", "event_id",
        (F.col("value") * 1000).cast("bigint").alias("d_items"),
        ((F.col("value") * 1000).cast("bigint") * 64).alias("d_bytes"),
    )


ORDER = ("ts", "event_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeline.operators.telemetry import running_totals

    done = running_totals(increments(spark, sf_dir), ORDER)
    totals = increments(spark, sf_dir).groupBy("id").agg(
        F.sum("d_items").alias("total_items"), F.count(F.lit(1)).alias("rows"))
    joined = skew_join(done, totals, ["id"], "inner", ["event_id"], rows_per_key="rows")
    return joined.select("id", "ts", "event_id", "items", "bytes", "total_items")


INCREMENTS_SQL = """inc AS (
  SELECT user_id AS id, epoch_us(ts) AS us, event_id, trunc(value * 1000)::BIGINT AS d_items,
         trunc(value * 1000)::BIGINT * 64 AS d_bytes FROM events)"""
SAMPLES_SQL = INCREMENTS_SQL + """,
samples AS (
  SELECT id, us, event_id, (sum(d_items) OVER w)::BIGINT AS items, (sum(d_bytes) OVER w)::BIGINT AS bytes,
         (sum(d_items) OVER (PARTITION BY id))::BIGINT AS total_items
  FROM inc WINDOW w AS (PARTITION BY id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))"""


def life_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "ts", "event_id", kind_column().alias("kind")
    )
