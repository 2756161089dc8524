"""Queries on settings, workflows, results, and files read back from storage."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from treeline.catalog.data import FILES_SQL, files, query, table
from treeline.catalog.files_queries import _GROUPS_SQL
from treeline.catalog.tree_queries import _EMPTY_SQL
from treeline.catalog import data
from treeline.functions import labels
from treeline.operators import audit
from treeline.plans.cycles import dealt, workflow_cycles
from treeline.plans.registry import builtin_registry, expose
from treeline.plans.workflow import run_workflow, validate_workflows
from treeline.schema import OPERATION_RESULT
from treeline.session import cut_lineage, scratch
from treeline.skew import skew_join
from treeline.sources import listing, tables
from treeline.sources.chunks import mounted, read_files, whole_digests

_ALGS = ("md5", "sha1", "sha256", "sha512", "blake2b", "xxhash64", "crc32", "md4", "")
_CONFIGS_SQL = f"""configs AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'ownership' ELSE 'cleanup' END AS operation_type,
  p_size - 3 AS parallelism, p_size * 10 AS min_file_size, (p_partkey % 7) * 100 AS max_file_size,
  p_retailprice / 1500 AS similarity_threshold, ([{', '.join(f"'{a}'" for a in _ALGS)}])[p_partkey % 9 + 1] AS hash_algorithm,
  CASE WHEN p_type <> 'PROMO' THEN p_brand END AS target_user FROM part)"""


@query("audit_configs", f"""WITH {_CONFIGS_SQL}
  SELECT id, 'parallelism' AS field, 'parallelism cannot be negative' AS message, parallelism::VARCHAR AS value FROM configs WHERE parallelism < 0
  UNION ALL SELECT id, 'min_file_size', 'min file size cannot be greater than max file size', min_file_size::VARCHAR FROM configs
    WHERE max_file_size > 0 AND min_file_size > 0 AND min_file_size > max_file_size
  UNION ALL SELECT id, 'similarity_threshold', 'similarity threshold must be between 0.0 and 1.0', round(similarity_threshold, 6)::VARCHAR FROM configs
    WHERE similarity_threshold < 0 OR similarity_threshold > 1
  UNION ALL SELECT id, 'hash_algorithm', 'unsupported hash algorithm: ' || hash_algorithm, hash_algorithm FROM configs WHERE hash_algorithm = 'md4'
  UNION ALL SELECT id, 'operation_type', 'target_user parameter is required', operation_type FROM configs
    WHERE operation_type = 'ownership' AND target_user IS NULL""")
def _(spark, sf_dir):
    algs = F.array(*[F.lit(a) for a in _ALGS])
    configs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 40, "ownership").otherwise("cleanup").alias("operation_type"),
        (F.col("p_size") - 3).alias("parallelism"),
        (F.col("p_size") * 10).alias("min_file_size"),
        (F.col("p_partkey") % 7 * 100).alias("max_file_size"),
        (F.col("p_retailprice") / 1500).alias("similarity_threshold"),
        F.element_at(algs, (F.col("p_partkey") % 9 + 1).cast("int")).alias("hash_algorithm"),
        F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("target_user"),
    )
    found = audit.audit_configs(configs)
    number = F.col("field") == "similarity_threshold"
    return found.withColumn(
        "value", F.when(number, F.round(F.col("value").try_cast("double"), 6).cast("string")).otherwise(F.col("value"))
    )


@query("audit_settings", """WITH s AS (SELECT c_custkey AS id, ['blake2b', 'sha256', 'xxhash64', 'crc32', 'md5'][c_nationkey % 5 + 1] AS alg,
    c_acctbal / 9000 AS dup, c_nationkey / 20 AS sim, CASE c_mktsegment WHEN 'BUILDING' THEN 'INFO' WHEN 'MACHINERY' THEN 'trace' ELSE 'warn' END AS lvl FROM customer)
  SELECT id, 'hash_algorithm' AS field, 'invalid hash algorithm: ' || alg AS message FROM s WHERE alg = 'md5'
  UNION ALL SELECT id, 'duplicate_threshold', 'duplicate_threshold must be between 0.0 and 1.0' FROM s WHERE dup < 0 OR dup > 1
  UNION ALL SELECT id, 'similarity_threshold', 'similarity_threshold must be between 0.0 and 1.0' FROM s WHERE sim > 1
  UNION ALL SELECT id, 'log_level', 'invalid log level: trace' FROM s WHERE lvl = 'trace'""")
def _(spark, sf_dir):
    names = F.array(*[F.lit(a) for a in ("blake2b", "sha256", "xxhash64", "crc32", "md5")])
    settings = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.element_at(names, F.col("c_nationkey") % 5 + 1).alias("hash_algorithm"),
        (F.col("c_acctbal") / 9000).alias("duplicate_threshold"),
        (F.col("c_nationkey") / 20).alias("similarity_threshold"),
        F.when(F.col("c_mktsegment") == "BUILDING", "INFO").when(F.col("c_mktsegment") == "MACHINERY", "trace")
        .otherwise("warn").alias("log_level"),
    )
    return audit.audit_settings(settings).select("id", "field", "message")


# A workflow per order: its lines are steps, and each depends on a step named by its part.
_STEPS_SQL = """lines AS (SELECT l_orderkey AS workflow, l_linenumber AS n, min(l_partkey) AS part, min(l_returnflag) AS flag
    FROM lineitem GROUP BY 1, 2),
  steps AS (SELECT workflow, 's' || n AS step, CASE flag WHEN 'A' THEN 'cleanup' WHEN 'N' THEN 'deduplication' ELSE 'compression' END AS type FROM lines),
  deps AS (SELECT workflow, 's' || n AS step, 's' || (part % 8 + 1) AS dep FROM lines
    UNION SELECT workflow, 's' || n, 's' || (n - 1) FROM lines WHERE n > 1)"""


_BACK_SQL = """known AS (SELECT d.* FROM deps d JOIN steps s ON d.workflow = s.workflow AND d.dep = s.step),
  back AS (SELECT workflow, step, dep FROM known UNION SELECT b.workflow, b.step, k.dep FROM back b JOIN known k
    ON b.workflow = k.workflow AND b.dep = k.step)"""


def _workflows(spark, sf_dir):
    given = table(spark, sf_dir, "lineitem")
    # grouped in tasks of a limited number of rows, and once for all three tables
    lines = cut_lineage(
        dealt(given.select(F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("n"), "l_partkey", "l_returnflag"),
              given.count(), ["workflow", "n"])
        .groupBy("workflow", "n")
        .agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    )
    step = F.concat(F.lit("s"), "n").alias("step")
    kind = F.when(F.col("flag") == "A", "cleanup").when(F.col("flag") == "N", "deduplication").otherwise("compression")
    steps = lines.select("workflow", step, kind.alias("type"))
    by_part = lines.select("workflow", step, F.concat(F.lit("s"), F.col("part") % 8 + 1).alias("depends_on"))
    in_turn = lines.filter("n > 1").select("workflow", step, F.concat(F.lit("s"), F.col("n") - 1).alias("depends_on"))
    return steps, by_part.unionByName(in_turn)


@query("validate_workflows", f"""WITH RECURSIVE {_STEPS_SQL},
  {_BACK_SQL},
  circles AS (SELECT workflow, step FROM back WHERE step = dep)
  SELECT workflow, step, 'unknown type compression' AS problem FROM steps WHERE type = 'compression'
  UNION ALL SELECT workflow, step, 'missing dependency ' || dep FROM deps WHERE (workflow, dep) NOT IN (SELECT (workflow, step) FROM steps)
  UNION ALL SELECT DISTINCT b.workflow, b.step, 'cycle' FROM back b JOIN circles c ON b.workflow = c.workflow AND b.dep = c.step""")
def _(spark, sf_dir):
    return validate_workflows(*_workflows(spark, sf_dir), builtin_registry())


@query("workflow_cycles", f"""WITH RECURSIVE {_STEPS_SQL},
  {_BACK_SQL},
  circles AS (SELECT a.workflow, a.step, min(a.dep) AS cycle FROM back a JOIN back b
    ON a.workflow = b.workflow AND a.step = b.dep AND a.dep = b.step GROUP BY 1, 2),
  stuck AS (SELECT DISTINCT b.workflow, b.step FROM back b JOIN circles c ON b.workflow = c.workflow AND b.dep = c.step)
  SELECT workflow, step, cycle FROM stuck LEFT JOIN circles USING (workflow, step)""")
def _(spark, sf_dir):
    return workflow_cycles(*_workflows(spark, sf_dir))


@query("run_workflow", f"""SELECT * FROM (WITH {_EMPTY_SQL} SELECT 'clean' AS step, 'remove' AS action, count(*) AS items FROM empties)
  UNION ALL SELECT * FROM ({_GROUPS_SQL} SELECT 'dedup' AS step, CASE WHEN keep THEN 'keep' ELSE 'remove' END AS action, count(*) AS items FROM members GROUP BY 2)
  UNION ALL SELECT 'collect', 'copy', count(*) FROM documents""")
def _(spark, sf_dir):
    spec = {
        "variables": {"dest": "/dest", "alg": "sha256"},
        "steps": [
            {"id": "collect", "type": "consolidation", "inputs": ["files"], "depends_on": ["dedup"],
             "config": {"dest": "${dest}", "strategy": "type"}},
            {"id": "clean", "type": "cleanup", "inputs": ["tree"]},
            {"id": "dedup", "type": "deduplication", "inputs": ["files"], "depends_on": ["clean"],
             "config": {"algorithm": "${alg}"}, "condition": "count(*) > 0"},
            {"id": "never", "type": "cleanup", "inputs": ["clean"], "condition": "count_if(status = 'skipped') > 0"},
            {"id": "after", "type": "cleanup", "inputs": ["tree"], "depends_on": ["never"]},
        ],
    }
    outputs, _ = run_workflow(
        builtin_registry(), spec, {"tree": data.tree(spark, sf_dir), "files": files(spark, sf_dir)}
    )
    counts = [
        plan.groupBy("action").agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("step"), "action", "items")
        for name, plan in outputs.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


# ---- results of operations: one per order line, with the files it touched


def _results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    both = skew_join(table(spark, sf_dir, "lineitem"), orders, ["l_orderkey"], "inner", ["l_partkey", "l_linenumber"])
    path = F.concat(F.lit("/p"), "l_partkey", F.lit("/l"), "l_linenumber")
    error = F.struct(
        path.alias("file"), F.lit("cleanup").alias("operation"), F.concat(F.lit("failed \""), "l_linestatus", F.lit("\"")).alias("error"),
        F.col("l_shipdate").alias("timestamp"), F.lit(False).alias("recoverable"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "paused").otherwise("completed")
    given = {
        "id": F.concat(F.lit("cleanup-"), "l_orderkey"), "operation_type": F.lit("cleanup"), "status": status,
        "start_time": F.col("o_orderdate"), "end_time": F.col("l_shipdate"),
        "duration": labels.elapsed_micros("o_orderdate", "l_shipdate") * 1000,
        "items_processed": F.lit(2), "bytes_processed": F.lit(0),
        "files_affected": F.array(path, F.concat(path, F.lit(".bak"))), "summary": F.col("o_orderpriority"),
        "details": F.create_map(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("dry_run"), F.lit("false")),
        "errors": F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", error))),
        "warnings": F.array().cast("array<string>"),
    }
    return both.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in OPERATION_RESULT.fields])


_LINES_SQL = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_LINE_PATH_SQL = "'/p' || l_partkey || '/l' || l_linenumber"


@query("list_results", f"""SELECT 'cleanup-' || l_orderkey AS id, o_orderpriority AS summary,
    (epoch_us(l_shipdate) - epoch_us(o_orderdate)) * 1000 AS duration FROM {_LINES_SQL}
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def _(spark, sf_dir):
    found = tables.list_results(_results(spark, sf_dir), {"status": "failed", "summary": "1-URGENT"})
    return found.select("id", "summary", "duration")


@query("explode_errors", f"""SELECT 'cleanup-' || l_orderkey AS id, {_LINE_PATH_SQL} AS file, 'failed "' || l_linestatus || '"' AS error,
  epoch_us(l_shipdate) AS us FROM {_LINES_SQL} WHERE l_returnflag = 'R'""")
def _(spark, sf_dir):
    errors = tables.explode_errors(_results(spark, sf_dir))
    return errors.select("id", "file", "error", F.unix_micros("timestamp").alias("us"))


@query("explode_files", f"""SELECT 'cleanup-' || l_orderkey AS id, {_LINE_PATH_SQL} || suffix AS path
  FROM {_LINES_SQL}, (VALUES (''), ('.bak')) v(suffix)""")
def _(spark, sf_dir):
    return tables.explode_files(_results(spark, sf_dir))


@query("explode_details", f"""SELECT 'cleanup-' || l_orderkey AS id, key, CASE key WHEN 'dry_run' THEN 'false' ELSE o_custkey::VARCHAR END AS value
  FROM {_LINES_SQL}, (VALUES ('customer'), ('dry_run')) k(key)""")
def _(spark, sf_dir):
    return tables.explode_details(_results(spark, sf_dir))


def _round_trip(fmt):
    def run(spark, sf_dir):
        folder = scratch(spark, f"results-{fmt}")
        flat = files(spark, sf_dir).select("path", "size", "is_dir", "content")
        tables.write_results(flat, folder, fmt)
        back = tables.read_results(spark, folder, flat.schema, fmt)
        return back.select("path", "size", "is_dir", F.sha2("content", 256).alias("hash"))

    return run


for _fmt in ("parquet", "orc", "json", "csv"):
    query(f"results_{_fmt}", f"WITH {FILES_SQL} SELECT path, size, false AS is_dir, sha256(content) AS hash FROM inv")(_round_trip(_fmt))


def _written(spark, sf_dir):
    """The documents as text files below lang=/source= folders."""
    folder = scratch(spark, "texts")
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    docs.write.partitionBy("lang", "source").text(folder)
    return folder


@query("scan_content", """SELECT lang, source, sum(strlen(text) + 1)::BIGINT AS bytes, sum(strlen(text) + 1)::BIGINT AS read
  FROM documents GROUP BY 1, 2""")
def _(spark, sf_dir):
    found = listing.scan_content(spark, _written(spark, sf_dir), "*.txt")
    return found.groupBy(
        F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), F.regexp_extract("path", "source=([^/]*)", 1).alias("source")
    ).agg(F.sum("size").alias("bytes"), F.sum(F.octet_length("content")).alias("read"))


@query("scan_tree", """SELECT lang, source, is_dir, bytes FROM (
    SELECT '' AS lang, '' AS source, true AS is_dir, NULL::BIGINT AS bytes
    UNION ALL SELECT DISTINCT lang, '', true, NULL FROM documents UNION ALL SELECT DISTINCT lang, source, true, NULL FROM documents
    UNION ALL SELECT lang, source, false, sum(strlen(text) + 1) FROM documents GROUP BY 1, 2)""")
def _(spark, sf_dir):
    found = listing.scan_tree(spark, [mounted(_written(spark, sf_dir))])
    # checksum and success files of the writer are hidden or marked by '_'
    seen = found.filter(~F.col("name").rlike("^[._]"))
    return seen.groupBy(
        F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"),
        F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "is_dir",
    ).agg(F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("bytes"))


@query("hash_files", """SELECT lang, source, sum(strlen(text) + 1)::BIGINT AS bytes, true AS hashed FROM documents GROUP BY 1, 2""")
def _(spark, sf_dir):
    folder = _written(spark, sf_dir)
    inv = listing.scan_tree(spark, [mounted(folder)]).filter("NOT is_dir AND name LIKE '%.txt'")
    hashed = listing.hash_files(inv.select("path", "size"), "sha256", chunk_size=4096)
    # every file read in chunks has the digest of its whole content
    content = listing.scan_content(spark, folder, "*.txt").select(
        "path", F.sha2("content", 256).alias("whole")
    )
    return hashed.join(content, "path").groupBy(
        F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), F.regexp_extract("path", "source=([^/]*)", 1).alias("source")
    ).agg(F.sum("size").alias("bytes"), F.bool_and(F.col("hash") == F.col("whole")).alias("hashed"))


def _odd_files(spark, sf_dir):
    """Every document as a file of a folder that all executors share; a third of the names is hidden."""
    folder = mounted(scratch(spark, "odd"))

    def write(batches):
        for rows in batches:
            for name, text in zip(rows["name"], rows["text"]):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as file:
                    file.write(text.encode())
            yield rows[["name"]]

    names = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("f"), "doc_id")).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit(".env"), "doc_id")).otherwise(F.concat(F.lit("_build/x"), "doc_id"))
    docs = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), names).alias("name"), "text")
    docs.mapInPandas(write, "name string").count()
    return folder


@query("read_files", """SELECT lang || '/' || source || '/' || CASE doc_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN '.env' ELSE '_build/x' END || doc_id AS name,
    strlen(text) AS size, greatest(1, ceil(strlen(text) / 1000))::BIGINT AS chunks, sha256(text) AS hash FROM documents""")
def _(spark, sf_dir):
    folder = _odd_files(spark, sf_dir)
    chunks = read_files(spark, [folder], chunk_bytes=1000)
    found = whole_digests(chunks, "sha256")
    return found.select(F.expr(f"substring(path, {len(folder) + 2})").alias("name"), "size", "chunks", "hash")


@query("read_files_filtered", """SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents
  WHERE doc_id % 3 = 1 AND strlen(text) > 2000""")
def _(spark, sf_dir):
    chunks = read_files(spark, [_odd_files(spark, sf_dir)], chunk_bytes=4096)
    some = chunks.filter(F.col("name").startswith(".env") & (F.col("size") > 2000))
    return some.agg(F.count_if(F.col("chunk") == 0).alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


class _NameParts:
    """A plug-in: the parts of a file's name, one row each."""

    name, version, schema = "name_parts", "1", "path string, part string, place int, bytes bigint"

    def validate(self, least=1):
        if least < 1:
            raise ValueError("least has to be 1 or more")

    def rows(self, row, least=1):
        parts = [p for p in row["path"].strip("/").replace(".", "/").split("/") if len(p) >= least]
        for i, part in enumerate(parts):
            yield row["path"], part, i, row["size"]


@query("plugin_in_sql", f"""WITH {FILES_SQL} SELECT part, count(*) AS files, sum(size)::BIGINT AS bytes FROM (
    SELECT size, unnest(list_filter(string_split(replace(path[2:], '.', '/'), '/'), lambda p: length(p) >= 2)) AS part FROM inv) GROUP BY part""")
def _(spark, sf_dir):
    expose(spark, _NameParts(), least=2)
    files(spark, sf_dir).select("path", "size").createOrReplaceTempView("plugin_files")
    return spark.sql("SELECT part, count(*) AS files, sum(bytes) AS bytes FROM name_parts(TABLE(plugin_files)) GROUP BY part")
