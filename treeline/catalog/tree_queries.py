"""Queries on the directory tree: emptiness, cleanup, scopes, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.catalog.data import BASE_SQL, CLEANUP_OK_SQL, PARENT_SQL, TREE_SQL, query, table, tree
from treeline.functions import rules
from treeline.operators import report
from treeline.operators import tree as dirs
from treeline.sources import tables

_W = f"WITH {TREE_SQL} "
_EMPTY_SQL = f"""{TREE_SQL}, used AS (SELECT DISTINCT {PARENT_SQL} AS path FROM tree),
empties AS (SELECT path FROM tree WHERE is_dir AND path NOT IN (SELECT path FROM used) AND {CLEANUP_OK_SQL})"""
_ALL_FILES_SQL = f"""{TREE_SQL}, holders AS (SELECT DISTINCT {PARENT_SQL} AS path FROM tree WHERE NOT is_dir),
used AS (SELECT t.path FROM tree t WHERE is_dir AND EXISTS (
  SELECT 1 FROM holders h WHERE h.path = t.path OR starts_with(h.path, t.path || '/')))"""


@query("cleanup_empty_dirs", f"WITH {_EMPTY_SQL} SELECT path FROM empties")
def _(spark, sf_dir):
    return dirs.empty_dirs(tree(spark, sf_dir), rules.cleanup_allows("path")).select("path")


@query("cleanup_empty_trees", f"""WITH {_ALL_FILES_SQL} SELECT path FROM tree
  WHERE is_dir AND path NOT IN (SELECT path FROM used) AND {CLEANUP_OK_SQL}""")
def _(spark, sf_dir):
    return dirs.empty_trees(tree(spark, sf_dir), rules.cleanup_allows("path")).select("path")


def _unreadable(spark, sf_dir):
    """Folders of src3 could not be listed: their children are unknown."""
    inv = tree(spark, sf_dir)
    hidden = F.contains("path", F.lit("/src3/"))
    seen = inv.filter(~hidden | F.col("is_dir"))
    return seen.withColumn("error", F.when(hidden, F.lit("permission denied")))


_UNREADABLE_SQL = f"""{TREE_SQL}, seen AS (SELECT * FROM tree WHERE NOT contains(path, '/src3/') OR is_dir),
known AS (SELECT DISTINCT {PARENT_SQL} AS path FROM seen UNION SELECT path FROM seen WHERE contains(path, '/src3/')),
held AS (SELECT DISTINCT {PARENT_SQL} AS path FROM seen WHERE NOT is_dir UNION SELECT path FROM seen WHERE contains(path, '/src3/'))"""


@query("cleanup_unreadable", f"""WITH {_UNREADABLE_SQL} SELECT path, 'level' AS kind FROM seen
    WHERE is_dir AND path NOT IN (SELECT path FROM known) AND {CLEANUP_OK_SQL}
  UNION ALL SELECT path, 'tree' FROM seen s WHERE is_dir AND {CLEANUP_OK_SQL}
    AND NOT EXISTS (SELECT 1 FROM held h WHERE h.path = s.path OR starts_with(h.path, s.path || '/'))""")
def _(spark, sf_dir):
    inv = _unreadable(spark, sf_dir)
    one = dirs.plan_cleanup(inv).select(F.col("source_path").alias("path"), F.lit("level").alias("kind"))
    return one.unionByName(dirs.plan_cleanup(inv, cascade=True).select(F.col("source_path").alias("path"), F.lit("tree").alias("kind")))


def _failures(inv):
    """Removals below src7 fail."""
    return inv.filter(F.contains("path", F.lit("/src7/")) & F.col("is_dir")).select(
        "path", F.lit("permission denied").alias("error")
    )


_PLAN_SQL = f"""{_EMPTY_SQL}, plan AS (SELECT path AS source_path, 'remove' AS action,
  CASE WHEN contains(path, '/src7/') THEN 'skipped' ELSE 'removed' END AS status,
  CASE WHEN contains(path, '/src7/') THEN 'failed to remove directory ' || path || ': permission denied'
    ELSE 'empty directory' END AS reason FROM empties)"""


def _plan(spark, sf_dir):
    inv = tree(spark, sf_dir)
    return dirs.plan_cleanup(inv, failed=_failures(inv))


@query("cleanup_plan", f"WITH {_PLAN_SQL} SELECT source_path, action, status, reason FROM plan")
def _(spark, sf_dir):
    return _plan(spark, sf_dir).select("source_path", "action", "status", "reason")


@query("cleanup_summary", f"""WITH {_PLAN_SQL} SELECT removed, skipped,
  'Cleanup completed: ' || removed || ' directories removed, ' || skipped || ' skipped' AS summary
  FROM (SELECT count(*) FILTER (WHERE status = 'removed') AS removed,
    count(*) FILTER (WHERE status = 'skipped') AS skipped FROM plan)""")
def _(spark, sf_dir):
    return report.cleanup_summary(_plan(spark, sf_dir))


@query("cleanup_dry_run", f"""WITH {_EMPTY_SQL} SELECT count(*) AS removed, 0::BIGINT AS skipped,
  'Cleanup (dry run): ' || count(*) || ' directories would be removed, 0 skipped' AS summary FROM empties""")
def _(spark, sf_dir):
    return report.cleanup_summary(dirs.plan_cleanup(tree(spark, sf_dir), dry_run=True), dry_run=True)


@query("plan_counts", f"""WITH {_PLAN_SQL} SELECT action, status, count(*) AS items, 0::BIGINT AS bytes
  FROM plan GROUP BY action, status""")
def _(spark, sf_dir):
    return report.plan_counts(_plan(spark, sf_dir))


@query("cleanup_preview", f"""WITH {_EMPTY_SQL} SELECT path, greatest((SELECT count(*) FROM empties) - 20, 0) AS more
  FROM empties ORDER BY path LIMIT 20""")
def _(spark, sf_dir):
    found = dirs.empty_dirs(tree(spark, sf_dir), rules.cleanup_allows("path")).select("path")
    return report.preview(found, report.PREVIEW_ROWS["changed"])


@query("cleanup_rules", _W + f"""SELECT path FROM tree WHERE is_dir
  AND NOT (regexp_matches({BASE_SQL}, '^d.*7$') OR contains(lower(path), '/src1')
    OR {BASE_SQL} IN ('.git', '.svn', '.hg', 'node_modules', '__pycache__', '.DS_Store')
    OR ({BASE_SQL} LIKE '.%' AND NOT {BASE_SQL} LIKE '.d2%'))""")
def _(spark, sf_dir):
    keep = rules.cleanup_allows("path", ("d*7", "/SRC1"), (".d2*",))
    return tree(spark, sf_dir).filter(F.col("is_dir") & keep).select("path")


@query("count_dirs", _W + f"""SELECT count(*) FILTER (WHERE is_dir AND {CLEANUP_OK_SQL}) AS total_directories,
  count(*) AS items_scanned FROM tree""")
def _(spark, sf_dir):
    return dirs.count_dirs(tree(spark, sf_dir))


@query("dir_children", _W + f"""SELECT CASE WHEN parent = '' THEN '/' ELSE parent END AS parent, count(*) AS children,
  count(*) FILTER (WHERE is_dir) AS child_dirs, sum(size)::BIGINT AS child_bytes
  FROM (SELECT *, {PARENT_SQL} AS parent FROM tree) GROUP BY 1""")
def _(spark, sf_dir):
    return dirs.dir_children(tree(spark, sf_dir))


@query("hidden_entries", _W + f"SELECT path, is_dir FROM tree WHERE {BASE_SQL} LIKE '.%'")
def _(spark, sf_dir):
    return tree(spark, sf_dir).filter(rules.is_hidden("path")).select("path", "is_dir")


@query("scoped_paths", _W + """SELECT path FROM tree WHERE (path = '/data/en' OR starts_with(path, '/data/en/'))
  AND length(path) - length(replace(path, '/', '')) <= 4""")
def _(spark, sf_dir):
    inside = tables.under_roots(tree(spark, sf_dir), ["/data/en"])
    return inside.filter(rules.within_depth("path", F.lit("/data/en"), 2)).select("path")


@query("scan_roots", _W + """SELECT path, size FROM tree
  WHERE path = '/data/de' OR starts_with(path, '/data/de/') OR path = '/data/fr/src1' OR starts_with(path, '/data/fr/src1/')""")
def _(spark, sf_dir):
    roots = ["/data/de", "/data/de/src3", "/data/fr/src1"]
    return tables.under_roots(tree(spark, sf_dir), roots).select("path", "size")


@query("union_roots", _W + """SELECT path FROM tree WHERE starts_with(path, '/data/es/') OR path = '/data/es'
  OR starts_with(path, '/data/en/') OR path = '/data/en'""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir)
    scans = [tables.under_roots(inv, [r]) for r in ("/data/es", "/data/es/src2", "/data/en")]
    return tables.union_roots(scans).select("path")


def _toxic_roots(spark, sf_dir):
    """Source folders that hold a document labelled toxic, and the language of each."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    return docs.select(F.concat(F.lit("/data/"), "lang", F.lit("/"), "source").alias("path")).distinct()


@query("subtree", _W + """SELECT path, is_dir FROM tree WHERE regexp_extract(path, '^/data/[^/]*/[^/]*') IN (
  SELECT '/data/' || lang || '/' || source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def _(spark, sf_dir):
    return tables.under_roots(tree(spark, sf_dir), _toxic_roots(spark, sf_dir)).select("path", "is_dir")


_REQUESTS_SQL = """requests AS (SELECT doc_id, '/data/' || lang || '/' || source || '/b' || (doc_id % 8) || '/d' || doc_id
  AS path FROM documents)"""


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/b"),
                 (F.col("doc_id") % 8).cast("string"), F.lit("/d"), "doc_id").alias("path"),
    )


@query("lookup", f"""WITH {TREE_SQL}, {_REQUESTS_SQL} SELECT r.doc_id, r.path, t.is_dir, t.mode, t.path IS NOT NULL AS found
  FROM requests r LEFT JOIN tree t ON r.path = t.path""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir).select("path", "is_dir", "mode")
    return tables.lookup(inv, _requests(spark, sf_dir)).select("doc_id", "path", "is_dir", "mode", "found")


@query("missing_paths", f"""WITH {TREE_SQL}, {_REQUESTS_SQL} SELECT path, 'path does not exist: ' || path AS error
  FROM requests WHERE path NOT IN (SELECT path FROM tree)""")
def _(spark, sf_dir):
    return tables.missing_paths(_requests(spark, sf_dir), tree(spark, sf_dir)).select("path", "error")


@query("existing_paths", f"""WITH {TREE_SQL}, {_REQUESTS_SQL} SELECT path FROM requests
  WHERE path IN (SELECT path FROM tree)""")
def _(spark, sf_dir):
    return tables.existing_paths(_requests(spark, sf_dir), tree(spark, sf_dir)).select("path")


@query("upsert_inventory", _W + """, incoming AS (SELECT path, size + 1 AS size,
    mod_us + CASE WHEN size % 2 = 0 THEN 0 ELSE -3600000000 END AS mod_us FROM tree WHERE starts_with(path, '/data/en/')
  UNION ALL SELECT '/new' || path, size, mod_us FROM tree WHERE NOT is_dir)
  SELECT path, size, mod_us FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mod_us DESC, turn DESC) AS rn
    FROM (SELECT path, size, mod_us, 0 AS turn FROM tree UNION ALL SELECT path, size, mod_us, 1 FROM incoming))
  WHERE rn = 1""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir).select("path", "size", "mod_time")
    late = F.when(F.col("size") % 2 == 0, F.col("mod_time")).otherwise(F.col("mod_time") - F.expr("INTERVAL 1 HOUR"))
    incoming = (
        inv.filter(F.startswith("path", F.lit("/data/en/"))).select("path", (F.col("size") + 1).alias("size"), late.alias("mod_time"))
    ).unionByName(
        tree(spark, sf_dir).filter("NOT is_dir").select(F.concat(F.lit("/new"), "path").alias("path"), "size", "mod_time")
    )
    merged = tables.upsert_inventory(inv, incoming)
    return merged.select("path", "size", F.unix_micros("mod_time").alias("mod_us"))
