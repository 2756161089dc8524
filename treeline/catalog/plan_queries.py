"""Queries that plan ownership, consolidation and organisation, and apply plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.catalog.data import (CATEGORY_SQL, CLEANUP_OK_SQL, DAY_ZERO, FILES_SQL, PARENT_SQL, TREE_SQL, files, query,
                                   table, tree)
from treeline.catalog.tree_queries import _EMPTY_SQL, _ALL_FILES_SQL
from treeline.functions import paths, rules
from treeline.operators import arrange, conflicts, ownership, report, snapshot
from treeline.operators import tree as dirs

# ---- ownership

_OWN_REQUESTS_SQL = """requests AS (SELECT c_custkey AS request_id,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE printf('Supplier#%09d', c_custkey // 12) END AS usr,
  CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'NATION_' || (c_nationkey + 2) ELSE '' END AS grp FROM customer),
resolved AS (SELECT request_id, CASE WHEN usr = '' THEN 'admin' ELSE usr END AS "user", usr, s_suppkey AS su, s_nationkey AS sg, grp,
  n_nationkey AS ng, CASE WHEN usr <> '' AND s_suppkey IS NULL THEN 'user not found: ' || usr
    WHEN usr <> '' AND grp <> '' AND n_nationkey IS NULL THEN 'group not found: ' || grp END AS error
  FROM requests LEFT JOIN supplier ON s_name = usr LEFT JOIN nation ON n_name = grp)"""


@query("resolve_principals", f"""WITH {_OWN_REQUESTS_SQL} SELECT request_id, "user",
  (CASE WHEN usr = '' THEN 1000 WHEN error IS NULL THEN su END)::BIGINT AS uid,
  (CASE WHEN usr = '' THEN 1001 WHEN error IS NULL THEN CASE WHEN grp <> '' THEN ng ELSE sg END END)::BIGINT AS gid,
  error FROM resolved""")
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    requests = customer.select(
        F.col("c_custkey").alias("request_id"),
        F.when(segment == "MACHINERY", "").otherwise(
            F.format_string("Supplier#%09d", (F.col("c_custkey") / 12).cast("bigint"))).alias("user"),
        F.when(segment.isin("HOUSEHOLD", "MACHINERY"), F.concat(F.lit("NATION_"), F.col("c_nationkey") + 2))
        .otherwise("").alias("group"),
    )
    users = table(spark, sf_dir, "supplier").selectExpr("s_name AS user", "s_suppkey AS uid", "s_nationkey AS gid")
    groups = table(spark, sf_dir, "nation").selectExpr("n_name AS `group`", "n_nationkey AS gid")
    return ownership.resolve_principals(requests, users, groups, ("admin", 1000, 1001))


_IN_SCOPE_SQL = """((path = '/data/en' OR starts_with(path, '/data/en/') OR path = '/data/fr' OR starts_with(path, '/data/fr/'))
  AND NOT regexp_matches(path, '^/data/[^/]*/src1/[^/]*$'))"""


def _ownership(spark, sf_dir):
    inv = tree(spark, sf_dir)
    failed = inv.filter(F.endswith("path", F.lit(".pdf"))).select("path", F.lit("operation not permitted").alias("error"))
    return ownership.plan_ownership(
        inv, ["/data/en", "/data/fr"], 1000, 1001, (".git", "/data/*/src1/*"), failed=failed
    )


@query("ownership_plan", f"""WITH {TREE_SQL} SELECT path AS source_path, 'chown' AS action,
  CASE WHEN path LIKE '%.pdf' THEN 'skipped' ELSE 'changed' END AS status,
  CASE WHEN path LIKE '%.pdf' THEN 'operation not permitted' ELSE 'in scope' END AS reason,
  1000::BIGINT AS uid, 1001::BIGINT AS gid FROM tree WHERE {_IN_SCOPE_SQL}""")
def _(spark, sf_dir):
    return _ownership(spark, sf_dir).select("source_path", "action", "status", "reason", "uid", "gid")


@query("ownership_roots", f"""WITH {TREE_SQL} SELECT path AS source_path FROM tree
  WHERE path = '/data/en' OR starts_with(path, '/data/en/') OR path = '/data/fr/src1' OR starts_with(path, '/data/fr/src1/')""")
def _(spark, sf_dir):
    return ownership.plan_ownership(tree(spark, sf_dir), ["/data/en/", "/data/fr/src1//", "/data/en/src2"], 1, 2).select("source_path")


@query("ownership_summary", f"""WITH {TREE_SQL}, c AS (SELECT count(*) FILTER (WHERE path NOT LIKE '%.pdf') AS changed,
  count(*) FILTER (WHERE path LIKE '%.pdf') AS skipped FROM tree WHERE {_IN_SCOPE_SQL})
  SELECT changed, skipped, skipped AS errors, 'Ownership change (completed): ' || changed || ' items changed, '
    || skipped || ' skipped, ' || skipped || ' errors' AS summary FROM c""")
def _(spark, sf_dir):
    return report.ownership_summary(_ownership(spark, sf_dir))


@query("ownership_flat", f"""WITH {TREE_SQL} SELECT path AS source_path FROM tree
  WHERE regexp_matches(path, '^/data/en(/[^/]*)?$')""")
def _(spark, sf_dir):
    plan = ownership.plan_ownership(tree(spark, sf_dir), ["/data/en"], 1, 1, recursive=False, dry_run=True)
    return plan.select("source_path")


@query("ownership_changes", f"""WITH {TREE_SQL} SELECT path AS source_path FROM tree
  WHERE {_IN_SCOPE_SQL} AND size % 3 <> 1""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir).withColumn("uid", F.col("size") % 3).withColumn("gid", F.lit(7).cast("bigint"))
    plan = ownership.plan_ownership(
        inv, ["/data/en", "/data/fr"], 1, 7, ("/data/*/src1/*",), only_changes=True, dry_run=True
    )
    return plan.select("source_path")


@query("snapshot_chown", f"""WITH {TREE_SQL} SELECT path,
  (CASE WHEN {_IN_SCOPE_SQL} AND path NOT LIKE '%.pdf' THEN 1000 ELSE 0 END)::BIGINT AS uid,
  (CASE WHEN {_IN_SCOPE_SQL} AND path NOT LIKE '%.pdf' THEN 1001 END)::BIGINT AS gid FROM tree""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir).withColumn("uid", F.lit(0).cast("bigint"))
    return snapshot.apply_ownership(inv, _ownership(spark, sf_dir)).select("path", "uid", "gid")


# ---- consolidation and conflicts; names repeat so that targets collide

_CONS_SQL = f"""{FILES_SQL}, src AS (SELECT '/data/' || doc_id // 100 || '/f' || (doc_id % 100) || ext AS path, size, mod_us, ext FROM inv),
there AS (SELECT '/dest/' || {CATEGORY_SQL} || '/f' || (doc_id % 100) || ext AS path FROM inv JOIN labels USING (doc_id) WHERE quality = 0)"""


def _sources(spark, sf_dir):
    """All documents under names that repeat every hundred."""
    name = F.concat(F.lit("/data/"), (F.col("doc_id") / 100).cast("bigint"), F.lit("/f"),
                    F.col("doc_id") % 100, paths.extension("path"))
    return files(spark, sf_dir).withColumn("path", name).drop("content")


def _there(spark, sf_dir):
    """What is in the destination: one file per document of quality 0."""
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    found = files(spark, sf_dir).join(low, "doc_id")
    named = F.concat(F.lit("/x/f"), F.col("doc_id") % 100, paths.extension("path"))
    renamed = found.withColumn("path", named)
    return renamed.select(arrange.target_path("/dest", "type").alias("path")).distinct()


def _consolidated_sql(target, status, new="target", action="copy", sources="src"):
    return f"""WITH {_CONS_SQL}, plan AS (SELECT path AS source, {target} AS target, mod_us, size FROM {sources}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY target) AS sharers,
  row_number() OVER (PARTITION BY target ORDER BY mod_us, source) AS first_rank,
  row_number() OVER (PARTITION BY target ORDER BY mod_us DESC, source DESC) AS last_rank,
  row_number() OVER (PARTITION BY target ORDER BY source) AS turn,
  target IN (SELECT path FROM there) AS taken FROM plan),
done AS (SELECT *, {status} AS status, {new} AS new_path FROM ranked) SELECT source AS source_path,
  new_path AS target_path, '{action}' AS action, status, size FROM done"""


_TYPE_TARGET_SQL = f"'/dest/' || {CATEGORY_SQL} || '/' || regexp_extract(path, '([^/]*)$', 1)"
_SKIP_SQL = "CASE WHEN taken OR first_rank > 1 THEN 'skipped' ELSE 'planned' END"
_OVERWRITE_SQL = "CASE WHEN last_rank > 1 THEN 'skipped' WHEN taken OR sharers > 1 THEN 'overwrite' ELSE 'planned' END"
_NUMBER_SQL = "(turn - 1 + CASE WHEN taken THEN 1 ELSE 0 END)"
_RENAMED_SQL = f"""CASE WHEN {_NUMBER_SQL} = 0 THEN target
  ELSE regexp_replace(target, '\\.[^./]*$', '') || '_' || {_NUMBER_SQL} || regexp_extract(target, '(\\.[^./]*)$', 1) END"""
_RENAME_SQL = f"CASE WHEN {_NUMBER_SQL} > 0 THEN 'renamed' ELSE 'planned' END"
_COLUMNS = ("source_path", "target_path", "action", "status", "size")


def _consolidate(spark, sf_dir, **settings):
    return arrange.plan_consolidation(_sources(spark, sf_dir), _there(spark, sf_dir), "/dest", **settings)


@query("consolidate_type", _consolidated_sql(_TYPE_TARGET_SQL, _SKIP_SQL))
def _(spark, sf_dir):
    return _consolidate(spark, sf_dir, strategy="type", conflict="skip").select(*_COLUMNS)


@query("consolidate_overwrite", _consolidated_sql(_TYPE_TARGET_SQL, _OVERWRITE_SQL))
def _(spark, sf_dir):
    return _consolidate(spark, sf_dir, strategy="type", conflict="overwrite").select(*_COLUMNS)


@query("rename_plan", _consolidated_sql(_TYPE_TARGET_SQL, _RENAME_SQL, _RENAMED_SQL))
def _(spark, sf_dir):
    return _consolidate(spark, sf_dir, strategy="type", conflict="rename").select(*_COLUMNS)


@query("rename_in_place", f"""WITH {FILES_SQL}, plan AS (SELECT path AS source_path, '/data/en/src0/all' || ext AS target_path FROM inv
    UNION ALL SELECT DISTINCT '/data/en/src0/all' || ext, '/data/en/src0/all' || ext FROM inv WHERE doc_id % 2 = 0),
  held AS (SELECT '/data/en/src0/all_' || n || ext AS path, ext, n FROM (SELECT DISTINCT ext FROM inv), (VALUES (2), (3), (7)) t(n)),
  free AS (SELECT ext, n, row_number() OVER (PARTITION BY ext ORDER BY n) AS turn
    FROM (SELECT DISTINCT ext FROM inv), (SELECT unnest(range(1, (SELECT count(*) + 10 FROM inv))) AS n)
    WHERE (ext, n) NOT IN (SELECT (ext, n) FROM held)),
  turns AS (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY source_path) - 1
      + (target_path IN (SELECT source_path FROM plan WHERE source_path = target_path))::INT AS turn
    FROM plan WHERE source_path <> target_path)
  SELECT t.source_path, CASE WHEN t.turn = 0 THEN target_path ELSE '/data/en/src0/all_' || f.n || f.ext END AS new_path,
    CASE WHEN t.turn = 0 THEN 'planned' ELSE 'renamed' END AS status
  FROM turns t LEFT JOIN free f ON f.turn = t.turn AND ends_with(t.target_path, 'all' || f.ext)
  UNION ALL SELECT source_path, target_path, 'planned' FROM plan WHERE source_path = target_path""")
def _(spark, sf_dir):
    # all files of one suffix go to one name; for some suffixes a file has that name already, and some numbers are taken
    inv = files(spark, sf_dir)
    ext = F.concat(F.lit("."), F.element_at(F.split("path", "[.]"), -1))
    target = F.concat(F.lit("/data/en/src0/all"), ext)
    plan = inv.select(F.col("path").alias("source_path"), target.alias("target_path"), "mod_time", "size")
    there = inv.filter("doc_id % 2 = 0").select(target.alias("source_path"), target.alias("target_path")).distinct()
    whole = plan.unionByName(there, allowMissingColumns=True)
    numbers = F.explode(F.array(F.lit("2"), F.lit("3"), F.lit("7")))
    held = inv.select(ext.alias("ext")).distinct().select("ext", numbers.alias("n")).select(
        F.concat(F.lit("/data/en/src0/all_"), "n", "ext").alias("path"))
    return conflicts.rename_on_conflict(whole, held).select("source_path", "new_path", "status")


@query("consolidate_date", _consolidated_sql(
    "'/dest/' || strftime(make_timestamp(mod_us), '%Y/%m/%d') || '/' || regexp_extract(path, '([^/]*)$', 1)",
    _SKIP_SQL, action="move"))
def _(spark, sf_dir):
    return _consolidate(spark, sf_dir, strategy="date", move=True).select(*_COLUMNS)


@query("consolidate_flat", _consolidated_sql("'/dest/' || regexp_extract(path, '([^/]*)$', 1)", _SKIP_SQL))
def _(spark, sf_dir):
    return _consolidate(spark, sf_dir, strategy="flat").select(*_COLUMNS)


@query("consolidate_pattern", _consolidated_sql(
    f"""'/dest/' || strftime(make_timestamp(mod_us), '%Y') || '-' || substr(ext, 2) || '/' || {CATEGORY_SQL} || '_'
  || regexp_extract(path, '([^/]*)$', 1)""", _SKIP_SQL))
def _(spark, sf_dir):
    return _consolidate(spark, sf_dir, strategy="pattern", pattern="{year}-{ext}/{category}_{name}").select(*_COLUMNS)


@query("consolidate_structure", _consolidated_sql(f"'/dest/' || {CATEGORY_SQL} || substr(path, 6)", _SKIP_SQL))
def _(spark, sf_dir):
    return _consolidate(spark, sf_dir, strategy="type", root="/data").select(*_COLUMNS)


@query("consolidation_totals", f"""SELECT count(*) AS total_files, sum(size)::BIGINT AS total_size
  FROM ({_consolidated_sql(_TYPE_TARGET_SQL, _SKIP_SQL)}) WHERE status <> 'skipped'""")
def _(spark, sf_dir):
    return arrange.consolidation_totals(_consolidate(spark, sf_dir, strategy="type"))


def _planned(spark, sf_dir):
    return _sources(spark, sf_dir).select(
        F.col("path").alias("source_path"), arrange.target_path("/dest", "type").alias("target_path"), "mod_time", "size"
    )


@query("conflict_report", f"""WITH {_CONS_SQL}, plan AS (SELECT path AS source_path, {_TYPE_TARGET_SQL} AS target_path FROM src)
  SELECT * FROM (SELECT source_path, target_path, count(*) OVER (PARTITION BY target_path) AS sharers,
    target_path IN (SELECT path FROM there) AS target_exists FROM plan) WHERE sharers > 1 OR target_exists""")
def _(spark, sf_dir):
    return conflicts.find_conflicts(_planned(spark, sf_dir), _there(spark, sf_dir))


@query("conflict_resolutions", f"""SELECT source_path, target, 'rename' AS resolution, target_path AS new_name
  FROM ({_consolidated_sql(_TYPE_TARGET_SQL, _RENAME_SQL, _RENAMED_SQL).replace("SELECT source AS source_path", "SELECT target, source AS source_path")})
  WHERE status <> 'planned'""")
def _(spark, sf_dir):
    resolved = conflicts.resolve_conflicts(_planned(spark, sf_dir), _there(spark, sf_dir), "rename")
    return conflicts.conflict_resolutions(resolved, "rename").withColumnRenamed("target_path", "target")


# ---- organisation

_SUGGEST_SQL = """SELECT source_path, suggested_path, reason, round(confidence, 6) AS confidence, category, tag,
  (count(*) OVER (PARTITION BY suggested_path) - 1 + CASE WHEN suggested_path <> source_path
    AND suggested_path IN (SELECT path FROM inv) THEN 1 ELSE 0 END)::BIGINT AS conflicts FROM s"""


def _suggested(df):
    return df.select(
        "source_path", "suggested_path", "reason", F.round("confidence", 6).alias("confidence"), "category",
        F.array_join("tags", "|").alias("tag"), "conflicts",
    )


def _organized(spark, sf_dir, inv, strategy, rules_table=None):
    return _suggested(arrange.suggest_organization(inv, "/home", strategy, rules_table))


_ORG_BASE_SQL = f"""{FILES_SQL.replace("'/f' || doc_id", "'/f' || (doc_id % 500)")}, org AS (SELECT *, {CATEGORY_SQL} AS category,
  regexp_extract(path, '([^/]*)$', 1) AS name FROM inv)"""


def _org_files(spark, sf_dir):
    """All documents; names repeat every five hundred, so some records share a path."""
    name = F.concat(paths.parent_of("path"), F.lit("/f"), F.col("doc_id") % 500, paths.extension("path"))
    return files(spark, sf_dir).drop("content").withColumn("path", name)


def _by(target, why, sure):
    return f"""WITH {_ORG_BASE_SQL}, s AS (SELECT path AS source_path, {target} AS suggested_path, {why} AS reason,
  {sure} AS confidence, category, category || '|' || substr(ext, 2) AS tag FROM org GROUP BY ALL) {_SUGGEST_SQL}"""


_KNOWN_SQL = "CASE WHEN category = 'other' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END"


def _distinct_org(spark, sf_dir):
    return _org_files(spark, sf_dir).groupBy("path", "is_dir").agg(F.min("mod_time").alias("mod_time"))


@query("organize_suggestions", _by("'/home/' || category || '/' || name", "'category ' || category", _KNOWN_SQL))
def _(spark, sf_dir):
    return _organized(spark, sf_dir, _distinct_org(spark, sf_dir), "type")


@query("organize_project", _by("'/home/data/' || name", "'project data'", "0.7::DOUBLE"))
def _(spark, sf_dir):
    return _organized(spark, sf_dir, _distinct_org(spark, sf_dir), "project")


@query("organize_date", f"""WITH {_ORG_BASE_SQL}, d AS (SELECT path, category, ext, name, min(mod_us) AS us FROM org GROUP BY ALL),
  s AS (SELECT path AS source_path, '/home/' || strftime(make_timestamp(us), '%Y/%m/%d') || '/' || name AS suggested_path,
  'modification date' AS reason, 0.9::DOUBLE AS confidence, category, category || '|' || substr(ext, 2) AS tag FROM d) {_SUGGEST_SQL}""")
def _(spark, sf_dir):
    return _organized(spark, sf_dir, _distinct_org(spark, sf_dir), "date")


_RULES_SQL = f"""folders AS (SELECT ext, {PARENT_SQL} AS folder, count(*) AS n FROM inv GROUP BY 1, 2),
learned AS (SELECT ext, folder, n AS support, n / sum(n) OVER (PARTITION BY ext) AS confidence,
  row_number() OVER (PARTITION BY ext ORDER BY n DESC, folder) AS rn FROM folders)"""


@query("learned_rules", f"""WITH {FILES_SQL}, {_RULES_SQL}
  SELECT ext, folder, support, round(confidence, 6) AS confidence FROM learned WHERE rn = 1""")
def _(spark, sf_dir):
    found = arrange.learned_rules(files(spark, sf_dir))
    return found.withColumn("confidence", F.round("confidence", 6))


@query("organize_smart", f"""WITH {_ORG_BASE_SQL}, {_RULES_SQL}, chosen AS (SELECT ext, folder, confidence FROM learned
    WHERE rn = 1 AND ext NOT IN ('.jpg', '.png')),
  s AS (SELECT path AS source_path, CASE WHEN folder IS NOT NULL THEN folder || '/' || name ELSE '/home/' || category || '/' || name END
    AS suggested_path, CASE WHEN folder IS NOT NULL THEN 'rule for ' || ext ELSE 'category ' || category END AS reason,
    coalesce(confidence, {_KNOWN_SQL}) AS confidence, category, category || '|' || substr(ext, 2) AS tag
    FROM org LEFT JOIN chosen USING (ext) GROUP BY ALL) {_SUGGEST_SQL}""")
def _(spark, sf_dir):
    learned = arrange.learned_rules(_org_files(spark, sf_dir)).filter(~F.col("ext").isin(".jpg", ".png"))
    return _organized(spark, sf_dir, _distinct_org(spark, sf_dir), "smart", learned)


# ---- applying plans

_NOW_US = (DAY_ZERO + 86400 * 400) * 1_000_000


def _now():
    return F.timestamp_seconds(F.lit(DAY_ZERO + 86400 * 400))


def _shown(inv):
    return inv.select("path", "name", "size", F.unix_micros("mod_time").alias("mod_us"), "is_dir", "mode")


_NAME_SQL = "regexp_extract(path, '([^/]*)$', 1) AS name"


@query("snapshot_remove", f"""WITH {_EMPTY_SQL} SELECT path, {_NAME_SQL}, size, mod_us, is_dir, mode FROM tree
  WHERE path NOT IN (SELECT path FROM empties)""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir)
    plan = dirs.plan_cleanup(inv)
    return _shown(snapshot.apply_plan(inv, plan, _now()))


@query("snapshot_remove_cascade", f"""WITH {_ALL_FILES_SQL}, planned AS (SELECT path FROM tree
    WHERE is_dir AND path NOT IN (SELECT path FROM used) AND {CLEANUP_OK_SQL}),
  rest AS (SELECT path FROM tree WHERE path NOT IN (SELECT path FROM planned))
  SELECT path, {_NAME_SQL}, size, mod_us, is_dir, mode FROM tree t WHERE path IN (SELECT path FROM rest)
    OR EXISTS (SELECT 1 FROM rest r WHERE starts_with(r.path, t.path || '/'))""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir)
    return _shown(snapshot.apply_plan(inv, dirs.plan_cleanup(inv, cascade=True), _now()))


@query("snapshot_copy_missing", f"""WITH {TREE_SQL} SELECT path, {_NAME_SQL}, size, mod_us, is_dir, mode FROM tree
  UNION ALL SELECT '/new/copy' || substr(path, 9), regexp_extract('/new/copy' || substr(path, 9), '([^/]*)$', 1), size, {_NOW_US}, is_dir, mode
    FROM tree WHERE path = '/data/en' OR starts_with(path, '/data/en/')
  UNION ALL SELECT * FROM (VALUES ('/', '/', 0, {_NOW_US}, true, {snapshot.DIR_MODE}), ('/new', 'new', 0, {_NOW_US}, true, {snapshot.DIR_MODE}))""")
def _(spark, sf_dir):
    # a source that is not there, and a copy below itself, make nothing
    inv = tree(spark, sf_dir)
    some = inv.filter("path = '/data/en'").select(F.col("path").alias("source"))
    copies = some.select("source", F.lit("/new/copy").alias("target")).unionByName(
        some.select(F.concat("source", F.lit("/nothing")).alias("source"), F.lit("/gone/deep/x").alias("target"))).unionByName(
        some.select("source", F.concat("source", F.lit("/inner/x")).alias("target")))
    return _shown(snapshot.apply_copy(inv, copies, _now()))


@query("snapshot_remove_tree", f"""WITH {_ALL_FILES_SQL} SELECT path, {_NAME_SQL}, size, mod_us, is_dir, mode FROM tree
  WHERE path IN (SELECT path FROM used) OR NOT is_dir""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir)
    return _shown(snapshot.apply_remove_tree(inv, dirs.empty_trees(inv).select("path")))


def _moves(spark, sf_dir):
    """Every source folder goes to an archive by source; src1 of every language goes to one place."""
    pairs = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    src = F.concat(F.lit("/data/"), "lang", F.lit("/"), "source")
    to = F.when(F.col("source") == "src1", F.lit("/archive/one")).otherwise(
        F.concat(F.lit("/archive/"), "source", F.lit("/"), "lang"))
    return pairs.select(src.alias("source"), to.alias("target"))


_MOVED_SQL = f"""{TREE_SQL}, parts AS (SELECT *, regexp_extract(path, '^/data/([^/]*)/([^/]*)', 1) AS l,
  regexp_extract(path, '^/data/([^/]*)/([^/]*)', 2) AS s FROM tree),
moved AS (SELECT CASE WHEN s = '' THEN path WHEN s = 'src1' THEN '/archive/one' || substr(path, length('/data/' || l || '/' || s) + 1)
  ELSE '/archive/' || s || '/' || l || substr(path, length('/data/' || l || '/' || s) + 1) END AS path,
  path AS old, size, mod_us, is_dir, mode FROM parts),
after AS (SELECT path, {_NAME_SQL}, size, mod_us, is_dir, mode FROM (SELECT *,
  row_number() OVER (PARTITION BY path ORDER BY mod_us DESC, old DESC) AS rn FROM moved) WHERE rn = 1)"""


@query("snapshot_move", f"WITH {_MOVED_SQL} SELECT * FROM after")
def _(spark, sf_dir):
    return _shown(snapshot.apply_move(tree(spark, sf_dir), _moves(spark, sf_dir)))


@query("snapshot_diff", f"""WITH {_MOVED_SQL} SELECT coalesce(a.path, t.path) AS path,
  CASE WHEN t.path IS NULL THEN 'added' ELSE 'removed' END AS change
  FROM after a FULL JOIN tree t ON a.path = t.path WHERE a.path IS NULL OR t.path IS NULL
  UNION ALL SELECT t.path, 'modified' FROM after a JOIN tree t ON a.path = t.path WHERE a.size <> t.size OR a.mod_us <> t.mod_us""")
def _(spark, sf_dir):
    inv = tree(spark, sf_dir)
    return snapshot.snapshot_diff(inv, snapshot.apply_move(inv, _moves(spark, sf_dir)))


@query("snapshot_copy", f"""WITH {TREE_SQL}, copied AS (SELECT '/backup/' || substr(path, 7) AS path, size, {_NOW_US} AS mod_us, is_dir, mode
    FROM tree WHERE path <> '/data'
  UNION ALL SELECT '/backup', 0, {_NOW_US}, true, {snapshot.DIR_MODE}
  UNION ALL SELECT '/', 0, {_NOW_US}, true, {snapshot.DIR_MODE})
  SELECT path, CASE WHEN path = '/' THEN '/' ELSE regexp_extract(path, '([^/]*)$', 1) END AS name, size, mod_us, is_dir, mode
  FROM (SELECT path, size, mod_us, is_dir, mode FROM tree UNION ALL SELECT * FROM copied)""")
def _(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    copies = langs.select(F.concat(F.lit("/data/"), "lang").alias("source"), F.concat(F.lit("/backup/"), "lang").alias("target"))
    return _shown(snapshot.apply_copy(tree(spark, sf_dir), copies, _now()))


@query("snapshot_mkdirs", f"""WITH {TREE_SQL}, wanted AS (SELECT '/dest/' || lang || '/' || source || '/new' AS path FROM documents
    UNION SELECT '/dest/' || lang || '/' || source FROM documents UNION SELECT '/dest/' || lang FROM documents
    UNION SELECT '/dest' UNION SELECT '/' UNION SELECT '/data/' || lang || '/' || source || '/extra' FROM documents)
  SELECT path, CASE WHEN path = '/' THEN '/' ELSE regexp_extract(path, '([^/]*)$', 1) END AS name, size, mod_us, is_dir, mode FROM (
    SELECT path, size, mod_us, is_dir, mode FROM tree UNION ALL SELECT path, 0, {_NOW_US}, true, {snapshot.DIR_MODE} FROM wanted)""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    place = F.concat("lang", F.lit("/"), "source")
    wanted = docs.select(F.concat(F.lit("/dest/"), place, F.lit("/new")).alias("path")).unionByName(
        docs.select(F.concat(F.lit("/data/"), place, F.lit("/extra")).alias("path")))
    return _shown(snapshot.apply_create_dirs(tree(spark, sf_dir), wanted, _now()))


@query("backup_manifest", f"""WITH {_EMPTY_SQL} SELECT path AS source_path, '/backup' || path AS target_path, 'copy' AS action FROM empties""")
def _(spark, sf_dir):
    plan = dirs.plan_cleanup(tree(spark, sf_dir))
    return snapshot.backup_manifest(plan, "/backup/").select("source_path", "target_path", "action")
