"""Queries on file contents: duplicates, digests, kinds and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.catalog.data import (CATEGORY_SQL, FILES_SQL, files, query, table)
from treeline.functions import hashing, labels, paths, rules
from treeline.functions.kinds import IMAGE_FORMATS
from treeline.operators import dedup
from treeline.operators.enrich import enrich, scope_estimate, type_census
from treeline.plans.registry import builtin_registry
from treeline.schema import ALGORITHMS
from treeline.session import scratch
from treeline.skew import skew_join
from treeline.sources import tables
from treeline.sources.listing import hash_manifest

_GROUPS_SQL = f"""WITH {FILES_SQL}, hashed AS (SELECT *, sha256(content) AS hash FROM inv),
groups AS (SELECT hash AS id, size, count(*) AS files, sum(size)::BIGINT AS total_size,
  ((count(*) - 1) * size)::BIGINT AS saveable_size, arg_min(path, (mod_us, path)) AS survivor
  FROM hashed GROUP BY hash, size HAVING count(*) > 1),
members AS (SELECT hash AS group_id, path, h.size, survivor, path = survivor AS keep
  FROM hashed h JOIN groups g ON h.hash = g.id AND h.size = g.size)"""
_GROUP_COLUMNS = ("id", "size", "files", "total_size", "saveable_size", "survivor")


def _hashed(spark, sf_dir, algorithm="sha256"):
    return dedup.with_digests(files(spark, sf_dir), algorithm)


def _groups(spark, sf_dir):
    return dedup.duplicate_groups(_hashed(spark, sf_dir), "sha256")


def _groups_and_members(spark, sf_dir):
    hashed = dedup.manifest(files(spark, sf_dir), "sha256")
    groups = dedup.duplicate_groups(hashed, "sha256")
    return groups, dedup.duplicate_members(hashed, groups)


def _members(spark, sf_dir):
    return _groups_and_members(spark, sf_dir)[1]


@query("dedup_size_candidates", f"""WITH {FILES_SQL} SELECT path, size FROM inv
  WHERE size IN (SELECT size FROM inv GROUP BY size HAVING count(*) > 1)""")
def _(spark, sf_dir):
    return dedup.same_size(files(spark, sf_dir).select("path", "size"))


@query("dedup_fast_candidates", f"""WITH {FILES_SQL}, hashed AS (SELECT *, sha256(content) AS hash FROM inv)
  SELECT path, size FROM hashed
  WHERE (size, hash) IN (SELECT (size, hash) FROM hashed GROUP BY size, hash HAVING count(*) > 1)""")
def _(spark, sf_dir):
    fast = files(spark, sf_dir).select("path", "size", hashing.fast_hash("content").alias("fast"))
    return dedup.same_fast_hash(fast).select("path", "size")


@query("dedup_groups", _GROUPS_SQL + " SELECT id, size, files, total_size, saveable_size, survivor FROM groups")
def dedup_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select(*_GROUP_COLUMNS)


@query("dedup_staged", _GROUPS_SQL + " SELECT id, size, files, total_size, saveable_size, survivor FROM groups")
def _(spark, sf_dir):
    return dedup.staged_duplicates(files(spark, sf_dir), "sha256")[0].select(*_GROUP_COLUMNS)


@query("dedup_staged_filtered", f"""WITH {FILES_SQL} SELECT path AS source_path, CASE WHEN path = first THEN 'keep' ELSE 'remove' END AS action
  FROM (SELECT *, count(*) OVER w AS n, first_value(path) OVER (PARTITION BY content ORDER BY mod_us, path) AS first
    FROM inv WHERE size >= 500 AND size <= 20000 AND path NOT LIKE '%.tmp' WINDOW w AS (PARTITION BY content)) WHERE n > 1""")
def _(spark, sf_dir):
    found = builtin_registry().run("deduplication", files(spark, sf_dir), exclude=("*.tmp",), min_size=500, max_size=20000)
    return found.select("source_path", "action")


@query("dedup_members", _GROUPS_SQL + " SELECT group_id, path, size, survivor, keep FROM members")
def _(spark, sf_dir):
    return _members(spark, sf_dir).drop("mod_time")


@query("dedup_plan", _GROUPS_SQL + """ SELECT path AS source_path,
  CASE WHEN keep THEN 'keep' ELSE 'remove' END AS action,
  CASE WHEN keep THEN 'oldest of its group' ELSE 'duplicate of ' || survivor END AS reason, size FROM members""")
def _(spark, sf_dir):
    return dedup.plan_dedup(_members(spark, sf_dir)).select("source_path", "action", "reason", "size")


@query("dedup_summary", _GROUPS_SQL + """ SELECT count(*) AS duplicate_groups,
  coalesce(sum(files), 0)::BIGINT AS duplicate_files, coalesce(sum(total_size), 0)::BIGINT AS total_size,
  coalesce(sum(saveable_size), 0)::BIGINT AS saveable_size FROM groups""")
def _(spark, sf_dir):
    return dedup.dedup_summary(_groups(spark, sf_dir))


@query("dedup_verify", _GROUPS_SQL + " SELECT group_id, path, size, true AS identical FROM members")
def _(spark, sf_dir):
    return dedup.verify_bytes(files(spark, sf_dir), _members(spark, sf_dir)).drop("differs_at")


@query("largest_groups", _GROUPS_SQL + """ SELECT id, size, files, saveable_size FROM groups
  ORDER BY saveable_size DESC, id, size LIMIT 10""")
def _(spark, sf_dir):
    return dedup.largest_groups(_groups(spark, sf_dir), 10).select("id", "size", "files", "saveable_size")


@query("dedup_filtered", f"""WITH {FILES_SQL} SELECT sha256(content) AS id, size, count(*) AS files,
  ((count(*) - 1) * size)::BIGINT AS saveable_size FROM inv
  WHERE ext NOT IN ('.tmp', '.log') AND size BETWEEN 1 AND 1000000000
  GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf_dir):
    kept = files(spark, sf_dir).filter(
        rules.path_allowed("path", ("*.tmp", "*.log", ".DS_Store")) & rules.size_between("size", 1, 10**9)
    )
    groups = dedup.duplicate_groups(dedup.with_digests(kept, "sha256"), "sha256")
    return groups.select("id", "size", "files", "saveable_size")


@query("dedup_saved_tables", _GROUPS_SQL + """ SELECT id, g.files, count(*) AS members,
  count(*) FILTER (WHERE keep) AS kept FROM groups g JOIN members m ON g.id = m.group_id AND g.size = m.size
  GROUP BY id, g.size, g.files""")
def _(spark, sf_dir):
    folder = scratch(spark, "duplicates")
    tables.save_duplicates(*_groups_and_members(spark, sf_dir), folder)
    groups, members = tables.load_duplicates(spark, folder)
    counted = members.groupBy(F.col("group_id").alias("id"), "size").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("keep")).alias("kept")
    )
    return groups.join(counted, ["id", "size"]).select("id", "files", "members", "kept")


def _manifest(algorithm):
    def run(spark, sf_dir):
        return hash_manifest(files(spark, sf_dir), algorithm)

    return run


def _twins(algorithm):
    def run(spark, sf_dir):
        hashed = hash_manifest(files(spark, sf_dir), algorithm)
        counts = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("twins"))
        return skew_join(hashed, counts, ["hash"], "inner", ["path"]).select(
            "path", "twins", F.length("hash").cast("bigint").alias("digits")
        )

    return run


_DIGITS = {"sha512": 128, "crc32": 8, "xxhash64": 16, "blake2b": 64}
for _name in ALGORITHMS:
    if _name in _DIGITS:
        query(f"hash_manifest_{_name}", f"""WITH {FILES_SQL} SELECT path,
  count(*) OVER (PARTITION BY sha256(content)) AS twins, {_DIGITS[_name]}::BIGINT AS digits FROM inv""")(_twins(_name))
    else:
        query(f"hash_manifest_{_name}", f"""WITH {FILES_SQL}
  SELECT path, size, {_name}(content) AS hash, '{_name}' AS hash_type FROM inv""")(_manifest(_name))


_WEB_SQL = FILES_SQL + """, files AS (SELECT path, size FROM inv UNION ALL
  SELECT '/web/' || regexp_replace(url, '^https?://', ''), strlen(html) FROM pages),
named AS (SELECT *, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS name,
  lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM files)"""


def _all_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/web/"), F.regexp_replace("url", "^https?://", "")).alias("path"),
        F.octet_length("html").cast("bigint").alias("size"),
    )
    return files(spark, sf_dir).select("path", "size").unionByName(pages)


_KIND_OF_SQL = """CASE ext WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown'
  WHEN '.html' THEN 'text/html' WHEN '.css' THEN 'text/css' WHEN '.js' THEN 'application/javascript'
  WHEN '.json' THEN 'application/json' WHEN '.pdf' THEN 'application/pdf' WHEN '.zip' THEN 'application/zip'
  WHEN '.gz' THEN 'application/gzip' WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png'
  WHEN '.mp3' THEN 'audio/mpeg' WHEN '.mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END"""


@query("enrich_paths", f"""WITH {_WEB_SQL}, typed AS (SELECT *, {_KIND_OF_SQL} AS mime_type FROM named)
  SELECT path, size, name, regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/+$', '') AS parent,
    (length(path) - length(replace(path, '/', '')) + 1)::BIGINT AS depth, ext,
    name LIKE '.%' AS is_hidden,
    CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024.0) || ' KB'
      ELSE printf('%.1f', size / 1048576.0) || ' MB' END AS size_h,
    mime_type, {CATEGORY_SQL} AS category, mime_type LIKE 'image/%' AS is_image,
    mime_type LIKE 'video/%' AS is_video, mime_type LIKE 'audio/%' AS is_audio,
    mime_type LIKE 'text/%' AS is_text FROM typed""")
def _(spark, sf_dir):
    return enrich(_all_files(spark, sf_dir)).withColumn("depth", F.col("depth").cast("bigint"))


@query("type_census", f"""WITH {_WEB_SQL}, typed AS (SELECT *, {CATEGORY_SQL} AS category FROM named)
  SELECT category, ext, grouping(category, ext)::BIGINT AS level, count(*) AS files, sum(size)::BIGINT AS bytes
  FROM typed GROUP BY ROLLUP (category, ext)""")
def _(spark, sf_dir):
    return type_census(enrich(_all_files(spark, sf_dir))).select("category", "ext", "level", "files", "bytes")


@query("scope_estimate", f"""WITH {FILES_SQL} SELECT count(*) AS total_items, 0::BIGINT AS directories,
  count(*) AS files, sum(size)::BIGINT AS total_bytes FROM inv""")
def _(spark, sf_dir):
    return scope_estimate(files(spark, sf_dir))


@query("normal_paths", """SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN '/data/' || lang || '/' || source || '/x' || doc_id
    WHEN 1 THEN '/' || source || '/x' || doc_id
    WHEN 2 THEN '/x' || doc_id
    ELSE '/work/' || lang || '/x' || doc_id END AS path_norm FROM documents""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    x = F.concat(F.lit("x"), "doc_id")
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/data//"), "lang", F.lit("/./"), "source", F.lit("/"), x, F.lit("/")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/data/"), "lang", F.lit("/../../"), "source", F.lit("//"), x))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/../"), "lang", F.lit("/../../../"), x))
        .otherwise(F.concat(F.lit("./"), "lang", F.lit("/"), "source", F.lit("/../"), x))
    )
    return docs.select("doc_id", paths.normal_path(raw, "/work").alias("path_norm"))


@query("size_labels", """SELECT doc_id, bytes, CASE
    WHEN bytes < 1024 THEN bytes || ' B'
    WHEN bytes < 1048576 THEN printf('%.1f', bytes / 1024.0::DOUBLE) || ' KB'
    WHEN bytes < 1073741824 THEN printf('%.1f', bytes / 1048576.0::DOUBLE) || ' MB'
    WHEN bytes < 1099511627776 THEN printf('%.1f', bytes / 1073741824.0::DOUBLE) || ' GB'
    WHEN bytes < 1125899906842624 THEN printf('%.1f', bytes / 1099511627776.0::DOUBLE) || ' TB'
    ELSE printf('%.1f', bytes / 1125899906842624.0::DOUBLE) || ' PB' END AS size_h
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * n_chars
    WHEN 2 THEN n_chars * n_chars * n_chars ELSE n_chars * 7 END AS bytes FROM documents)""")
def _(spark, sf_dir):
    n, turn = F.col("n_chars"), F.col("doc_id") % 4
    size = F.when(turn == 0, n).when(turn == 1, n * n).when(turn == 2, n * n * n).otherwise(n * 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("bytes"))
    return docs.withColumn("size_h", labels.size_label("bytes"))


_UNITS = ("KB", "kb", "MB", " MB", "GB", "B", "", "TB", "%", ".5GB")


@query("parse_sizes", f"""SELECT p_partkey, txt, CASE p_partkey % 10
    WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576
    WHEN 4 THEN p_size * 1073741824 WHEN 5 THEN p_size WHEN 6 THEN p_size ELSE 67108864 END::BIGINT AS bytes
  FROM (SELECT p_partkey, p_size::BIGINT AS p_size,
    p_size || ([{', '.join(f"'{u}'" for u in _UNITS)}])[p_partkey % 10 + 1] AS txt FROM part)""")
def _(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("txt"))
    return parts.withColumn("bytes", labels.parse_size("txt", 64 * 1024 * 1024))


@query("operation_id_collisions", """SELECT op_id, count(*) AS operations FROM (
    SELECT lower(substr(o_orderpriority, 3)) || '-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') AS op_id FROM orders)
  GROUP BY op_id HAVING count(*) > 1""")
def _(spark, sf_dir):
    kind = F.lower(F.substr("o_orderpriority", F.lit(3)))
    ops = table(spark, sf_dir, "orders").select(labels.operation_id(kind, "o_orderdate").alias("op_id"))
    return ops.groupBy("op_id").agg(F.count(F.lit(1)).alias("operations")).filter("operations > 1")


@query("derived_labels", """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y/%m/%d') AS bucket,
    epoch_us(l_shipdate) - epoch_us(o_orderdate) AS elapsed_us,
    CASE WHEN l_linenumber - 3 > 0 THEN round(l_quantity / (l_linenumber - 3) * 100, 6) END AS pct,
    upper(substr(w, 1, 1)) || lower(substr(w, 2)) || ' Items ' || l_returnflag AS title
  FROM (SELECT *, split_part(o_orderpriority, '-', 2) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    LATERAL (SELECT split_part(p, ' ', 1) AS w)""")
def _(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority"),
        "l_orderkey",
    )
    word = F.substring_index(F.substring_index("o_orderpriority", "-", -1), " ", 1)
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        labels.date_bucket("l_shipdate").alias("bucket"),
        labels.elapsed_micros("o_orderdate", "l_shipdate").alias("elapsed_us"),
        F.round(labels.percent("l_quantity", F.col("l_linenumber") - 3), 6).alias("pct"),
        labels.title(F.concat(word, F.lit("_ITEMS_"), "l_returnflag")).alias("title"),
    )


@query("image_files", f"""WITH {FILES_SQL} SELECT path, size FROM inv
  WHERE ext IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff') AND size >= 500 AND size <= 5000""")
def _(spark, sf_dir):
    keep = rules.has_format(paths.extension("path"), IMAGE_FORMATS) & rules.size_between("size", 500, 5000)
    return files(spark, sf_dir).select("path", "size").filter(keep)


@query("path_rules", f"""WITH {FILES_SQL} SELECT path FROM inv
  WHERE NOT (ext IN ('.tmp', '.log') OR contains(path, '/src1')) AND (ext = '.txt' OR path LIKE '/data/fr/%'
    OR regexp_matches({"regexp_extract(path, '([^/]*)$', 1)"}, '^f[0-4][^3-7].*$'))""")
def _(spark, sf_dir):
    keep = rules.path_allowed("path", ("*.tmp", "*.log", "/SRC1"), ("*.txt", "/fr/", "f[0-4][^3-7]*"))
    return files(spark, sf_dir).select("path").filter(keep)
