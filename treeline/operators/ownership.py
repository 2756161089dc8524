"""Owner look-up and ownership plans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import as_root, parent_of
from treeline.functions.rules import ownership_allows
from treeline.skew import ROWS_PER_TASK, skew_join
from treeline.sources.tables import under_roots


def resolve_principals(
    requests: DataFrame,
    users: DataFrame,
    groups: DataFrame,
    current: tuple[str, int, int],
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Ids for requests (request_id, user, group).

    ``users`` has user, uid, gid; ``groups`` has group, gid. No user means the current
    one, and then the group is ignored. A group overrides the user's own; unknown names
    leave ids empty and set ``error``.
    """
    name, uid, gid = current
    known = users.select(
        "user", F.col("uid").cast("bigint").alias("_uid"), F.col("gid").cast("bigint").alias("_gid")
    )
    named = groups.select("group", F.col("gid").cast("bigint").alias("_group_gid"))
    filled = requests.withColumns({c: F.coalesce(c, F.lit("")) for c in ("user", "group")})
    joined = skew_join(filled, known, ["user"], "left", ["request_id"], limit)
    joined = skew_join(joined, named, ["group"], "left", ["request_id"], limit)
    own = F.col("user") == ""
    wants_group = F.col("group") != ""
    error = F.when(~own, F.when(F.col("_uid").isNull(), F.concat(F.lit("user not found: "), "user"))
                   .when(wants_group & F.col("_group_gid").isNull(),
                         F.concat(F.lit("group not found: "), "group")))
    gid_col = F.when(own, F.lit(gid)).when(wants_group, F.col("_group_gid")).otherwise(F.col("_gid"))
    return (
        joined.withColumn("error", error)
        .select(
            "request_id",
            F.when(own, F.lit(name)).otherwise(F.col("user")).alias("user"),
            F.when(F.col("error").isNull(), F.when(own, F.lit(uid)).otherwise(F.col("_uid"))).cast("bigint").alias("uid"),
            F.when(F.col("error").isNull(), gid_col).cast("bigint").alias("gid"),
            "error",
        )
    )


def plan_ownership(
    inv: DataFrame,
    roots: Sequence[str],
    uid: int,
    gid: int,
    exclude: Iterable[str] = (),
    recursive: bool = True,
    dry_run: bool = False,
    failed: DataFrame | None = None,
    only_changes: bool = False,
) -> DataFrame:
    """Every path in scope gets the owner, whether it has it already or not.

    Slashes at the end of a root do not matter. Non-recursive runs see the roots and their
    direct children. ``failed`` (path, error) marks paths whose change fails, and
    ``only_changes`` leaves out rows whose uid and gid are right already.
    """
    if recursive:
        scope = under_roots(inv, roots)
    else:
        # the roots and their direct children
        named = inv.sparkSession.createDataFrame([(r,) for r in roots], "path string").select(as_root("path").alias("_root")).distinct()
        direct = inv.filter(F.col("path") != "/").select("path", parent_of("path").alias("_root"))
        near = direct.unionByName(inv.select("path", F.col("path").alias("_root")))
        scope = inv.join(near.join(named, "_root", "left_semi").select("path").distinct(), "path", "left_semi")
    todo = scope.filter(ownership_allows("path", exclude))
    if only_changes:
        todo = todo.filter(~(F.col("uid").eqNullSafe(F.lit(uid)) & F.col("gid").eqNullSafe(F.lit(gid))))
    if failed is None or dry_run:
        todo = todo.withColumn("error", F.lit(None).cast("string"))
    else:
        todo = todo.drop("error").join(failed.select("path", "error"), "path", "left")
    return todo.select(
        F.col("path").alias("source_path"),
        F.lit(None).cast("string").alias("target_path"),
        F.lit("chown").alias("action"),
        F.when(F.col("error").isNull(), "changed").otherwise("skipped").alias("status"),
        F.coalesce("error", F.lit("in scope")).alias("reason"),
        "size",
        F.lit(uid).cast("bigint").alias("uid"),
        F.lit(gid).cast("bigint").alias("gid"),
    )
