"""Named operators and plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

Operator = Callable[..., DataFrame]


@runtime_checkable
class Plugin(Protocol):
    """Something with a name and version that checks settings and makes a DataFrame."""

    name: str
    version: str

    def validate(self, **config) -> None: ...

    def execute(self, *inputs: DataFrame, **config) -> DataFrame: ...


class RowPlugin(Protocol):
    """Something with a name, a version and a result schema that makes rows out of each row."""

    name: str
    version: str
    schema: str

    def validate(self, **config) -> None: ...

    def rows(self, row: dict, **config) -> Iterable[tuple]: ...


def expose(spark: SparkSession, plugin: RowPlugin, **config) -> None:
    """Make a plug-in a table function of SQL: ``SELECT * FROM name(TABLE(t))``. Its settings
    are checked now; the tasks that hold the table's rows call it row by row."""
    plugin.validate(**config)

    class Function:
        def eval(self, row: Row):
            yield from plugin.rows(row.asDict(), **config)

    spark.udtf.register(plugin.name, udtf(Function, returnType=plugin.schema))


class Registry:
    def __init__(self) -> None:
        self._operators: dict[str, Operator] = {}
        self._checks: dict[str, Callable[..., None]] = {}

    def register_operator(self, name: str, operator: Operator,
                          validate: Callable[..., None] | None = None) -> None:
        self._operators[name] = operator
        if validate:
            self._checks[name] = validate

    def register_plugin(self, plugin: Plugin) -> None:
        self.register_operator(plugin.name, plugin.execute, plugin.validate)

    def supported(self) -> list[str]:
        return sorted(self._operators)

    def run(self, name: str, *inputs: DataFrame, **config) -> DataFrame:
        if name not in self._operators:
            raise ValueError(f"operation type {name} not supported")
        if name in self._checks:
            self._checks[name](**config)
        return self._operators[name](*inputs, **config)


def _cleanup(inv: DataFrame, **config) -> DataFrame:
    from treeline.operators.tree import plan_cleanup

    return plan_cleanup(inv, **config)


def _deduplication(files: DataFrame, algorithm: str = "blake2b", content: str = "content", **filters) -> DataFrame:
    """``filters``: exclude, min_size, max_size. Without the content column, files are read."""
    from treeline.operators import dedup

    if content in files.columns:
        return dedup.plan_dedup(dedup.staged_duplicates(files, algorithm, content, **filters)[1])
    members = dedup.staged_file_duplicates(files, algorithm, **filters)[1]
    return dedup.plan_dedup(members.filter("identical").drop("identical"))


def _consolidation(inv: DataFrame, dest: str, **config) -> DataFrame:
    from treeline.operators.arrange import plan_consolidation

    return plan_consolidation(inv, inv, dest, **config)


def _organization(inv: DataFrame, rules: DataFrame | None = None, *, dest: str, **config) -> DataFrame:
    from treeline.operators.arrange import suggest_organization

    return suggest_organization(inv, dest, rules=rules, **config)


def _ownership(inv: DataFrame, users: DataFrame | None = None, groups: DataFrame | None = None, *,
               target_user: str, target_group: str = "", **config) -> DataFrame:
    """With tables of users and groups the names decide the ids, else ``uid`` and ``gid`` do."""
    from treeline.operators.ownership import plan_ownership, resolve_principals

    if users is not None:
        spark = inv.sparkSession
        groups = spark.createDataFrame([], "`group` string, gid bigint") if groups is None else groups
        asked = spark.createDataFrame([(1, target_user, target_group)], "request_id int, user string, `group` string")
        current = (target_user, config.pop("uid", 0), config.pop("gid", 0))
        row = resolve_principals(asked, users, groups, current).first()
        if row.error:
            raise ValueError(row.error)
        config |= {"uid": row.uid, "gid": row.gid}
    return plan_ownership(inv, **config)


def _needs_target_user(**config) -> None:
    if "target_user" not in config:
        raise ValueError("target_user parameter is required")


def _similarity(vectors: DataFrame, **config) -> DataFrame:
    from treeline.operators.vectors import similar_pairs

    return similar_pairs(vectors, **config)


def builtin_registry() -> Registry:
    registry = Registry()
    registry.register_operator("cleanup", _cleanup)
    registry.register_operator("deduplication", _deduplication)
    registry.register_operator("consolidation", _consolidation)
    registry.register_operator("ownership", _ownership, _needs_target_user)
    registry.register_operator("organization", _organization)
    registry.register_operator("similarity", _similarity)
    return registry
