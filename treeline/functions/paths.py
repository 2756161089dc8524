"""Path columns: base name, parent, depth, normal form, extension, ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.columns import as_col


def base_name(path: Column | str) -> Column:
    """Last element; trailing slashes are ignored, '' gives '.', '/' gives '/'."""
    path = as_col(path)
    trimmed = F.rtrim(path, F.lit("/"))
    return (
        F.when(path == "", ".")
        .when(trimmed == "", "/")
        .otherwise(F.substring_index(trimmed, "/", -1))
    )


def as_root(path: Column | str) -> Column:
    """A root as records name it: without slashes at the end, '/' itself excepted."""
    trimmed = F.rtrim(as_col(path), F.lit("/"))
    return F.when(trimmed == "", "/").otherwise(trimmed)


def parent_of(path: Column | str) -> Column:
    """All but the last element; '/x' gives '/', a bare name gives '.'."""
    path = as_col(path)
    last = F.substring_index(path, "/", -1)
    head = F.rtrim(F.substr(path, F.lit(1), F.length(path) - F.length(last)), F.lit("/"))
    return F.when(~F.contains(path, F.lit("/")), ".").when(head == "", "/").otherwise(head)


def separators(path: Column | str) -> Column:
    path = as_col(path)
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def depth(path: Column | str) -> Column:
    """Number of '/'-separated parts, the empty part before a leading '/' included."""
    return separators(path) + 1


def normal_path(path: Column | str, working_dir: str = "/") -> Column:
    """Absolute path without empty, '.' and '..' parts."""
    path = as_col(path)
    absolute = F.when(F.startswith(path, F.lit("/")), path).otherwise(
        F.concat(F.lit(working_dir.rstrip("/") + "/"), path)
    )
    parts = F.filter(F.split(absolute, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def extension(path: Column | str) -> Column:
    """Lower-cased suffix from the last dot of the last element, dot included."""
    return F.lower(F.regexp_extract(as_col(path), r"(\.[^./]*)\z", 1))


def stem_and_suffix(path: Column | str) -> tuple[Column, Column]:
    """The path without its last-dot suffix, and the suffix in its own case."""
    path = as_col(path)
    suffix = F.regexp_extract(path, r"(\.[^./]*)\z", 1)
    return F.substr(path, F.lit(1), F.length(path) - F.length(suffix)), suffix


def ancestors(path: Column | str) -> Column:
    """All proper ancestors, outermost first: '/a/b/c' gives '/', '/a', '/a/b'."""
    path = as_col(path)
    count = separators(path)
    heads = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.call_function("substring_index", path, F.lit("/"), i.cast("int")),
    )
    named = F.transform(heads, lambda h: F.when(h == "", "/").otherwise(h))
    nothing = F.array().cast("array<string>")
    return F.when((path == "/") | (count == 0), nothing).otherwise(named)


def is_under(path: Column | str, root: Column | str) -> Column:
    """The path is the root itself or lies below it."""
    path, root = as_col(path), as_col(root)
    prefix = F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))
    return (path == root) | F.startswith(path, prefix)
