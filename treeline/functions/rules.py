"""Row predicates over file records. Patterns are folded into one expression."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.columns import as_col
from treeline.functions.globs import matches_glob
from treeline.functions.paths import base_name, depth

# Directory names that cleanup never touches.
SYSTEM_NAMES = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".DS_Store")


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def names_or_contains(path: Column | str, patterns: Iterable[str]) -> Column:
    """The base name matches a pattern, or the path holds its text in any case."""
    path = as_col(path)
    name = base_name(path)
    return _any(
        matches_glob(name, p) | F.contains(F.lower(path), F.lower(F.lit(p))) for p in patterns
    )


def is_hidden(path: Column | str) -> Column:
    name = base_name(path)
    return F.startswith(name, F.lit(".")) & ~name.isin(".", "..")


def cleanup_allows(
    path: Column | str, exclude: Iterable[str] = (), include: Iterable[str] = ()
) -> Column:
    name = base_name(path)
    wanted = _any(matches_glob(name, p) for p in include)
    return ~(
        names_or_contains(path, exclude) | name.isin(*SYSTEM_NAMES) | (is_hidden(path) & ~wanted)
    )


def path_allowed(
    path: Column | str, exclude: Iterable[str] = (), include: Iterable[str] = ()
) -> Column:
    """Not excluded, and included if there are include patterns."""
    include = list(include)
    allowed = ~names_or_contains(path, exclude)
    return allowed & names_or_contains(path, include) if include else allowed


def ownership_allows(path: Column | str, exclude: Iterable[str] = ()) -> Column:
    """Patterns are held against the full path, so '.git' excludes no absolute path."""
    path = as_col(path)
    return ~_any(matches_glob(path, p) for p in exclude)


def within_depth(path: Column | str, root: Column | str, max_depth: int = 0) -> Column:
    """At most ``max_depth`` levels below the root; 0 means no limit."""
    if max_depth <= 0:
        return F.lit(True)
    return depth(path) <= depth(root) + max_depth


def within_scope(path: Column | str, root: Column | str, recursive: bool) -> Column:
    """Non-recursive runs see the root and its direct children."""
    return within_depth(path, root, 0 if recursive else 1)


def size_between(size: Column | str, low: int = 0, high: int = 0) -> Column:
    """Size limits in bytes; 0 means no limit."""
    size = as_col(size)
    keep = size >= low
    return keep & (size <= high) if high > 0 else keep


def has_format(ext: Column | str, formats: Iterable[str]) -> Column:
    return as_col(ext).isin(*["." + f.lower().lstrip(".") for f in formats])
