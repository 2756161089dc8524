from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    """A column, or the column of that name."""
    return F.col(value) if isinstance(value, str) else value


def once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add expensive columns that are computed exactly once per row.

    Spark would repeat them in every filter it derives from a later join or predicate.
    Nothing is pushed through a generator, so the values come out of a one-row explode.
    """
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_once")).select(*df.columns, "_once.*")
