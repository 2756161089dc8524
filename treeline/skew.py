"""Ways round hot keys: lookups, self-joins and ordered windows that stay bounded
per task even when one key holds a large share of all rows.

Joins are lazy plans. Ordered windows first look whether any key is hot: without one they
are Spark's own window over an input that is read once more for the look; with one the input
is written once and cut. A key enters the table of hot keys with more than ``limit`` rows, so
it has at most ``rows / limit`` entries; it is joined as Spark sees fit, not forced into a
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut_lineage

ROWS_PER_TASK = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows, their row count and number of slots."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .withColumn("_slots", F.ceil(F.col("_n") / limit).cast("int"))
    )


def _slot_of(spread: Sequence[str]) -> Column:
    return F.when(F.col("_slots").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread), F.col("_slots")).cast("int")
    )


def _every_slot() -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots") - 1, F.lit(0))))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    limit: int = ROWS_PER_TASK,
    rows_per_key: str | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join a table whose keys may be hot with one that has one or few rows per key.

    Rows of a hot key are spread over slots by a hash of ``spread``; the matching
    right-hand rows are copied once per slot, all others stay single. Where the
    right-hand table already has the number of left-hand rows of its key in column
    ``rows_per_key``, no counting pass over the left-hand table is needed. Nor is one where
    the keys of many rows are given as ``hot``, with their number of slots in ``_slots``.
    """
    on = list(on)
    if hot is not None:
        found = hot
    elif rows_per_key is None:
        found = hot_keys(left.select(*on), on, limit)
    else:
        found = right.filter(F.col(rows_per_key) > limit).withColumn(
            "_slots", F.ceil(F.col(rows_per_key) / limit).cast("int")
        )
    hot = found.select(*on, "_slots")
    salted = left.join(hot, on, "left").withColumn("_slot", _slot_of(spread)).drop("_slots")
    copies = right.join(hot, on, "left").withColumn("_slot", _every_slot()).drop("_slots")
    return salted.join(copies, [*on, "_slot"], how).drop("_slot")


def skew_self_join(
    df: DataFrame,
    on: Sequence[str],
    condition: Callable[[str, str], Column],
    spread: Sequence[str],
    limit: int,
) -> DataFrame:
    """Self-join on ``on``; output columns are prefixed ``l_`` and ``r_``.

    ``condition(l, r)`` is part of the join, so rejected pairs are never produced.
    A hot key becomes a grid of slots x slots tasks of at most about 2*limit rows.
    """
    on = list(on)
    hot = hot_keys(df.select(*on), on, limit).select(*on, "_slots")
    base = df.join(hot, on, "left")

    def side(prefix: str, own: str, other: str) -> DataFrame:
        out = base.withColumn(own, _slot_of(spread)).withColumn(other, _every_slot())
        return out.select(
            *on, own, other, *[F.col(c).alias(prefix + c) for c in df.columns if c not in on]
        )

    joined = side("l_", "_i", "_j").alias("l").join(
        side("r_", "_j", "_i").alias("r"),
        [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*on, "_i", "_j"]] + [condition("l_", "r_")],
    )
    return joined.select(
        *[F.col(f"l.{k}").alias(k) for k in on],
        *[f"l_{c}" for c in df.columns if c not in on],
        *[f"r_{c}" for c in df.columns if c not in on],
    )


def fragments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = ROWS_PER_TASK,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add ``_frag``: -1 for ordinary keys, else the ordered piece of a hot key.

    Cut points of a hot key are a hash sample of its order values. They only place
    the cuts: whatever they are, pieces are contiguous and every row is in one.
    ``order`` has to identify a row within its key.
    """
    keys = list(keys)
    hot = hot_keys(df.select(*keys), keys, limit) if hot is None else hot
    cuts = (
        df.select(*keys, F.struct(*order).alias("_o"))
        .join(hot, keys)
        .filter(F.pmod(F.xxhash64("_o"), F.col("_n")) < 2 * F.col("_slots"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_o")).alias("_cuts"))
        .withColumn("_step", F.ceil(F.sqrt(F.size("_cuts"))).cast("int"))
        # every _step-th cut point, to search in two short passes
        .withColumn(
            "_heads", F.expr("filter(_cuts, (x, i) -> i % _step = 0)")
        )
    )
    located = (
        df.join(cuts, keys, "left")
        .withColumn("_o", F.struct(*order))
        .withColumn("_head", F.expr("size(filter(_heads, x -> x <= _o))"))
        .withColumn(
            "_frag",
            F.expr(
                "CASE WHEN _cuts IS NULL THEN -1 WHEN _head = 0 THEN 0 ELSE (_head - 1) * _step"
                " + size(filter(slice(_cuts, greatest((_head - 1) * _step + 1, 1), _step),"
                " x -> x <= _o)) END"
            ),
        )
    )
    return located.select(*df.columns, "_frag")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Running ("sum", expr) or ("max", expr) per key up to and including each row.

    Each piece of a hot key is aggregated on its own, and the combined value of the
    pieces before it is brought in, so no task holds all rows of a hot key.
    """
    keys = list(keys)
    agg = {"sum": F.sum, "max": F.max}
    hot = cut_lineage(hot_keys(df.select(*keys), keys, limit))
    if hot.isEmpty():
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*df.columns, *[agg[kind](expr).over(upto).alias(o) for o, (kind, expr) in outputs.items()])
    valued = cut_lineage(df.withColumns({f"_v_{o}": expr for o, (_, expr) in outputs.items()}))
    cut = cut_lineage(fragments(valued, keys, order, limit, hot))
    totals = (
        cut.filter("_frag >= 0")
        .groupBy(*keys, "_frag")
        .agg(*[agg[kind](f"_v_{o}").alias(f"_t_{o}") for o, (kind, _) in outputs.items()])
    )
    before = Window.partitionBy(*keys).orderBy("_frag").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_frag",
        *[agg[kind](f"_t_{o}").over(before).alias(f"_c_{o}") for o, (kind, _) in outputs.items()],
    )
    within = (
        Window.partitionBy(*keys, "_frag")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def value(out: str, kind: str) -> Column:
        own = agg[kind](f"_v_{out}").over(within)
        if kind == "max":
            return F.greatest(own, F.col(f"_c_{out}"))
        both = F.coalesce(own, F.lit(0)) + F.coalesce(F.col(f"_c_{out}"), F.lit(0))
        return F.when(own.isNotNull() | F.col(f"_c_{out}").isNotNull(), both)

    # one carry row per piece of a hot key: at most about two per ``limit`` rows
    joined = cut.join(carry, [*keys, "_frag"], "left")
    return joined.select(*df.columns, *[value(o, kind).alias(o) for o, (kind, _) in outputs.items()])


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``_frag`` and ``_halo`` so that a frame of ``rows`` preceding rows can be
    evaluated per (keys, _frag). Rows with ``_halo`` set are copies of the last rows
    before the piece; the caller drops them after the window.
    """
    keys = list(keys)
    hot = cut_lineage(hot_keys(df.select(*keys), keys, limit))
    if hot.isEmpty():
        return df.withColumn("_frag", F.lit(-1)).withColumn("_halo", F.lit(False))
    cut = cut_lineage(fragments(cut_lineage(df), keys, order, limit, hot))
    last = Window.partitionBy(*keys, "_frag").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        cut.filter("_frag >= 0")
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= rows)
    )
    ordered = Window.partitionBy(*keys).orderBy(*order)
    others = [c for c in df.columns if c not in keys]
    halo = (
        tails.withColumn("_next", F.lead("_frag").over(ordered))
        .withColumn(
            "_rows", F.collect_list(F.struct(*others)).over(ordered.rowsBetween(1 - rows, 0))
        )
        .filter(F.col("_next").isNotNull() & (F.col("_next") != F.col("_frag")))
        .select(*keys, F.col("_next").alias("_frag"), F.explode("_rows").alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], "_frag")
    )
    return cut.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
