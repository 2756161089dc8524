"""Fit a small model on a bounded sample, in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Model = TypeVar("Model")


def bounded_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of ``columns``; all if there are no more.

    Tasks first drop what a threshold on the hash makes needless, so what meets in one place
    is about half as many rows again, however many tasks there are. Where one value has so many
    rows that fewer are left than asked for, all take part.
    """
    count, steps = df.count(), 1 << 40
    place = F.pmod(F.xxhash64(*columns), F.lit(steps))
    some = df
    if count > 2 * rows:
        near = df.filter(place < int(steps * min(1.0, (1.5 * rows + 50) / count)))
        some = near if near.limit(rows).count() == rows else df
    return some.orderBy(place, *columns).limit(rows)


def whole_within(df: DataFrame, most: int, size: Column, *columns: str) -> DataFrame:
    """As many of the few rows of ``df``, in the order of a hash of ``columns``, as together have a
    ``size`` of at most ``most``, and one at least. Rows stay whole."""
    place = F.struct(F.xxhash64(*columns), *columns)
    upto = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(upto), F.lit(0))
    return df.withColumn("_before", before).withColumn("_size", size).filter(
        (F.col("_before") == 0) | (F.col("_before") + F.col("_size") <= most)).drop("_before", "_size")


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], Model]) -> Model:
    """What ``fit`` makes of the rows of ``sample``, whose number the caller has bounded.
    They come in the order of their columns, so that the result can be repeated. Only the
    model reaches the driver; a lost executor repeats the fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*[c.to_pylist() for c in batch.columns], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(rows)))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([])
