"""Progress telemetry of operations: rates, remaining time, life cycle, retention.

Sample tables have id, ts, items, bytes and total_items; ``order`` columns identify a
row within its id. Windows go through ``treeline.skew``, so one id may hold a large
share of all samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.skew import ROWS_PER_TASK, running, with_halo

# Fixed value: samples in the speed buffer.
SPEED_SAMPLES = 10


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def speed(
    samples: DataFrame, order: Sequence[str] = ("ts",), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Items per second over the last ten samples, truncated; 0 without a time span."""
    spread = with_halo(samples, ["id"], order, SPEED_SAMPLES - 1, limit)
    buffer = (
        Window.partitionBy("id", "_frag").orderBy(*order).rowsBetween(1 - SPEED_SAMPLES, 0)
    )
    span = _seconds(F.col("ts"), F.col("_first.ts"))
    rate = (F.col("items") - F.col("_first.items")) / span
    return (
        spread.withColumn("_first", F.first(F.struct("ts", "items")).over(buffer))
        .withColumn("speed", F.when(span == 0, F.lit(0)).otherwise(rate.cast("bigint")))
        .filter(~F.col("_halo"))
        .select(*samples.columns, "speed")
    )


def eta(with_speed: DataFrame) -> DataFrame:
    """Whole seconds left; none without a total, when done, or at speed 0."""
    open_end = (
        (F.col("total_items") == 0)
        | (F.col("items") >= F.col("total_items"))
        | (F.col("speed") == 0)
    )
    left = ((F.col("total_items") - F.col("items")) / F.col("speed")).cast("bigint")
    return with_speed.withColumn("eta", F.when(~open_end, left))


def instant_rate(
    samples: DataFrame, order: Sequence[str] = ("ts",), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Items and bytes per second since the previous sample; 0 unless they grew."""
    spread = with_halo(samples, ["id"], order, 1, limit)
    by_time = Window.partitionBy("id", "_frag").orderBy(*order)
    span = _seconds(F.col("ts"), F.col("_prev.ts"))

    def rate(column: str) -> Column:
        grown = F.col(column) - F.col(f"_prev.{column}")
        return F.when((span > 0) & (grown > 0), grown / span).otherwise(F.lit(0.0))

    return (
        spread.withColumn("_prev", F.lag(F.struct("ts", "items", "bytes")).over(by_time))
        .withColumn("items_per_sec", rate("items"))
        .withColumn("bytes_per_sec", rate("bytes"))
        .filter(~F.col("_halo"))
        .select(*samples.columns, "items_per_sec", "bytes_per_sec")
    )


def running_totals(
    increments: DataFrame, order: Sequence[str] = ("ts",), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Cumulative items and bytes of (d_items, d_bytes) increments."""
    sums = {"items": ("sum", F.col("d_items")), "bytes": ("sum", F.col("d_bytes"))}
    return running(increments, ["id"], order, sums, limit)


def latest_snapshot(samples: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last sample per id, as an aggregate that combines map-side."""
    rest = [c for c in samples.columns if c != "id"]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return samples.groupBy("id").agg(last.alias("_r")).select("id", "_r.*")


def step_progress(
    events: DataFrame, order: Sequence[str] = ("ts",), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Steps completed and current step after each event; ``step`` is null on others."""
    is_step = F.col("step").isNotNull()
    out = running(
        events, ["id"], order,
        {
            "steps_completed": ("sum", is_step.cast("bigint")),
            "_last": ("max", F.when(is_step, F.struct(*order, "step"))),
        },
        limit,
    )
    return out.withColumn("current_step", F.coalesce("_last.step", F.lit("Initializing"))).drop("_last")


# What an event does to an operation: these always set the status ...
SETS_STATUS = {"start": "running", "complete": "completed", "fail": "failed", "cancel": "cancelled"}
# ... and these only while it runs (pause) or is paused (resume).
TOGGLES = ("pause", "resume")


def status_after(last_set: Column, last_toggle: Column) -> Column:
    """Status from the last status-setting event and the last toggle, as structs (at, kind).

    A toggle counts only after a start that nothing has ended since. From there the last
    toggle decides: a pause leaves it paused and a resume running, whatever came between.
    So the fold over all events is two maxima, and they combine in any order.
    """
    paused = (last_toggle["kind"] == "pause") & (last_toggle["at"] > last_set["at"])
    status = F.when(last_set.isNull(), "pending").when(
        (last_set["kind"] == "start") & F.coalesce(paused, F.lit(False)), "paused"
    )
    for kind, name in SETS_STATUS.items():
        status = status.when(last_set["kind"] == kind, name)
    return status


def life_cycle_parts(order: Sequence[str]) -> dict[str, Column]:
    """The two values whose maxima give the status."""
    mark = F.struct(F.struct(*order).alias("at"), F.col("kind"))
    return {
        "last_set": F.when(F.col("kind").isin(*SETS_STATUS), mark),
        "last_toggle": F.when(F.col("kind").isin(*TOGGLES), mark),
    }


def life_cycle(events: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Final status, start and end time per id from events (id, ts, kind).

    Completing, failing and cancelling work from any status and rewrite the end time;
    a new start resets it.
    """
    parts = life_cycle_parts(order)
    started = F.when(F.col("kind") == "start", F.col("ts"))
    folded = events.groupBy("id").agg(
        *[F.max(expr).alias(name) for name, expr in parts.items()],
        F.max(started).alias("start_time"),
        F.max(F.when(F.col("kind").isin("complete", "fail", "cancel"), F.col("ts"))).alias("_ended"),
        F.count(F.lit(1)).alias("events"),
    )
    status = status_after(F.col("last_set"), F.col("last_toggle"))
    return folded.select(
        "id",
        status.alias("status"),
        "start_time",
        F.when(status.isin("completed", "failed", "cancelled"), F.col("_ended")).alias("end_time"),
        "events",
    )


def status_history(
    events: DataFrame, order: Sequence[str] = ("ts",), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Status after every single event."""
    parts = {n: ("max", e) for n, e in life_cycle_parts(order).items()}
    out = running(events, ["id"], order, parts, limit)
    return out.withColumn("status", status_after(F.col("last_set"), F.col("last_toggle"))).drop(*parts)


def operation_stats(ops: DataFrame) -> DataFrame:
    """Total, by status and by type in one pass."""
    return (
        ops.groupingSets([[], ["status"], ["operation_type"]], "status", "operation_type")
        .agg(F.count(F.lit(1)).alias("operations"))
    )


def error_summary(errors: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Error count and latest error per id. All errors stay rows: see ``error_list``."""
    return errors.groupBy("id").agg(
        F.count(F.lit(1)).alias("error_count"),
        F.max_by("error", F.struct(*order)).alias("latest_error"),
    )


def error_list(
    errors: DataFrame, order: Sequence[str] = ("ts",), limit: int = ROWS_PER_TASK
) -> DataFrame:
    """All errors with their position within the operation."""
    return running(errors, ["id"], order, {"position": ("sum", F.lit(1))}, limit)


def evict_finished(ops: DataFrame, now: Column, max_age: timedelta) -> DataFrame:
    """Operations that stay tracked: running or paused, not ended, or ended recently."""
    cutoff = now - F.expr(f"INTERVAL {int(max_age.total_seconds())} SECONDS")
    old = (
        ~F.col("status").isin("running", "paused")
        & F.col("end_time").isNotNull()
        & (F.col("end_time") < cutoff)
    )
    return ops.filter(~F.coalesce(old, F.lit(False)))


def progress_record(
    ops: DataFrame, samples: DataFrame, steps: DataFrame | None = None, errors: DataFrame | None = None,
    order: Sequence[str] = ("ts",), limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per operation of ``ops`` (id, status, start_time, end_time): where it stands.

    Items, bytes, speed and remaining time come from the last sample, the step from events
    (id, step), the error and the number of errors from ``errors``. What an operation has
    none of is 0, null, or the first step's name.
    """
    last = latest_snapshot(eta(speed(samples, order, limit)), order)
    out = ops.join(last.select("id", "items", "bytes", "total_items", "speed", "eta"), "id", "left")
    if steps is not None:
        now = latest_snapshot(step_progress(steps, order, limit), order).select("id", "steps_completed", "current_step")
        out = out.join(now, "id", "left")
    else:
        out = out.withColumns({"steps_completed": F.lit(None).cast("bigint"), "current_step": F.lit(None).cast("string")})
    if errors is not None:
        out = out.join(error_summary(errors, order), "id", "left")
    else:
        out = out.withColumns({"error_count": F.lit(None).cast("bigint"), "latest_error": F.lit(None).cast("string")})
    none = F.lit(0)
    return out.select(
        *ops.columns,
        F.coalesce("current_step", F.lit("Initializing")).alias("current_step"),
        F.coalesce("steps_completed", none).alias("steps_completed"),
        F.coalesce("items", none).alias("items_processed"), F.coalesce("total_items", none).alias("total_items"),
        F.coalesce("bytes", none).alias("bytes_processed"), F.coalesce("speed", none).alias("speed"),
        F.col("eta").alias("estimated_eta"), F.col("latest_error").alias("error"),
        F.coalesce("error_count", none).alias("error_count"),
    )


def operation_result(progress: DataFrame, plan: DataFrame, errors: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """One result per operation of ``progress`` (see ``progress_record``) from its plan rows
    (id, source_path, status, size) and its errors (id, ts, error).

    ``items_affected`` and ``bytes_affected`` count plan rows that were not skipped; those
    rows themselves are the files affected, and stay rows. ``first_error`` is the earliest.
    """
    done = plan.filter(~F.col("status").isin("skipped", "conflict", "would_remove")).groupBy("id").agg(
        F.count(F.lit(1)).alias("items_affected"), F.sum("size").alias("bytes_affected"))
    seen = errors.groupBy("id").agg(F.min_by("error", F.struct(*order)).alias("first_error"), F.count(F.lit(1)).alias("errors"))
    joined = progress.join(done, "id", "left").join(seen, "id", "left")
    ended = F.col("end_time").isNotNull() & F.col("start_time").isNotNull()
    return joined.select(
        "id", "status", "start_time", "end_time",
        F.when(ended, (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)).alias("duration"),
        "items_processed", "bytes_processed", F.coalesce("items_affected", F.lit(0)).alias("items_affected"),
        F.coalesce("bytes_affected", F.lit(0)).alias("bytes_affected"), F.coalesce("errors", F.lit(0)).alias("errors"), "first_error",
    )
