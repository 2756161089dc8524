"""Telemetry as Structured Streaming: live status, reports, sessions, incremental dedup."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from hashlib import md5
from inspect import signature

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from treeline.operators.telemetry import life_cycle_parts, status_after
from treeline.session import scratch


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*", fmt: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def progress_state(stream: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Latest snapshot per operation (update mode). The state is one row per id."""
    rest = [c for c in stream.columns if c != "id"]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return stream.groupBy("id").agg(last.alias("_r")).select("id", "_r.*")


def live_status(stream: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Life cycle per id (update mode). Only two marks per id are kept as state, and a
    late event changes the result exactly as if it had come in time."""
    parts = life_cycle_parts(order)
    folded = stream.groupBy("id").agg(
        *[F.max(e).alias(n) for n, e in parts.items()], F.count(F.lit(1)).alias("events")
    )
    return folded.select(
        "id", status_after(F.col("last_set"), F.col("last_toggle")).alias("status"), "events"
    )


def periodic_report(stream: DataFrame, interval: str, lateness: str,
                    order: Sequence[str] = ("ts",)) -> DataFrame:
    """Per interval the last sample of each operation that is running then. An operation
    without a sample in an interval has no row for it."""
    rest = [c for c in stream.columns if c != "id"]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    windows = (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", interval).alias("w"), "id")
        .agg(last.alias("_r"), F.count(F.lit(1)).alias("samples"))
    )
    return windows.filter("_r.status = 'running'").select(
        F.col("w.start").alias("window_start"), "id", "samples", "_r.*"
    )


def sessions(stream: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Runs of an operation separated by idle gaps."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), "id")
        .agg(F.count(F.lit(1)).alias("samples"))
        .select("id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                "samples")
    )


def first_seen(stream: DataFrame, keys: Sequence[str], lateness: str) -> DataFrame:
    """Files not seen before within the watermark, by e.g. size and hash. The state stays
    bounded, so a key comes out again once the watermark has passed it; where that must
    never happen, ``run_unseen`` holds the stream against all keys it has saved."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def run_unseen(stream: DataFrame, keys: Sequence[str], label: str, watch: list | None = None) -> DataFrame:
    """Run over what is there; one row of each key, over all micro-batches.

    The keys seen so far are the state of the query, dealt over its partitions by hash: a
    micro-batch looks up its own keys and reads nothing of what was written before. So the
    work is in proportion to the input, however it falls into batches, and the result's keys do
    not depend on that. The state stays as long as the keys do; ``first_seen`` bounds it.
    """
    return run_available(stream.dropDuplicates(list(keys)), "append", label, watch).drop("batch")


def not_yet_known(stream: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resume: drop files whose keys an earlier run has saved."""
    return stream.join(known.select(*keys).distinct(), list(keys), "left_anti")


def evict_finished_stream(stream: DataFrame, max_age: str, lateness: str) -> DataFrame:
    """Last event of finished operations that no event has touched for ``max_age`` of
    event time; their state is dropped when they come out (append mode).

    An event may come ``lateness`` of event time behind the newest one and still counts,
    however the input falls into micro-batches; results come out that much later.
    """
    runs = (
        stream.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", max_age).alias("w"), "id")
        .agg(F.max(F.struct("ts", "kind")).alias("_last"))
    )
    return runs.filter(F.col("_last.kind").isin("complete", "fail", "cancel")).select(
        "id", F.col("_last.ts").alias("end_time"), F.col("_last.kind").alias("kind")
    )


def _done_marks(spark: SparkSession, folder: str):
    """(is it there, put it there) for marks in the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(name: str):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return path.getFileSystem(conf), path

    def known(name: str) -> bool:
        system, path = at(name)
        return system.exists(path)

    def put(name: str) -> None:
        system, path = at(name)
        system.create(path, True).close()

    return known, put


def subscribe(
    stream: DataFrame,
    handlers: dict[str, Callable[..., None]],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand each micro-batch to the handlers by id, as handler(rows, number of the batch); '*'
    gets every row. A slow handler holds the stream back, so nothing is dropped.

    Each subscriber has a log of the batches it has taken, beside the checkpoint. When a query is
    started again after a failure, only subscribers that had not finished the batch get it again,
    under the same number; a handler that writes by number, over what is there, has every
    row exactly once. Handlers of one argument get the rows alone.
    """
    known, put = _done_marks(stream.sparkSession, f"{checkpoint.rstrip('/')}-subscribers")
    numbered = {k: len(signature(h).parameters) > 1 for k, h in handlers.items()}

    def fan_out(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for key, handle in handlers.items():
                mark = f"{md5(repr(key).encode()).hexdigest()}/{number}"
                if known(mark):
                    continue
                rows = batch if key == "*" else batch.filter(F.col("id") == key)
                handle(rows, number) if numbered[key] else handle(rows)
                put(mark)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


@contextmanager
def _state_partitions(spark: SparkSession):
    """One state store per core; the number is fixed when a stateful query first starts."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(spark.sparkContext.defaultParallelism, 1)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_available(df: DataFrame, mode: str, label: str, watch: list | None = None) -> DataFrame:
    """Run a streaming frame over what is there and return what it wrote; ``watch`` gets the
    progress of each micro-batch.

    Every micro-batch goes to its own folder, overwritten when a batch is replayed, so
    a restart neither loses nor doubles rows. ``batch`` tells updates of a key apart.
    """
    spark = df.sparkSession
    base = scratch(spark, label)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    with _state_partitions(spark):  # a query keeps the settings that it starts with
        query = (
            df.writeStream.outputMode(mode)
            .foreachBatch(store)
            .option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    if watch is not None:
        watch.extend(query.recentProgress)
    schema = StructType([*df.schema.fields, StructField("batch", LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{base}/out")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # there was no micro-batch


def last_update(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows out of the updates of ``run_available``."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return (
        updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
    )
