"""Queries on progress telemetry, in batch and as a stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from treeline.catalog.data import (INCREMENTS_SQL, KIND_SQL, ORDER, SAMPLES_SQL, increments, kind_column,
                                   life_events, query, samples, table)
from treeline.functions import labels
from treeline.operators import telemetry
from treeline.session import scratch
from treeline.streaming import keyed, progress

_SPEED_SQL = SAMPLES_SQL + """, firsts AS (SELECT *, first(us) OVER w AS us0, first(items) OVER w AS items0 FROM samples
  WINDOW w AS (PARTITION BY id ORDER BY us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
speeds AS (SELECT *, CASE WHEN us = us0 THEN 0 ELSE trunc((items - items0) / ((us - us0) / 1e6::DOUBLE))::BIGINT END AS speed
  FROM firsts)"""


@query("progress_speed", f"WITH {_SPEED_SQL} SELECT id, event_id, items, speed FROM speeds")
def _(spark, sf_dir):
    return telemetry.speed(samples(spark, sf_dir), ORDER).select("id", "event_id", "items", "speed")


@query("progress_eta", f"""WITH {_SPEED_SQL} SELECT id, event_id, CASE WHEN total_items = 0 OR items >= total_items
  OR speed = 0 THEN NULL ELSE trunc((total_items - items) / speed)::BIGINT END AS eta,
  round(items / total_items * 100, 6) AS pct FROM speeds""")
def _(spark, sf_dir):
    timed = telemetry.eta(telemetry.speed(samples(spark, sf_dir), ORDER))
    return timed.select("id", "event_id", "eta", F.round(labels.percent("items", "total_items"), 6).alias("pct"))


@query("instant_rate", f"""WITH {SAMPLES_SQL}, prev AS (SELECT *, lag(us) OVER w AS us0, lag(items) OVER w AS i0,
  lag(bytes) OVER w AS b0 FROM samples WINDOW w AS (PARTITION BY id ORDER BY us, event_id))
  SELECT id, event_id, CASE WHEN us > us0 AND items > i0 THEN round((items - i0) / ((us - us0) / 1e6::DOUBLE), 6) ELSE 0 END AS items_per_sec,
  CASE WHEN us > us0 AND bytes > b0 THEN round((bytes - b0) / ((us - us0) / 1e6::DOUBLE), 6) ELSE 0 END AS bytes_per_sec FROM prev""")
def _(spark, sf_dir):
    rates = telemetry.instant_rate(samples(spark, sf_dir), ORDER)
    return rates.select("id", "event_id", F.round("items_per_sec", 6).alias("items_per_sec"),
                        F.round("bytes_per_sec", 6).alias("bytes_per_sec"))


@query("running_totals", f"WITH {SAMPLES_SQL} SELECT id, event_id, items, bytes FROM samples")
def _(spark, sf_dir):
    done = telemetry.running_totals(increments(spark, sf_dir), ORDER)
    return done.select("id", "event_id", "items", "bytes")


@query("latest_snapshot", f"""WITH {SAMPLES_SQL} SELECT id, us, event_id, items, bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY us DESC, event_id DESC) AS rn FROM samples) WHERE rn = 1""")
def _(spark, sf_dir):
    last = telemetry.latest_snapshot(samples(spark, sf_dir), ORDER)
    return last.select("id", F.unix_micros("ts").alias("us"), "event_id", "items", "bytes")


@query("step_progress", """SELECT user_id AS id, event_id, coalesce(sum(CASE WHEN event_type IN ('view', 'purchase') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT
    AS steps_completed, coalesce(last_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_type END IGNORE NULLS) OVER w, 'Initializing') AS current_step
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "ts", "event_id",
        F.when(F.col("event_type").isin("view", "purchase"), F.col("event_type")).alias("step"),
    )
    return telemetry.step_progress(steps, ORDER).select("id", "event_id", "steps_completed", "current_step")


# The life cycle step by step, as a recursive fold over each operation's events.
_FOLD_SQL = f"""WITH RECURSIVE ev AS (SELECT user_id AS id, event_id, epoch_us(ts) AS us, {KIND_SQL} AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold AS (
  SELECT id, 0::BIGINT AS n, 'pending' AS status, NULL::BIGINT AS start_us, NULL::BIGINT AS end_us, NULL::BIGINT AS event_id
  FROM (SELECT DISTINCT id FROM ev)
  UNION ALL
  SELECT f.id, e.n, CASE e.kind WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed'
      WHEN 'pause' THEN CASE WHEN f.status = 'running' THEN 'paused' ELSE f.status END
      ELSE CASE WHEN f.status = 'paused' THEN 'running' ELSE f.status END END,
    CASE WHEN e.kind = 'start' THEN e.us ELSE f.start_us END,
    CASE WHEN e.kind = 'start' THEN NULL WHEN e.kind IN ('complete', 'fail') THEN e.us ELSE f.end_us END, e.event_id
  FROM fold f JOIN ev e ON e.id = f.id AND e.n = f.n + 1),
ops AS (SELECT id, status, start_us, end_us, n AS events FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS rn FROM fold) WHERE rn = 1)"""


def _ops(spark, sf_dir):
    return telemetry.life_cycle(life_events(spark, sf_dir), ORDER)


@query("op_lifecycle", _FOLD_SQL + " SELECT id, status, start_us, end_us, events FROM ops")
def _(spark, sf_dir):
    return _ops(spark, sf_dir).select(
        "id", "status", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "events"
    )


@query("status_history", _FOLD_SQL + " SELECT id, event_id, status FROM fold WHERE n > 0")
def _(spark, sf_dir):
    return telemetry.status_history(life_events(spark, sf_dir), ORDER).select("id", "event_id", "status")


_TYPES = ("cleanup", "deduplication", "consolidation", "ownership")
_TYPE_SQL = "(['cleanup', 'deduplication', 'consolidation', 'ownership'])[id % 4 + 1]"


def _typed_ops(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in _TYPES])
    return _ops(spark, sf_dir).withColumn("operation_type", F.element_at(names, (F.col("id") % 4 + 1).cast("int")))


@query("operation_stats", _FOLD_SQL + f""", typed AS (SELECT *, {_TYPE_SQL} AS operation_type FROM ops)
  SELECT status, operation_type, count(*) AS operations FROM typed GROUP BY GROUPING SETS ((), (status), (operation_type))""")
def _(spark, sf_dir):
    return telemetry.operation_stats(_typed_ops(spark, sf_dir))


@query("evict_finished", _FOLD_SQL + """ SELECT id, status FROM ops WHERE NOT coalesce(status NOT IN ('running', 'paused')
  AND end_us < epoch_us(TIMESTAMP '2024-01-30') - 86400000000, false)""")
def _(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    return telemetry.evict_finished(_ops(spark, sf_dir), now, timedelta(days=1)).select("id", "status")


def _errors(spark, sf_dir):
    failures = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return failures.select(F.col("user_id").alias("id"), "ts", "event_id",
                           F.concat(F.lit("error "), "props").alias("error"))


@query("error_summary", """SELECT user_id AS id, count(*) AS error_count, arg_max('error ' || props, (ts, event_id)) AS latest_error
  FROM events WHERE event_type = 'error' GROUP BY 1""")
def _(spark, sf_dir):
    return telemetry.error_summary(_errors(spark, sf_dir), ORDER)


@query("error_list", """SELECT user_id AS id, event_id, 'error ' || props AS error,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'error'""")
def _(spark, sf_dir):
    return telemetry.error_list(_errors(spark, sf_dir), ORDER).select("id", "event_id", "error", "position")


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "ts", "event_id",
        F.when(F.col("event_type").isin("view", "purchase"), F.col("event_type")).alias("step"))


def _progress(spark, sf_dir):
    ops = _ops(spark, sf_dir).drop("events")
    return telemetry.progress_record(ops, samples(spark, sf_dir), _steps(spark, sf_dir), _errors(spark, sf_dir), ORDER)


_PROGRESS_SQL = _FOLD_SQL + ", " + _SPEED_SQL + """,
lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us DESC, event_id DESC) AS rn FROM speeds) WHERE rn = 1),
marks AS (SELECT user_id AS id, count(*) FILTER (event_type IN ('view', 'purchase')) AS steps_completed,
  coalesce(arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('view', 'purchase')), 'Initializing') AS current_step,
  count(*) FILTER (event_type = 'error') AS error_count, arg_max('error ' || props, (ts, event_id)) FILTER (event_type = 'error') AS error,
  arg_min('error ' || props, (ts, event_id)) FILTER (event_type = 'error') AS first_error FROM events GROUP BY 1),
prog AS (SELECT o.id, o.status, o.start_us, o.end_us, current_step, steps_completed, items AS items_processed, total_items,
  bytes AS bytes_processed, speed, CASE WHEN total_items = 0 OR items >= total_items OR speed = 0 THEN NULL
    ELSE trunc((total_items - items) / speed)::BIGINT END AS estimated_eta, error, error_count, first_error
  FROM ops o JOIN lasts USING (id) JOIN marks USING (id))"""


@query("progress_record", _PROGRESS_SQL + """ SELECT id, status, start_us, end_us, current_step, steps_completed, items_processed, total_items,
  bytes_processed, speed, estimated_eta, error, error_count FROM prog""")
def _(spark, sf_dir):
    found = _progress(spark, sf_dir)
    times = [F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us")]
    return found.select(*times, *[c for c in found.columns if c not in ("start_time", "end_time")])


@query("operation_result", _PROGRESS_SQL + """, planned AS (SELECT user_id AS id, count(*) AS items_affected, sum(trunc(value * 1000)::BIGINT)::BIGINT AS bytes_affected
    FROM events WHERE event_type <> 'error' GROUP BY 1)
  SELECT p.id, status, round((end_us - start_us) / 1e6::DOUBLE, 6) AS duration, items_processed, bytes_processed,
    coalesce(items_affected, 0) AS items_affected, coalesce(bytes_affected, 0) AS bytes_affected, error_count AS errors, first_error
  FROM prog p LEFT JOIN planned USING (id)""")
def _(spark, sf_dir):
    plan = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").cast("string").alias("source_path"),
        F.when(F.col("event_type") == "error", "skipped").otherwise("changed").alias("status"),
        (F.col("value") * 1000).cast("bigint").alias("size"))
    found = telemetry.operation_result(_progress(spark, sf_dir), plan, _errors(spark, sf_dir), ORDER)
    return found.withColumn("duration", F.round("duration", 6)).drop("start_time", "end_time")


# ---- streams over the events file


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = progress.read_stream(spark, sf_dir, schema, "events.parquet")
    return raw.select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type",
        kind_column().alias("kind"), (F.col("value") * 1000).cast("bigint").alias("items"),
    )


@query("stream_progress", """SELECT user_id AS id, epoch_us(ts) AS us, event_id, trunc(value * 1000)::BIGINT AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, sf_dir):
    state = progress.progress_state(_stream(spark, sf_dir).select("id", "ts", "event_id", "items"), ORDER)
    now = progress.last_update(progress.run_available(state, "update", "progress"), ["id"])
    return now.select("id", F.unix_micros("ts").alias("us"), "event_id", "items")


@query("stream_lifecycle", _FOLD_SQL + " SELECT id, status, events FROM ops")
def _(spark, sf_dir):
    status = progress.live_status(_stream(spark, sf_dir), ORDER)
    return progress.last_update(progress.run_available(status, "update", "status"), ["id"]).select("id", "status", "events")


@query("stream_report", """WITH w AS (SELECT date_trunc('day', ts) AS day, user_id AS id, count(*) AS samples,
    arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY 1, 2)
  SELECT strftime(day, '%Y-%m-%d') AS day, id, samples FROM w
  WHERE last_type IN ('signup', 'click')
    AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, sf_dir):
    running = F.when(F.col("kind").isin("start", "resume"), "running").otherwise("idle")
    stream = _stream(spark, sf_dir).select("id", "ts", "event_id", running.alias("status"))
    report = progress.periodic_report(stream, "1 day", "1 hour", ORDER)
    out = progress.run_available(report, "append", "report")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "id", "samples")


_SESSIONS_SQL = """marked AS (SELECT user_id AS id, ts, event_type, event_id, CASE WHEN lag(ts) OVER w IS NULL
    OR ts >= lag(ts) OVER w + INTERVAL {gap} THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY ts, event_id) AS run FROM marked),
runs AS (SELECT id, run, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS samples,
  arg_max(event_type, (ts, event_type)) AS last_type FROM numbered GROUP BY id, run)"""


@query("stream_sessions", f"""WITH {_SESSIONS_SQL.format(gap="6 HOUR")} SELECT id, epoch_us(first_ts) AS start_us, samples FROM runs
  WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, sf_dir):
    runs = progress.sessions(_stream(spark, sf_dir).select("id", "ts"), "6 hours", "1 hour")
    out = progress.run_available(runs, "append", "sessions")
    return out.select("id", F.unix_micros("session_start").alias("start_us"), "samples")


@query("stream_evict", f"""WITH {_SESSIONS_SQL.format(gap="12 HOUR")} SELECT id, epoch_us(last_ts) AS end_us,
    CASE last_type WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind FROM runs
  WHERE last_type IN ('purchase', 'error') AND last_ts + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events)""")
def _(spark, sf_dir):
    gone = progress.evict_finished_stream(_stream(spark, sf_dir).select("id", "ts", "kind"), "12 hours", "0 seconds")
    out = progress.run_available(gone, "append", "evicted")
    return out.select("id", F.unix_micros("end_time").alias("end_us"), "kind")


def _late_stream(spark, sf_dir):
    """The events in four lots of a quarter of the time each, one per micro-batch. Every
    seventh event is in the lot after its own, so it comes late."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    own = F.floor((F.unix_micros("ts") - first) * 4 / (last - first + 1))
    folder = scratch(spark, "late")
    parts = events.withColumn("_file", F.least(own + (F.col("event_id") % 7 == 0).cast("int"), F.lit(3)))
    files = events.rdd.getNumPartitions()  # dealt in turn, so none is empty
    for number in range(4):  # in the order in which the stream is to see them
        parts.filter(F.col("_file") == number).drop("_file").repartition(files).write.mode("append").parquet(folder)
    raw = progress.read_stream(spark, folder, events.schema, "*.parquet", files_per_trigger=files)
    return raw.select(F.col("user_id").alias("id"), "ts", "event_id", "event_type", kind_column().alias("kind"))


@query("stream_evict_late", f"""WITH {_SESSIONS_SQL.format(gap="12 HOUR")}, span AS (SELECT max(ts) - min(ts) AS d, max(ts) AS newest FROM events)
  SELECT id, epoch_us(last_ts) AS end_us, CASE last_type WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind FROM runs, span
  WHERE last_type IN ('purchase', 'error')
    AND epoch_us(last_ts + INTERVAL 12 HOUR) <= epoch_us(newest) - (epoch_us(newest) - epoch_us(newest - d)) // 2000000 * 1000000""")
def _(spark, sf_dir):
    # no event comes later than two quarters of the time behind the newest
    span = table(spark, sf_dir, "events").agg(F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).first()[0]
    gone = progress.evict_finished_stream(
        _late_stream(spark, sf_dir).select("id", "ts", "kind"), "12 hours", f"{span // 2_000_000} seconds")
    out = progress.run_available(gone, "append", "evicted-late")
    return out.select("id", F.unix_micros("end_time").alias("end_us"), "kind")


# Operations of one user and day, each with events in any of the four lots.
_DAY_FOLD_SQL = _FOLD_SQL.replace("SELECT user_id AS id, event_id", "SELECT user_id || '-' || strftime(ts, '%j') AS id, event_id").replace(
    "PARTITION BY user_id", "PARTITION BY user_id, strftime(ts, '%j')")
_LATE_MS_SQL = """(SELECT epoch_us(max(ts)) // 1000 - (epoch_us(max(ts)) - epoch_us(min(ts))) // 2000000 * 1000 FROM events)"""


def _lateness(spark, sf_dir):
    span = table(spark, sf_dir, "events").agg(F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).first()[0]
    return f"{span // 2_000_000} seconds"


@query("stream_lifecycle_retained", _DAY_FOLD_SQL + f""" SELECT id, status, events, CASE WHEN status IN ('completed', 'failed') THEN end_us END AS end_us,
    coalesce(status IN ('completed', 'failed') AND end_us // 1000 + 86400000 < {_LATE_MS_SQL}, false) AS evicted FROM ops""")
def _(spark, sf_dir):
    """State of finished operations leaves; the last update of each is what a batch would say."""
    events = _late_stream(spark, sf_dir).withColumn("id", F.concat("id", F.lit("-"), F.date_format("ts", "DDD")))
    status = keyed.retained_status(events, timedelta(days=1), _lateness(spark, sf_dir), ORDER)
    updates = progress.run_available(status, "update", "retained")
    return progress.last_update(updates, ["id"])


_SIX_HOURS = 6 * 3600 * 1_000_000


@query("stream_report_all", f"""WITH ev AS (SELECT user_id AS id, epoch_us(ts) AS us, arg_max(event_type, event_id) AS kind, count(*) AS n FROM events GROUP BY 1, 2),
  ids AS (SELECT id, min(us) AS first_us FROM ev GROUP BY id),
  ticks AS (SELECT unnest(generate_series((SELECT min(us) // {_SIX_HOURS} * {_SIX_HOURS} + {_SIX_HOURS} FROM ev), (SELECT max(us) FROM ev), {_SIX_HOURS})) AS tick),
  grid AS (SELECT id, tick FROM ids JOIN ticks ON tick > first_us WHERE tick // 1000 < {_LATE_MS_SQL}),
  met AS (SELECT g.id, g.tick, e.us, e.kind FROM grid g ASOF JOIN ev e ON g.id = e.id AND g.tick > e.us)
  SELECT tick - {_SIX_HOURS} AS window_us, id, coalesce((SELECT sum(n) FROM ev WHERE ev.id = met.id AND ev.us >= tick - {_SIX_HOURS} AND ev.us < tick), 0)::BIGINT AS samples,
    us AS last_us FROM met WHERE kind IN ('signup', 'click')""")
def _(spark, sf_dir):
    """Every running operation in every interval, silent ones too, with late samples."""
    running = F.when(F.col("kind").isin("start", "resume"), "running").otherwise("idle")
    stream = _late_stream(spark, sf_dir).select("id", "ts", "event_id", running.alias("status"))
    report = keyed.running_report(stream, timedelta(hours=6), _lateness(spark, sf_dir), ORDER)
    return progress.run_available(report, "append", "report-all").drop("batch")


@query("stream_dedup", "SELECT DISTINCT user_id AS id, event_type FROM events")
def _(spark, sf_dir):
    # several micro-batches, with watermarks between them
    events = _late_stream(spark, sf_dir).select("id", "event_type")
    return progress.run_unseen(events, ["id", "event_type"], "unseen")


@query("stream_resume", """SELECT event_id FROM events WHERE (user_id, event_type) NOT IN (
  SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-02')""")
def _(spark, sf_dir):
    known = table(spark, sf_dir, "events").filter(F.col("ts") < F.to_timestamp(F.lit("2024-01-02"))).select(
        F.col("user_id").alias("id"), "event_type")
    fresh = progress.not_yet_known(_stream(spark, sf_dir).select("id", "event_type", "event_id"), known, ["id", "event_type"])
    return progress.run_available(fresh.select("event_id"), "append", "resume").select("event_id")


@query("stream_subscribe", """SELECT 'every' AS subscriber, count(*) AS received FROM events
  UNION ALL SELECT 'user 8', count(*) FROM events WHERE user_id = 8""")
def _(spark, sf_dir):
    base = scratch(spark, "subscribers")

    def keep(name):  # by the batch's number, over what an attempt before has left
        return lambda rows, number: rows.select("event_id").write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")

    run = progress.subscribe(_stream(spark, sf_dir), {"*": keep("every"), 8: keep("one")}, f"{base}/state")
    run.awaitTermination()
    counts = [
        spark.read.schema("event_id bigint").parquet(f"{base}/{folder}").agg(F.count(F.lit(1)).alias("received"))
        .select(F.lit(name).alias("subscriber"), "received")
        for folder, name in (("every", "every"), ("one", "user 8"))
    ]
    return counts[0].unionByName(counts[1])
