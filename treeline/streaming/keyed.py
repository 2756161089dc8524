"""Streams with state of their own per operation: it leaves when it is no longer needed, and
timers report on operations that are silent."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeline.operators.telemetry import SETS_STATUS, TOGGLES

_ENDS = ("complete", "fail", "cancel")
_NONE = -(1 << 62)
#: Groups that ids are dealt into. A call of the function handles a whole group, since a call
#: for each id takes far longer than its events do; it rewrites the states of its group.
GROUPS = 1280
#: Windows that one row of a report stands for at most, until Spark writes them out.
RUN = 4096


def _places(order: Sequence[str]) -> list[Column]:
    """The place of each row, microseconds first."""
    return [(F.unix_micros(c) if c == "ts" else F.col(c)).cast("bigint") for c in order]


def _grouped(stream: DataFrame, lateness: str, *rest: str | Column) -> DataFrame:
    """group, id (as text), ts and ``rest``."""
    group = F.pmod(F.xxhash64("id"), F.lit(GROUPS)).cast("int")
    return stream.withWatermark("ts", lateness).select(
        group.alias("group"), F.col("id").cast("string").alias("id"), "ts", *rest)


def _held(state: GroupState) -> dict:
    """The states of a group's ids, which may be null."""
    return {key: rest for key, *rest in json.loads(state.get[0])} if state.exists else {}


def _hold(state: GroupState, held: dict, timers: list[int]) -> None:
    """Keep the states of a group's ids and wake up for the first of their timers."""
    if held:
        state.update((json.dumps([[key, *rest] for key, rest in held.items()]),))
        if timers:
            state.setTimeoutTimestamp(max(min(timers), state.getCurrentWatermarkMs()))
    elif state.exists:
        state.remove()


def retained_status(
    stream: DataFrame, max_age: timedelta, lateness: str, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Life cycle per id from events (id, ts, kind), with state that leaves (update mode): id,
    status, events, end_us and evicted.

    Two marks per id are kept, as in ``live_status``, so events may come in any order within
    ``lateness``. Once event time has passed the end of a finished operation by ``max_age``, its
    last row comes out again with ``evicted`` and its state goes; an event under the same
    id begins a new operation. Running and paused operations stay. ``order`` are whole numbers and ``ts``.
    """
    age = max_age // timedelta(milliseconds=1)

    def later(mark: list | None, place: list, kind: str) -> list:
        return mark if mark and mark[0] >= place else [place, kind]

    def status_of(last_set: list | None, last_toggle: list | None) -> str:
        if last_set is None:
            return "pending"
        at, kind = last_set
        if kind == "start" and last_toggle:
            toggled, how = last_toggle
            if toggled > at and how == "pause":
                return "paused"
        return SETS_STATUS[kind]

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state)  # by id: last set, last toggle, end, count, when it is to leave
        now = state.getCurrentWatermarkMs()
        touched: dict = {}
        for rows in batches:
            for key, place, kind in zip(rows["id"], rows["place"], rows["kind"]):
                of = touched.get(key)
                if of is None:
                    of = touched[key] = held.get(key) or [None, None, None, 0, None]
                of[3] += 1
                if kind in SETS_STATUS:
                    place = json.loads(place)
                    of[0] = later(of[0], place, kind)
                    if kind in _ENDS:
                        of[2] = max(of[2] or 0, place[0])
                elif kind in TOGGLES:
                    of[1] = later(of[1], json.loads(place), kind)
        out = []
        for key, of in list(held.items()):
            if key not in touched and of[4] is not None and of[4] < now:
                out.append((key, status_of(of[0], of[1]), of[3], of[2], True))
                del held[key]
        for key, of in touched.items():
            status = status_of(of[0], of[1])
            over = status not in ("pending", "running", "paused")
            of[4] = max(of[2] // 1000 + age, now + 1) if over else None
            out.append((key, status, of[3], of[2] if over else _NONE, False))
        held.update(touched)
        _hold(state, held, [of[4] for of in held.values() if of[4] is not None])
        if out:
            yield pd.DataFrame(out, columns=["id", "status", "events", "end_us", "evicted"])

    given = _grouped(stream, lateness, F.to_json(F.array(*_places(order))).alias("place"), "kind")
    found = given.groupBy("group").applyInPandasWithState(
        run, "id string, status string, events bigint, end_us bigint, evicted boolean",
        "held string", "update", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("id", F.col("id").cast(stream.schema["id"].dataType)).withColumn(
        "end_us", F.when(F.col("end_us") != _NONE, F.col("end_us")))


def _reported(running: np.ndarray, due: np.ndarray, step: int, done: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of reports up to the interval end ``done``, and the samples that run on after it.

    ``running`` has the ids, times and next interval ends of last samples that run, ``due`` the
    later samples by id and place, with the status last. A run is id, end of its first interval,
    samples in that, time of its sample and number of intervals; only the first one has samples.
    """
    ends = due[:, 1] // step * step + step
    # the last sample of each id and interval
    last = np.flatnonzero(np.append((np.diff(due[:, 0]) != 0) | (np.diff(ends) != 0), True)[: len(due)])
    ids = np.concatenate([running[:, 0], due[last, 0]])
    starts = np.concatenate([running[:, 2], ends[last]])
    times = np.concatenate([running[:, 1], due[last, 1]])
    counts = np.concatenate([np.zeros(len(running), "int64"), np.diff(last, prepend=-1)])
    runs = np.concatenate([np.ones(len(running), bool), due[last, -1] == 1])
    by_time = np.lexsort((np.arange(len(ids)), starts, ids))
    ids, starts, times, counts, runs = (x[by_time] for x in (ids, starts, times, counts, runs))
    newest = np.append(np.diff(ids) != 0, True)[: len(ids)]
    until = np.where(newest, done + step, np.append(starts[1:], 0)[: len(ids)])
    found = np.column_stack([ids, starts, counts, times, (until - starts) // step])
    on = runs & newest
    rest = np.column_stack([ids, times, np.maximum(starts, done + step)])[on]
    return found[runs & (until > starts)], rest


def _rows(found: np.ndarray, names: list, step: int) -> pd.DataFrame:
    """Runs as rows, of at most ``RUN`` windows each."""
    pieces = -(-found[:, 4] // RUN)
    found = np.repeat(found, pieces, axis=0)
    before = (np.arange(len(found)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
    return pd.DataFrame({
        "window_us": found[:, 1] + (before - 1) * step, "id": np.array(names, object)[found[:, 0]],
        "samples": np.where(before == 0, found[:, 2], 0), "last_us": found[:, 3],
        "windows": np.minimum(found[:, 4] - before, RUN),
    })


def running_report(
    stream: DataFrame, interval: timedelta, lateness: str, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """For every interval one row per operation that is running at its end, also if it was
    silent (append mode): window_us, id, samples (in the interval) and last_us.

    ``stream`` has id, ts and status. A row comes when event time has passed the interval's end
    by ``lateness``. State holds the last sample of each operation that is running, and the
    samples of intervals that are still open. Samples without a time are in no interval.

    The state of a group is its ids and two tables of numbers, which are handled as a whole.
    Intervals without a sample leave the function as one row, however many they are.
    """
    step = interval // timedelta(microseconds=1)
    places = [f"place{i}" for i in range(len(order))]

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, running, waiting = [], np.empty((0, 3), "int64"), np.empty((0, len(places) + 2), "int64")
        if state.exists:
            held, *tables = state.get
            names = json.loads(held)
            running, waiting = (np.frombuffer(t, "int64").reshape(-1, x.shape[1]) for t, x in zip(tables, (running, waiting)))
        number = {name: i for i, name in enumerate(names)}
        fresh = []
        for rows in batches:
            ids = np.array([number.setdefault(name, len(number)) for name in rows["id"]], "int64")
            fresh.append(np.column_stack([ids, *(rows[c].to_numpy("int64") for c in (*places, "status"))]))
        names, known = list(number), len(waiting)
        waiting = np.concatenate([waiting, *fresh])
        passed = max(state.getCurrentWatermarkMs(), 0) * 1000
        done = passed // step * step

        # ids with new samples, and those whose next interval has ended
        ends = waiting[:, 1] // step * step + step
        following = np.full(len(names), np.iinfo("int64").max)
        following[running[:, 0]] = running[:, 2]
        np.minimum.at(following, waiting[:, 0], ends)
        active = following < passed
        active[waiting[known:, 0]] = True

        due, now = active[waiting[:, 0]] & (ends <= done), active[running[:, 0]]
        taken, waiting, ends = waiting[due], waiting[~due], ends[~due]
        taken = taken[np.lexsort(taken.T[::-1])]  # by id, place and status
        found, rest = _reported(running[now], taken, step, done)
        running = np.concatenate([running[~now], rest])

        if len(running) or len(waiting):
            kept = np.union1d(running[:, 0], waiting[:, 0])
            running[:, 0], waiting[:, 0] = (np.searchsorted(kept, x[:, 0]) for x in (running, waiting))
            state.update((json.dumps([names[i] for i in kept]), running.tobytes(), waiting.tobytes()))
            first = int(min(np.concatenate([running[:, 2], ends])))
            state.setTimeoutTimestamp(max(first // 1000, 1, state.getCurrentWatermarkMs()))
        elif state.exists:
            state.remove()
        if len(found):
            yield _rows(found, names, step)

    # of samples at one place the last by status counts; a null comes first
    numbers = [F.coalesce(p, F.lit(-(1 << 63))).alias(c) for p, c in zip(_places(order), places)]
    status = F.when(F.col("status") == "running", 1).when(F.col("status") > "running", 2).otherwise(0)
    given = _grouped(stream.filter("ts IS NOT NULL"), lateness, *numbers, status.alias("status"))
    found = given.groupBy("group").applyInPandasWithState(
        run, "window_us bigint, id string, samples bigint, last_us bigint, windows bigint",
        "ids string, running binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("windows") - 1))
    return found.withColumn("nth", nth).select(
        (F.col("window_us") + F.col("nth") * step).alias("window_us"),
        F.col("id").cast(stream.schema["id"].dataType).alias("id"),
        F.when(F.col("nth") == 0, F.col("samples")).otherwise(F.lit(0).cast("bigint")).alias("samples"), "last_us")
