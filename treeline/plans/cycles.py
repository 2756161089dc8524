"""Strongly connected steps of workflows, and the steps behind them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK, hot_keys, skew_join

#: Links of one workflow that a task holds; longer workflows are taken apart over all tasks.
LINKS_PER_TASK = 200_000
#: Rows of steps and links that a task handles: tables are dealt by their rows, since the few bytes that
#: such rows take in a shuffle say little about the memory they need.
_ROWS = 500_000


def _stuck(links: list[tuple]) -> dict:
    """The steps of one workflow that stay when those without open dependencies are taken
    out again and again, each with its dependents."""
    after: dict = {}
    open_links: dict = {}
    for step, needed in links:
        after.setdefault(needed, []).append(step)
        after.setdefault(step, [])
        open_links[step] = open_links.get(step, 0) + 1
    free = deque(s for s in after if s not in open_links)
    while free:
        for step in after.pop(free.popleft()):
            open_links[step] -= 1
            if not open_links[step]:
                free.append(step)
    return after


def _cycles(after: dict) -> dict:
    """The least step of its cycle for every step that is on one.

    A walk in depth with a stack of its own; a step whose walk comes back to no earlier step
    closes the component of all that were found since.
    """
    found: dict = {}
    order: dict = {}
    low: dict = {}
    path: list = []
    done: set = set()
    for start in after:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        path.append(start)
        walk = [(start, iter(after[start]))]
        while walk:
            step, rest = walk[-1]
            for follower in rest:
                if follower not in order:
                    order[follower] = low[follower] = len(order)
                    path.append(follower)
                    walk.append((follower, iter(after[follower])))
                    break
                if follower not in done:
                    low[step] = min(low[step], order[follower])
            else:
                walk.pop()
                if walk:
                    before = walk[-1][0]
                    low[before] = min(low[before], low[step])
                if low[step] == order[step]:
                    members = [path.pop()]
                    while members[-1] != step:
                        members.append(path.pop())
                    done.update(members)
                    if len(members) > 1 or step in after[step]:
                        least = min(members)
                        found.update((m, least) for m in members)
    return found


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(workflow, step, cycle) of links that come sorted by workflow; only the rows of a
    workflow that may go on are held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        cut = pc.index(rows["workflow"], rows["workflow"][-1]).as_py()
        yield from _of_workflows(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None:
        yield from _of_workflows(held)


def _of_workflows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    graphs: dict = {}
    for workflow, step, needed in zip(*(rows[c].to_pylist() for c in ("workflow", "step", "depends_on"))):
        graphs.setdefault(workflow, []).append((step, needed))
    out = []
    for workflow, links in graphs.items():
        after = _stuck(links)
        if after:
            cycles = _cycles(after)
            out += [(workflow, step, cycles.get(step)) for step in after]
    if out:
        kinds = [rows.schema.field(c).type for c in ("workflow", "step", "step")]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["workflow", "step", "cycle"])


_LINK = ["workflow", "step", "depends_on"]


def _pass_on(links: DataFrame, marks: DataFrame, source: str, target: str, limit: int) -> DataFrame:
    """For every link, the columns of ``marks`` (workflow, node, ...) at its source, put at its target."""
    at = marks.withColumnRenamed("node", source)
    return skew_join(links, at, ["workflow", source], "inner", [target], limit).withColumnRenamed(target, "node")


def _trimmed(links: DataFrame, source: str, target: str, limit: int) -> DataFrame:
    """The links that stay when those whose source is no target are taken out again and again."""
    count = links.count()
    while count:
        ends = links.select("workflow", F.col(target).alias("node")).distinct()
        links = cut_lineage(_pass_on(links, ends, source, target, limit).withColumnRenamed("node", target).select(*_LINK))
        before, count = count, links.count()
        if count == before:
            break
    return links


def _coloured(links: DataFrame, limit: int) -> DataFrame:
    """(workflow, node, colour): the least step from which each step can be reached."""
    colours = links.select("workflow", F.col("step").alias("node"), F.col("step").alias("colour")).distinct()
    changed = colours = cut_lineage(colours)
    while not changed.isEmpty():
        told = _pass_on(links, changed, "depends_on", "step", limit).groupBy("workflow", "node").agg(F.min("colour").alias("told"))
        both = colours.join(told, ["workflow", "node"], "left").withColumn("less", F.coalesce(F.col("told") < F.col("colour"), F.lit(False)))
        both = cut_lineage(both.select("workflow", "node", F.least("colour", "told").alias("colour"), "less"))
        colours = both.drop("less")
        changed = both.filter("less").drop("less")
    return colours


def _roots(links: DataFrame, colours: DataFrame, limit: int) -> DataFrame:
    """(workflow, node, colour) of the steps that lead back to the step their colour is named by."""
    inside = _pass_on(links, colours, "depends_on", "step", limit).withColumnRenamed("node", "step").withColumnRenamed("colour", "_from")
    inside = skew_join(inside, colours.withColumnRenamed("node", "step"), ["workflow", "step"], "inner", ["depends_on"], limit)
    inside = cut_lineage(inside.filter("_from = colour").select(*_LINK, "colour"))
    fresh = reached = cut_lineage(inside.filter("depends_on = colour").select("workflow", F.col("colour").alias("node"), "colour").distinct())
    while not fresh.isEmpty():
        back = _pass_on(inside.drop("colour"), fresh, "step", "depends_on", limit).select("workflow", "node", "colour").distinct()
        fresh = cut_lineage(back.join(reached, ["workflow", "node"], "left_anti"))
        reached = cut_lineage(reached.unionByName(fresh))
    # a root is on a cycle where a link of its own colour leads to it
    closed = inside.filter("step = colour").select("workflow", "colour").distinct()
    return reached.join(closed, ["workflow", "colour"], "left_semi").select("workflow", "node", "colour")


def _over_all_tasks(links: DataFrame, limit: int) -> DataFrame:
    """The same for workflows of any length: links without an open dependency go, then those
    that lead to no cycle; of the rest every round takes out the cycles of the least steps.

    Every table has at most a row per link or step; a round of a walk is a join.
    """
    links = _trimmed(links, "depends_on", "step", limit)
    stuck = links.select("workflow", "step").distinct()
    rest = _trimmed(links, "step", "depends_on", limit)
    cycles = None
    while not rest.isEmpty():
        found = cut_lineage(_roots(rest, _coloured(rest, limit), limit))
        cycles = found if cycles is None else cycles.unionByName(found)
        gone = found.select("workflow", F.col("node").alias("step"))
        rest = rest.join(gone, ["workflow", "step"], "left_anti")
        rest = rest.join(gone.withColumnRenamed("step", "depends_on"), ["workflow", "depends_on"], "left_anti").select(*_LINK)
        rest = _trimmed(_trimmed(cut_lineage(rest), "depends_on", "step", limit), "step", "depends_on", limit)
    if cycles is None:
        return stuck.withColumn("cycle", F.lit(None).cast(stuck.schema["step"].dataType))
    return stuck.join(cycles.select("workflow", F.col("node").alias("step"), F.col("colour").alias("cycle")), ["workflow", "step"], "left")


def dealt(df: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """``df`` by hash of its keys, in tasks of about ``_ROWS`` of its ``rows`` rows."""
    return df.repartition(max(rows // _ROWS + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def with_known(steps: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The distinct links (workflow, step, depends_on), with ``known`` true where the workflow
    has the step that is needed and null where not; written once, as they are read more often."""
    on = ["workflow", "depends_on"]
    rows = steps.count() + dependencies.count()
    known = dealt(steps.select("workflow", F.col("step").alias("depends_on")), rows, on).distinct().withColumn("known", F.lit(True))
    hot = None
    if rows > ROWS_PER_TASK:  # steps that very many wait for
        hot = cut_lineage(hot_keys(dealt(dependencies.select(*on), rows, on), on, ROWS_PER_TASK))
    if hot is None or hot.isEmpty():
        links = dealt(dependencies.select(*_LINK), rows, on).distinct().join(known, on, "left")
    else:
        links = dealt(dependencies.select(*_LINK), rows, _LINK).distinct()
        links = skew_join(links, known, on, "left", ["step"], hot=hot)
    return cut_lineage(links.select(*_LINK, "known"))


def workflow_cycles(
    steps: DataFrame, dependencies: DataFrame, links_per_task: int = LINKS_PER_TASK, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """(workflow, step, cycle) of the steps that can never run.

    ``cycle`` is the least step of the cycle (the strongly connected steps) that a step is
    on, null for a step that only waits for one. Links to steps that their workflow does
    not have count as nothing here, and so do links with a null. Repeated rows count once.

    A task handles many workflows, one after the other, in time linear in their links; a
    workflow of more than ``links_per_task`` links is taken apart over all tasks instead,
    with a round for each step of its longest walk.
    """
    return cycles_of(with_known(steps, dependencies), links_per_task, limit)


def cycles_of(checked: DataFrame, links_per_task: int = LINKS_PER_TASK, limit: int = ROWS_PER_TASK) -> DataFrame:
    """The same from links as ``with_known`` returns them."""
    links = checked.filter("known AND step IS NOT NULL").select(*_LINK)
    rows = links.count()
    sizes = dealt(links.select("workflow"), rows, ["workflow"]).groupBy("workflow").agg(F.count(F.lit(1)).alias("n"))
    long = sizes.filter(F.col("n") > links_per_task).select("workflow")
    kinds = links.schema
    schema = StructType([kinds["workflow"], kinds["step"], StructField("cycle", kinds["step"].dataType)])
    some = not long.isEmpty()
    short = links.join(long, "workflow", "left_anti").select(*_LINK) if some else links
    found = dealt(short, rows, ["workflow"]).sortWithinPartitions("workflow").mapInArrow(_in_order, schema)
    if not some:
        return found
    return found.unionByName(_over_all_tasks(cut_lineage(links.join(long, "workflow", "left_semi").select(*_LINK)), limit))
