"""Cycles of workflows against a plain search, by single tasks and over all tasks."""

import random

from treeline.plans import cycles
from treeline.plans.cycles import workflow_cycles

_STEPS, _LINKS = "workflow string, step string", "workflow string, step string, depends_on string"


def _plain(steps, links):
    known = set(steps)
    links = {(w, s, d) for w, s, d in links if None not in (w, s, d) and (w, d) in known}
    back = {(w, s): {d for v, t, d in links if (v, t) == (w, s)} for w, s, _ in links}
    grown = True
    while grown:
        grown = False
        for (w, s), seen in back.items():
            more = set().union(*[back.get((w, d), set()) for d in seen]) - seen
            grown |= bool(more)
            seen |= more
    least = {(w, s): min(d for d in seen if s in back.get((w, d), ())) for (w, s), seen in back.items() if s in seen}
    return sorted(((w, s, least.get((w, s))) for (w, s), seen in back.items() if any((w, d) in least for d in seen)), key=str)


def _random(seed, workflows):
    pick = random.Random(seed)
    steps, links = [], []
    for w in range(workflows):
        n = pick.randint(1, 12)
        steps += [(f"w{w}", f"s{i}") for i in range(n)]
        links += [(f"w{w}", f"s{pick.randrange(n)}", f"s{pick.randrange(n + 1)}") for _ in range(pick.randint(0, 2 * n))]
    return steps, links


def _found(spark, steps, links, **how):
    found = workflow_cycles(spark.createDataFrame(steps, _STEPS), spark.createDataFrame(links, _LINKS), **how)
    assert found.columns == ["workflow", "step", "cycle"]
    return sorted(map(tuple, found.collect()), key=str)


def test_by_single_tasks(spark):
    steps, links = _random(1, 300)
    assert _found(spark, steps + steps, links + links) == _plain(steps, links)


def test_over_all_tasks(spark):
    # two cycles in a row, the second behind a step of the least name; a step that waits for itself; a hot step
    links = [("x", "b", "c"), ("x", "c", "b"), ("x", "a", "c"), ("x", "d", "a"), ("x", "e", "d"), ("x", "d", "e"), ("x", "f", "e"),
             ("y", "s", "s"), ("y", "t", "s"), ("z", "v", "u")] + [("x", f"h{i}", "b") for i in range(12)]
    steps = [(w, s) for w, s in dict.fromkeys((w, s) for w, s, _ in links)] + [("z", "u")]
    more_steps, more_links = _random(2, 6)
    steps, links = steps + more_steps, links + more_links
    got = _found(spark, steps, links, links_per_task=0, limit=3)
    assert got == _plain(steps, links)
    assert ("x", "e", "d") in got and ("x", "a", None) in got and ("y", "s", "s") in got


def test_long_and_short_workflows_together(spark):
    ring = [("r", f"s{i:02}", f"s{(i + 1) % 20:02}") for i in range(20)]
    steps, links = _random(3, 20)
    steps, links = steps + [(w, s) for w, s, _ in ring], links + ring + [("r", "tail", "s07")]
    assert _found(spark, steps, links, links_per_task=18) == _plain(steps, links)


def test_a_chain_longer_than_a_walk_on_the_stack(spark):
    n = 20_000
    links = [("c", f"s{i + 1}", f"s{i}") for i in range(n - 1)] + [("c", "s0", "s5"), ("d", "s1", "s0")]
    steps = [("c", f"s{i}") for i in range(n)] + [("d", "s0"), ("d", "s1")]
    got = _found(spark, steps, links)
    assert len(got) == n and sum(r[2] == "s0" for r in got) == 6


def test_nulls_and_nothing(spark):
    links = [(None, "a", "a"), ("w", None, "a"), ("w", "a", None), ("w", "a", "gone"), ("w", "b", "b")]
    assert _found(spark, [("w", "a"), ("w", "b"), (None, "a"), ("w", None)], links) == [("w", "b", "b")]
    assert _found(spark, [], []) == [] == _found(spark, [], [], links_per_task=0)


def test_tasks_hold_a_limited_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(cycles, "_ROWS", 20)
    steps, links = _random(4, 200)
    given = spark.createDataFrame(steps, _STEPS), spark.createDataFrame(links, _LINKS)
    checked = cycles.with_known(*given)
    assert checked.rdd.getNumPartitions() >= (len(steps) + len(links)) // 20
    found = cycles.cycles_of(checked)
    assert found.rdd.getNumPartitions() >= checked.filter("known").count() // 20
    assert sorted(map(tuple, found.collect()), key=str) == _plain(steps, links)


def test_a_step_that_very_many_wait_for(spark, monkeypatch):
    monkeypatch.setattr(cycles, "ROWS_PER_TASK", 10)
    steps, links = _random(5, 30)
    steps, links = steps + [("hub", f"s{i}") for i in range(60)], links + [("hub", f"s{i}", "s0") for i in range(60)] + [("hub", "s0", "gone")]
    assert _found(spark, steps, links + links) == _plain(steps, links)
