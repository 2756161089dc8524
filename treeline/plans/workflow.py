"""Chains of operators, and checks over tables of such chains."""

from __future__ import annotations

from graphlib import TopologicalSorter
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans.cycles import cycles_of, with_known
from treeline.plans.registry import Registry


def _fill(value, variables: dict[str, str]):
    """Put variables into the texts of a configuration."""
    if isinstance(value, str):
        return Template(value).substitute(variables)
    if isinstance(value, dict):
        return {k: _fill(v, variables) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(_fill(v, variables) for v in value)
    return value


def run_workflow(
    registry: Registry, spec: dict, inputs: dict[str, DataFrame]
) -> tuple[dict[str, DataFrame], list[str]]:
    """Outputs by step, and the steps skipped.

    A step is {id, type, config, inputs, depends_on, condition}; its inputs are names of
    given tables or of earlier steps. A condition is an aggregate over the first input,
    such as "count(*) > 0"; where it is not true, the step and all that depend on it are
    skipped. Conditions run a job, and so do operators that store what they read twice; all
    else stays lazy.
    """
    steps = {step["id"]: step for step in spec["steps"]}
    edges = {
        name: {d for d in [*step.get("depends_on", ()), *step.get("inputs", ())] if d not in inputs}
        for name, step in steps.items()
    }
    for name, needed in edges.items():
        unknown = needed - steps.keys()
        if unknown:
            raise ValueError(f"step {name} needs unknown {sorted(unknown)}")
    variables = {k: str(v) for k, v in spec.get("variables", {}).items()}
    outputs: dict[str, DataFrame] = {}
    skipped: list[str] = []
    for name in TopologicalSorter(edges).static_order():
        step = steps[name]
        if any(d in skipped for d in edges[name]):
            skipped.append(name)
            continue
        tables = [inputs[i] if i in inputs else outputs[i] for i in step.get("inputs", ())]
        condition = step.get("condition")
        if condition and not tables[0].agg(F.expr(_fill(condition, variables)).alias("ok")).first()["ok"]:
            skipped.append(name)
            continue
        outputs[name] = registry.run(step["type"], *tables, **_fill(step.get("config", {}), variables))
    return outputs, skipped


def validate_workflows(steps: DataFrame, dependencies: DataFrame, registry: Registry) -> DataFrame:
    """Problems (workflow, step, problem) of steps (workflow, step, type) and their
    dependencies (workflow, step, depends_on): unknown type, missing dependency, and
    steps that can never run because a cycle is before them (``workflow_cycles`` names the cycle)."""
    unknown = steps.filter(~F.col("type").isin(*registry.supported())).select(
        "workflow", "step", F.concat(F.lit("unknown type "), "type").alias("problem")
    )
    links = with_known(steps, dependencies)
    missing = links.filter("known IS NULL").select(
        "workflow", "step", F.concat(F.lit("missing dependency "), "depends_on").alias("problem")
    )
    stuck = cycles_of(links).select("workflow", "step", F.lit("cycle").alias("problem"))
    return unknown.unionByName(missing).unionByName(stuck)
