"""Connected components of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK, skew_join


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))")
    ).first()
    return tuple(row)


def _point_to_least(star: DataFrame, limit: int) -> DataFrame:
    """For rows (u, v): connect every v, and u itself, to the least of u's group."""
    least = star.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    spokes = skew_join(star, least, ["u"], "inner", ["v"], limit).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return spokes.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


#: Edges that a task handles where no node can have more than a task bears.
_EDGES_PER_TASK = 50_000


def _round(edges: DataFrame, count: int) -> DataFrame:
    """A large star and a small star of at most so many edges that any node's fit a task:
    three narrow shuffles."""
    parts = max(8, -(-count // _EDGES_PER_TASK))
    least = F.least("u", F.min("v").over(Window.partitionBy("u")))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.repartition(parts, "u").withColumn("m", least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    star = large.repartition(parts, "u").withColumn("m", least)
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return star.select(ends.alias("e")).select("e.u", "e.v").filter("u <> v").repartition(parts, "u").distinct()


def _spread_round(edges: DataFrame, limit: int) -> DataFrame:
    """The same for any number of edges; a node with very many is spread over tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = (
        skew_join(both.filter("v > u"), least, ["u"], "inner", ["v"], limit)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    return _point_to_least(large, limit).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b", limit: int = ROWS_PER_TASK) -> DataFrame:
    """(node, component) for all nodes of the pairs; the component is its least node.

    Large-star and small-star steps in turn: the edges only ever move towards the least
    neighbour and a logarithmic number of rounds is enough in practice, also for long
    chains. Edges are materialised per round. From ``limit`` edges on a node with very many
    is spread over tasks; below, no node can have more.
    """
    edges = (
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    edges = cut_lineage(edges)
    before = _mark(edges)
    while True:
        count = before[0]
        edges = cut_lineage(_round(edges, count) if count <= limit else _spread_round(edges, limit))
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
