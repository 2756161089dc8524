"""The trie of all conversations' prefixes, rolled up in bands of depth.

1. Turns are numbered within their conversation and become digests; texts go no further.
2. A conversation is cut into bands of ``height`` turns. Digests are chained within a band,
   and the bands' own chains are chained in the same way, band above band, until one band
   holds all. So every prefix has an id of its own after a logarithmic number of rounds, and
   no task ever holds more than ``height`` turns of a conversation at once.
3. Equal bands collapse before anything is exploded; prefixes of one id are one node.
4. Rollup: a node explodes only to its ancestors within its band. What hangs below a band's
   last nodes comes from the tree of those nodes, which is rolled up first, by the same
   bands, one level higher. Explosion is bounded by ``height``, rounds by the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.tokens import named
from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK, running, skew_join

#: Turns in a band.
HEIGHT = 8
#: One part of a list of members spans so many bits of conversation ids.
SPAN_BITS = 16


def _digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _root() -> Column:
    return _digest(F.lit(b"no turn"))


def numbered_turns(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """conv, at (1, 2, ... by ``order``, null first), digest and bytes of each turn.

    Null roles and texts count as empty. Turns of one place are ordered by the SHA-256 of the
    role's length in bytes, a colon, role and text; equal rows count each. Rows without a
    key belong to no conversation and are left out. A conversation of more than ``limit``
    turns is numbered in pieces. ``bytes`` is the length of the text in UTF-8.
    """
    said, words = F.coalesce(named(role), F.lit("")), F.coalesce(named(text), F.lit(""))
    held = turns.filter(named(key).isNotNull()).select(
        named(key).cast("bigint").alias("conv"), named(order).alias("place"),
        F.unhex(F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, words), 256)).alias("digest"),
        F.octet_length(words).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("tag"))
    counted = running(cut_lineage(held), ["conv"], ["place", "digest", "tag"], {"at": ("sum", F.lit(1))}, limit)
    return counted.select("conv", "at", "digest", "bytes")


def _bands(steps: DataFrame, depth: int, height: int) -> list[DataFrame]:
    """For steps (conv, at, digest, bytes, full): the bands of all levels, lowest first:
    conv, band, root (id of what stands before it), ids, bytes and full of its steps."""
    one = F.struct("at", "digest", "bytes", "full")
    held = steps.groupBy("conv", F.expr(f"(at - 1) DIV {height}").alias("band")).agg(F.array_sort(F.collect_list(one)).alias("steps"))
    chained = F.aggregate(
        "steps", F.array().cast("array<binary>"),
        lambda done, step: F.array_append(
            done, _digest(F.concat(F.coalesce(F.get(done, F.size(done) - 1), F.lit(b"")), step["digest"]))))
    held = cut_lineage(held.select("conv", "band", chained.alias("chain"), F.col("steps.bytes").alias("bytes"), F.col("steps.full").alias("full")))
    if depth <= height:
        joined, above = held.withColumn("root", _root()).withColumn("upto", F.lit(None).cast("binary")), []
    else:
        ends = held.select(
            "conv", (F.col("band") + 1).alias("at"), F.element_at("chain", -1).alias("digest"), F.lit(0).cast("bigint").alias("bytes"),
            (F.size("chain") == height).alias("full"))
        above = _bands(ends, -(-depth // height), height)
        each = above[0].select("conv", "band", "root", "ids", F.posexplode("ids").alias("i", "upto")).select(
            "conv", (F.col("band") * height + F.col("i")).alias("band"), "upto",
            F.when(F.col("i") == 0, F.col("root")).otherwise(F.get("ids", F.col("i") - 1)).alias("root"))
        joined = held.join(each, ["conv", "band"])
    ids = F.transform("chain", lambda link, i: F.when(
        (i == height - 1) & F.col("upto").isNotNull(), F.col("upto")).otherwise(_digest(F.concat("root", link))))
    # without more levels the only band may be full as well
    return [cut_lineage(joined.select("conv", "band", "root", ids.alias("ids"), "bytes", "full")), *above]


def _distinct_steps(bands: DataFrame) -> DataFrame:
    """Equal bands as one, exploded to their steps, each with its path within the band."""
    alike = bands.groupBy("band", "root", "ids", "bytes", "full").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"))
    return alike.select("*", F.posexplode("ids").alias("i", "node")).select(
        "node", "root", "conv", "n", "band", "i", F.slice("ids", F.lit(1), F.col("i") + 1).alias("path"),
        F.when(F.col("i") == 0, F.col("root")).otherwise(F.get("ids", F.col("i") - 1)).alias("parent"),
        F.get("bytes", F.col("i")).alias("bytes"), F.get("full", F.col("i")).alias("full"))


def _subtotals(nodes: DataFrame, above: list[DataFrame], values: list[str], height: int) -> DataFrame:
    """(node, sums of ``values`` over its subtree) for nodes (node, root, path, values)."""
    if above:
        hanging = nodes.groupBy("root").agg(*[F.sum(v).alias(v) for v in values])
        ends = _distinct_steps(above[0]).filter("full").select("node", "root", "path").dropDuplicates(["node"])
        ends = ends.join(hanging.withColumnRenamed("root", "node"), "node", "left").fillna(0, values)
        below = _subtotals(cut_lineage(ends), above[1:], values, height)
        added = nodes.join(below.select("node", *[F.col(v).alias(f"below_{v}") for v in values]), "node", "left")
        nodes = added.select("path", *[(F.col(v) + F.coalesce(f"below_{v}", F.lit(0))).alias(v) for v in values])
    exploded = nodes.select(F.explode("path").alias("node"), *values)
    return exploded.groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


def prefix_trie(turns: DataFrame, conversations: DataFrame, height: int = HEIGHT, limit: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of the trie of ``turns`` (conv, at, digest, bytes).

    ``conversations`` has all ids once (conv), also those without a turn. Nodes: node (id),
    conv_id (its smallest member), depth, parent_conv_id (the parent's; of the root null),
    n_convs, n_children, n_leaves (childless nodes in its subtree) and saved_bytes (over its
    subtree, of each node one time less the bytes of its last text than it has members).
    Members: node, part and convs, an ascending array of the conversations that end there;
    the parts of a node follow each other and span at most 65,536 ids each. A node's text is that of
    its conversation ``conv_id`` at ``depth``.

    Without conversations there is no node, not even a root. A node with more than ``limit``
    children is spread over tasks where its children look it up.
    """
    total = conversations.agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")).first()
    depth = turns.agg(F.max("at")).first()[0] or 0
    levels = _bands(turns.withColumn("full", F.lit(True)), depth, height)
    steps = _distinct_steps(levels[0])
    nodes = cut_lineage(steps.groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.first(F.col("band") * height + F.col("i") + 1).alias("depth"),
        *[F.first(c).alias(c) for c in ("root", "parent", "path", "bytes")]))
    children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    nodes = cut_lineage(nodes.join(children, "node", "left").fillna(0, ["n_children"]).withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_bytes": (F.col("n_convs") - 1) * F.col("bytes")}))
    sums = _subtotals(nodes, levels[1:], ["n_leaves", "saved_bytes"], height)
    # all children of the root have the same parent, which nobody needs to look up
    parents = nodes.filter("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("siblings"))
    inner = nodes.drop("n_leaves", "saved_bytes", "path", "root", "bytes")
    deep = skew_join(inner.filter("depth > 1"), parents, ["parent"], "inner", ["node"], limit, rows_per_key="siblings").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
    first = inner.filter("depth = 1").select(
        "node", "conv_id", "depth", F.lit(total.least).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children")
    below = nodes.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_bytes"), F.lit(0)).alias("saved_bytes"))
    root = below.select(
        _root().alias("node"), F.lit(total.least).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(total.n).cast("bigint").alias("n_convs"),
        "n_children", "n_leaves", "saved_bytes").filter(F.lit(total.n > 0))
    out = deep.unionByName(first).join(sums, "node").unionByName(root)
    last = levels[0].groupBy("conv").agg(F.max_by(F.element_at("ids", -1), "band").alias("node"))
    held = conversations.select("conv").join(last, "conv", "left").withColumn("node", F.coalesce("node", _root()))
    members = held.groupBy("node", F.shiftright("conv", SPAN_BITS).alias("part")).agg(F.array_sort(F.collect_list("conv")).alias("convs"))
    return out, members


def joined_digests(parts: DataFrame) -> DataFrame:
    """node and sha256: the lowercase digest of all its ids in order, joined by commas.

    The parts of a node pass one task, one after the other; none is held longer than that.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            nodes, found = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node != now:
                    if now is not None:
                        nodes.append(now)
                        found.append(state.hexdigest())
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "sha256"])

    spelled = F.array_join(F.transform("convs", lambda c: c.cast("string")), ",")
    ordered = parts.select("node", spelled.alias("text"), "part").repartition("node").sortWithinPartitions("node", "part")
    return ordered.select("node", "text").mapInArrow(run, "node binary, sha256 string")
