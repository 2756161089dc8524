"""Sharding by a k-d tree over metadata, with DataFrame functions only.

A node of the tree is split along its widest metadata dimension at the weighted median of
its bytes (or at another weighted quantile, if its number of leaves is odd) until every
node is one leaf. Medians are found by all tasks together: histograms of at most BUCKETS
buckets a node are aggregated and the bucket that holds the median is divided again. Rows
never move for it. Where many rows share a coordinate, the hash of their text and then of
their key carries on, and then a number of the row, so a hot value, a hot text and even a row
that is repeated very often are cut inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.session import cut_lineage

BUCKETS = 1 << 16
#: A cut may miss its aim by half of this share of a leaf's bytes, so as to fall between texts.
SLACK = 1 / 1024
#: Rows numbered by one task.
ROWS_PER_PIECE = 500_000
_LAST = (1 << 62) - 1


def _hash62(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def coordinate(docs: DataFrame, name: str) -> Column:
    """A dimension as long: numbers by value, strings by their first seven bytes, others by
    hash; null comes first."""
    kind = docs.schema[name].dataType
    value = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("bigint"), F.lit(-1))
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.col(f"`{name}`").try_cast("bigint"), F.lit(-1))
    return F.when(value.isNull(), F.lit(-1)).otherwise(_hash62(value))


def _value() -> Column:
    first = F.when(F.col("stage") == 0, F.col("c")[F.col("dim")]).when(F.col("stage") == 1, F.col("h"))
    return first.when(F.col("stage") == 2, F.col("i")).otherwise(F.col("tag"))


def _inside() -> Column:
    """Rows that share all coordinates that the search has already fixed."""
    return ((F.col("stage") < 1) | (F.col("c")[F.col("dim")] == F.col("c_at"))) & (
        (F.col("stage") < 2) | (F.col("h") == F.col("h_at"))) & ((F.col("stage") < 3) | (F.col("i") == F.col("i_at")))


def _left() -> Column:
    stage, edge = F.col("stage"), F.col("edge")
    places = [(F.col("c")[F.col("dim")], "c_at"), (F.col("h"), "h_at"), (F.col("i"), "i_at"), (F.col("tag"), None)]

    def before(depth: int, last: int) -> Column:
        """Whether a row comes before the edge, which stands for the coordinate of stage ``last``."""
        value, at = places[depth]
        if depth == last:
            return value < edge
        return (value < F.col(at)) | ((value == F.col(at)) & before(depth + 1, last))

    return F.when(stage == 0, before(0, 0)).when(stage == 1, before(0, 1)).when(stage == 2, before(0, 2)).otherwise(before(0, 3))


def _begin(rows: DataFrame, nodes: DataFrame, dims: int, ranges: Sequence[int]) -> DataFrame:
    """The search state of each node that is to be split: its widest dimension and aim."""
    least = [F.min(F.col("c")[d]).alias(f"lo{d}") for d in range(dims)]
    most = [F.max(F.col("c")[d]).alias(f"hi{d}") for d in range(dims)]
    stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *least, *most).join(F.broadcast(nodes), "node")
    widths = F.array(*[
        F.struct((F.col(f"hi{d}") - F.col(f"lo{d}")).cast("double") / F.lit(float(max(1, ranges[d]))), F.lit(-d))
        for d in range(dims)
    ])
    dim = -F.array_max(widths)["col2"]
    return stats.withColumn("dim", dim).select(
        "node", "leaves", "dim", F.lit(0).alias("stage"),
        F.array(*[f"lo{d}" for d in range(dims)])[F.col("dim")].alias("lo"),
        F.array(*[f"hi{d}" for d in range(dims)])[F.col("dim")].alias("hi"),
        (F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("need"),
        (F.col("bytes") / F.col("leaves") * SLACK).alias("slack"),
        F.lit(None).cast("bigint").alias("c_at"), F.lit(None).cast("bigint").alias("h_at"),
        F.lit(None).cast("bigint").alias("i_at"), F.lit(None).cast("bigint").alias("edge"),
    )


def _narrow(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One histogram pass for the nodes whose edge is not found."""
    open_ = state.filter("edge IS NULL")
    step = F.floor((F.col("hi") - F.col("lo")) / BUCKETS) + 1
    hist = (
        rows.join(F.broadcast(open_), "node").filter(_inside()).withColumn("v", _value())
        .filter("v BETWEEN lo AND hi")
        .withColumn("bucket", F.floor((F.col("v") - F.col("lo")) / step))
        .groupBy("node", "bucket")
        .agg(F.sum("size").alias("w"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("node").orderBy("bucket")
    hit = (
        hist.withColumn("sum", F.sum("w").over(upto)).alias("h")
        .join(F.broadcast(open_).alias("s"), F.expr("h.node = s.node AND sum >= need AND sum - w < need"))
        .select("h.node", F.struct("w", "sum", "v0", "v1", "n").alias("b"))
    )
    at = state.join(hit, "node")
    need = F.col("need") - F.col("b.sum") + F.col("b.w")
    one = F.col("b.v0") == F.col("b.v1")
    done = (F.col("b.w") <= F.col("slack")) | (F.col("b.n") == 1) | (one & (F.col("stage") == 3))
    deeper = one & ~done
    moved = at.select(
        "node", "leaves", "dim", (F.col("stage") + deeper.cast("int")).alias("stage"),
        F.when(deeper, F.lit(0)).otherwise(F.col("b.v0")).alias("lo"),
        F.when(deeper, F.lit(_LAST)).otherwise(F.col("b.v1")).alias("hi"),
        need.alias("need"), "slack",
        F.when(deeper & (F.col("stage") == 0), F.col("b.v0")).otherwise(F.col("c_at")).alias("c_at"),
        F.when(deeper & (F.col("stage") == 1), F.col("b.v0")).otherwise(F.col("h_at")).alias("h_at"),
        F.when(deeper & (F.col("stage") == 2), F.col("b.v0")).otherwise(F.col("i_at")).alias("i_at"),
        F.when(done, F.when(need < F.col("b.w") / 2, F.col("b.v0")).otherwise(F.col("b.v1") + 1)).alias("edge"),
    )
    return state.filter("edge IS NOT NULL").unionByName(moved)


def kd_shards(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    dims: Sequence[str] = ("lang",),
    shards: int | None = None,
    target_bytes: int = 512 << 20,
) -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes plus 1), text_crc32, shard and slot.

    ``shards`` leaves, or as many as it takes for leaves of at most ``target_bytes``. The
    dimensions are ``dims`` and the size. Leaves hold nearly equal bytes: each cut misses by
    at most half of SLACK of a leaf or half of one row. Equal texts with equal metadata stay
    together unless they weigh more than that; such a group is cut by key.

    Null texts have size 1 and count as empty; null metadata and null keys come first. Rows
    that repeat key, text and metadata are cut like any others; which of them goes where is
    of no account. An empty table gives an empty result. Slots count from 0 within a shard, without gaps.
    """
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = (F.octet_length(held) + 1).cast("bigint")
    axes = [*[coordinate(docs, d) for d in dims], (F.ln(size.cast("double")) * (1 << 20)).cast("bigint")]
    rows = cut_lineage(docs.select(
        F.col(f"`{key}`").alias("key"), size.alias("size"), F.crc32(held.cast("binary")).alias("crc"),
        F.array(*axes).alias("c"), _hash62(held).alias("h"), _hash62(F.col(f"`{key}`")).alias("i"),
        F.lit(1).cast("bigint").alias("node"), F.lit(0).alias("first"),
        F.monotonically_increasing_id().alias("tag"),
    ))
    n = len(axes)
    facts = rows.agg(
        F.count(F.lit(1)), F.sum("size"), *[F.max(F.col("c")[d]) - F.min(F.col("c")[d]) for d in range(n)]
    ).first()
    count, total, ranges = facts[0], facts[1] or 0, [x or 0 for x in facts[2:]]
    leaves = shards or max(1, -(-total // target_bytes))
    placed, fixed = rows, [c for c in rows.columns if c not in ("node", "first")]
    nodes = docs.sparkSession.range(1, 2).select(F.col("id").alias("node"), F.lit(leaves).alias("leaves"))
    # as many rows in ``nodes`` and the search state as there are leaves at most
    while leaves > 1 and count:
        state = cut_lineage(_begin(placed, nodes.filter("leaves > 1"), n, ranges))
        if state.isEmpty():
            break
        while not state.filter("edge IS NULL").isEmpty():
            state = cut_lineage(_narrow(placed, state))
        cuts = state.select("node", "leaves", "dim", "stage", "c_at", "h_at", "i_at", "edge")
        half = F.floor(F.col("leaves") / 2).cast("int")
        split = placed.join(F.broadcast(cuts), "node", "left").withColumn("left", F.coalesce(_left(), F.lit(True)))
        placed = cut_lineage(split.select(
            *fixed,
            F.when(F.col("leaves").isNull(), F.col("node"))
            .otherwise(F.col("node") * 2 + (~F.col("left")).cast("int")).alias("node"),
            (F.col("first") + F.when(F.col("left"), 0).otherwise(half)).alias("first"),
        ))
        whole = nodes.filter("leaves = 1")
        left = cuts.select((F.col("node") * 2).alias("node"), half.alias("leaves"))
        right = cuts.select((F.col("node") * 2 + 1).alias("node"), (F.col("leaves") - half).alias("leaves"))
        nodes = cut_lineage(whole.unionByName(left).unionByName(right))
    return numbered(placed.withColumnRenamed("first", "shard"), count, leaves).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )


def numbered(rows: DataFrame, count: int, shards: int, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Adds ``slot``: pieces of a shard are numbered by tasks of their own, behind the counts
    of the pieces before."""
    pieces = max(1, -(-count // (shards * rows_per_piece)))
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("i", "tag"), F.lit(pieces)).cast("int"))
    counts = dealt.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "piece").orderBy("i", "h", "key", "tag")
    inner = dealt.withColumn("place", F.row_number().over(order).cast("bigint") - 1)
    return inner.join(starts, ["shard", "piece"]).withColumn("slot", F.col("start") + F.col("place"))
