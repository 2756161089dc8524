"""Exact similarity joins and nearest neighbours over unit vectors.

Vectors are split into cells around pivots. A vector visits another cell only if the
plane between the two pivots is within its search radius, which loses no pair: a
partner on the other side of the plane is at least as far away as the plane itself.
Each cell is cut into blocks of bounded size. A pair of blocks meets in one task, which
multiplies them tile by tile, and only results leave. How many cells a vector has to visit
depends on the data; the pivots only steer the cost. Vectors move as they were given, once
for each block that they have to meet; blocks are large, so that this is seldom.

Equal vectors are collapsed first: a group of copies is one row with its count.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut_lineage

ROWS_PER_BLOCK = 32768
#: Rows of either side that a task multiplies at once; a tile of results has 32 MB.
_TILE = 2048
#: Blocks that the vectors make at least, if they fill so many tiles, so that all cores have work.
_LEAST_BLOCKS = 8
#: Cells are at most so many; beyond MAX_PIVOTS * rows_per_cell vectors the cells grow. The
#: distances between all pivots (128 MB) are held by the driver and by each task.
MAX_PIVOTS = 4096
ROWS_PER_CELL = 16384
#: Visits of a piece of a batch when cells are looked up: a few MB.
_VISITS = 1 << 19
_SLACK = 1e-6


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, copies): one row per distinct vector, named by its least id. Written
    once, because pivots, block sizes and both sides of the comparison read it. Floats stay
    floats, which are half as large; they are computed with as doubles."""
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")
    return cut_lineage(
        vectors.select(F.col(id_col).alias("id"), vec.alias("vec"))
        .groupBy("vec")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .select("id", "vec", "copies")
    )


def _unit(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows of a matrix, of length 1 each."""
    if not len(column):
        return np.zeros((0, 1))
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _pick_pivots(vecs: DataFrame, count: int, rows_per_cell: int) -> np.ndarray:
    """At most MAX_PIVOTS vectors, by a hash of the id."""
    wanted = min(MAX_PIVOTS, max(1, count // rows_per_cell))
    rows = vecs.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    return _unit(pa.array([r["vec"] for r in rows], pa.list_(pa.float64()))) if rows else np.zeros((1, 1))


def _placed(vecs: DataFrame, pivots: np.ndarray, radius: float | str, upward: bool) -> DataFrame:
    """(id, copies, vec, home, cells): each vector with its own cell and with all cells within its
    radius, the own one too. ``upward`` visits only cells with a higher number than the own one."""
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    near_zero = between < 1e-12
    step = max(1, _VISITS // len(pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step))
        for piece in pieces:
            unit = _unit(piece["vec"])
            squares = np.maximum(2 - 2 * unit @ pivots.T, 0)
            home = squares.argmin(axis=1)
            nearest = squares[np.arange(len(home)), home]
            gap = between[home]
            with np.errstate(divide="ignore", invalid="ignore"):
                to_plane = (squares - nearest[:, None]) / (2 * gap)
            to_plane[near_zero[home]] = 0.0
            reach = piece[radius].to_numpy(zero_copy_only=False)[:, None] if isinstance(radius, str) else radius
            go = to_plane <= reach + _SLACK
            go[np.arange(len(home)), home] = True
            if upward:
                go &= np.arange(len(pivots))[None, :] >= home[:, None]
            ends = np.concatenate([[0], go.sum(axis=1).cumsum()]).astype(np.int32)
            cells = pa.ListArray.from_arrays(ends, pa.array(np.nonzero(go)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [piece["id"], piece["copies"], piece["vec"], pa.array(home.astype(np.int32)), cells],
                ["id", "copies", "vec", "home", "cells"])

    kinds = {c: vecs.schema[c].dataType.simpleString() for c in ("id", "vec")}
    # read for the sizes of cells and for both sides of the comparison
    return cut_lineage(vecs.mapInArrow(place, f"id {kinds['id']}, copies bigint, vec {kinds['vec']}, home int, cells array<int>"))


def _side(rows: pa.Table, resident: bool) -> tuple[np.ndarray, ...]:
    """(ids, copies, vectors, whether at home) of one side, by id, so that ties go to the lower one."""
    own = rows.filter(rows["resident"] if resident else pc.invert(rows["resident"])).sort_by("id")
    vecs = own["vec"].combine_chunks()
    vecs = vecs if isinstance(vecs, pa.Array) else pa.concat_arrays(vecs.chunks)
    return own["id"].to_numpy(), own["copies"].to_numpy(), _unit(vecs), own["at_home"].to_numpy()


def _blocks(
    placed: DataFrame, cells: Column, work: Callable, names: list[str], schema: str, count: int, block_rows: int
) -> DataFrame:
    """Run ``work(visitors, residents)``, sides as ``_side`` returns them, on every pair of blocks
    of every cell that ``cells`` names; it yields columns."""
    block_rows = min(block_rows, max(_TILE, -(-count // _LEAST_BLOCKS)))
    visits = placed.select(F.explode(cells).alias("cell"), "home")
    sizes = (
        visits.groupBy("cell").agg(F.count(F.lit(1)).alias("nv"))
        .join(placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("nh")), "cell")
        .select(
            "cell",
            F.ceil(F.col("nv") / block_rows).cast("int").alias("v_blocks"),
            F.ceil(F.col("nh") / block_rows).cast("int").alias("h_blocks"),
        )
    )
    sizes = F.broadcast(sizes)  # a row per cell, of which there are at most MAX_PIVOTS

    def block_of(blocks: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    visitors = placed.select("id", "copies", "vec", "home", F.explode(cells).alias("cell")).join(sizes, "cell").select(
        "cell", block_of("v_blocks").alias("vb"), every("h_blocks").alias("hb"),
        F.lit(False).alias("resident"), "id", "copies", "vec", (F.col("cell") == F.col("home")).alias("at_home"),
    )
    residents = placed.select("id", "copies", "vec", F.col("home").alias("cell")).join(sizes, "cell").select(
        "cell", every("v_blocks").alias("vb"), block_of("h_blocks").alias("hb"),
        F.lit(True).alias("resident"), "id", "copies", "vec", F.lit(True).alias("at_home"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        visiting, resident = _side(rows, False), _side(rows, True)
        if len(visiting[0]) and len(resident[0]):
            kind = rows.schema.field("id").type
            for columns in work(visiting, resident):
                ids, rest = columns[:2], columns[2:]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, kind) for x in ids), *map(pa.array, rest)], names)

    return visitors.unionByName(residents).groupBy("cell", "vb", "hb").applyInArrow(run, schema)


def similar_pairs(
    vectors: DataFrame,
    threshold: float = 0.85,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = ROWS_PER_BLOCK,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """All pairs (a < b) of distinct vectors with cosine >= threshold, once each, with
    the number of copies of either side. Ids may be of any type that has an order."""
    vecs = distinct_vectors(vectors, id_col, vec_col)
    count = vecs.count()
    pivots = _pick_pivots(vecs, count, rows_per_cell)
    radius = float(np.sqrt(max(2 - 2 * threshold, 0)))
    placed = _placed(vecs, pivots, radius, upward=True)

    def verify(visiting: tuple, resident: tuple) -> Iterator[tuple]:
        (ids_l, copies_l, left, home), (ids_r, copies_r, right, _) = visiting, resident
        for at, to in itertools.product(range(0, len(ids_l), _TILE), range(0, len(ids_r), _TILE)):
            cosines = left[at : at + _TILE] @ right[to : to + _TILE].T
            i, j = np.nonzero(cosines >= threshold)
            # within a cell every pair meets twice, and every vector itself
            good = ~home[at + i] | (ids_l[at + i] < ids_r[to + j])
            if good.any():
                i, j = i[good], j[good]
                a, b, n, m = ids_l[at + i], ids_r[to + j], copies_l[at + i], copies_r[to + j]
                turn = a > b
                yield np.where(turn, b, a), np.where(turn, a, b), cosines[i, j], np.where(turn, m, n), np.where(turn, n, m)

    kind = vecs.schema["id"].dataType.simpleString()
    names = ["a", "b", "similarity", "copies_a", "copies_b"]
    schema = f"a {kind}, b {kind}, similarity double, copies_a bigint, copies_b bigint"
    return _blocks(placed, F.col("cells"), verify, names, schema, count, block_rows)


def top_k_neighbors(
    vectors: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = ROWS_PER_BLOCK,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """The k most similar other distinct vectors of each distinct vector, exactly.

    The own cell gives k neighbours and with them a radius; only cells within that
    radius are visited then. Ties go to the lower id.
    """
    vecs = distinct_vectors(vectors, id_col, vec_col)
    count = vecs.count()
    pivots = _pick_pivots(vecs, count, rows_per_cell)

    def nearest(visiting: tuple, resident: tuple) -> Iterator[tuple]:
        (ids_l, _, left, _), (ids_r, _, right, _) = visiting, resident
        if k < 1:
            return
        for at in range(0, len(ids_l), _TILE):
            ids, rows = ids_l[at : at + _TILE], left[at : at + _TILE]
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # row, place at the right, score
            least = np.full(len(ids), -np.inf)  # the k-th best score of each row so far
            for to in range(0, len(ids_r), _TILE):
                cosines = rows @ right[to : to + _TILE].T
                cosines[ids[:, None] == ids_r[None, to : to + _TILE]] = -np.inf
                some = min(k, cosines.shape[1])
                here = least if np.isfinite(least).all() else np.maximum(least, np.partition(cosines, -some, axis=1)[:, -some] if some == k else -np.inf)
                i, j = np.nonzero((cosines >= here[:, None]) & np.isfinite(cosines))
                row, place, score = (np.concatenate(x) for x in zip(best, (i, to + j, cosines[i, j])))
                order = np.lexsort((place, -score, row))
                row, place, score = row[order], place[order], score[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                keep = nth < k
                best = row[keep], place[keep], score[keep]
                full = nth == k - 1
                least[row[full]] = score[full]
            if len(best[0]):
                yield ids[best[0]], ids_r[best[1]], best[2]

    kind = vecs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, neighbor {kind}, similarity double"
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor")

    def top(found: DataFrame) -> DataFrame:
        # at most k rows per id and block
        return found.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)

    names = ["id", "neighbor", "similarity"]
    at_home = _placed(vecs, pivots, 0.0, upward=False)
    local = top(_blocks(at_home, F.array("home"), nearest, names, schema, count, block_rows)).drop("rank")
    if len(pivots) == 1:
        return top(local)
    local = cut_lineage(local)  # read for the radius and for the result
    # the distance of the k-th neighbour so far; 2 spans the whole sphere
    reach = local.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.greatest(2 - 2 * F.min("similarity"), F.lit(0.0))))
        .otherwise(2.0).alias("reach")
    )
    with_reach = vecs.join(reach, "id", "left").withColumn(
        "reach", F.coalesce("reach", F.lit(2.0))
    )
    placed = _placed(with_reach, pivots, "reach", upward=False)
    others = F.array_remove("cells", F.col("home"))
    away = _blocks(placed, others, nearest, names, schema, count, block_rows)
    return top(local.unionByName(away))


def similarity_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Groups out of pairs (a, b, similarity) and (node, component): size, least and mean
    similarity of the edges."""
    by_edge = pairs.join(members.select(F.col("node").alias("a"), "component"), "a")
    edges = by_edge.groupBy("component").agg(
        F.min("similarity").alias("similarity"), F.avg("similarity").alias("confidence"),
        F.count(F.lit(1)).alias("pairs"),
    )
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    return sizes.join(edges, "component")
