"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt into blocks. A block keeps, for each dimension (term), the postings
of its non-zero weights. A query row is a sparse list of (term, weight): each of its terms
scatters weight * postings into one dense score array per query, after which a partition
selection leaves the block's k best. Blocks of queries meet all blocks of candidates, and
the block winners are merged by rank.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut_lineage

#: Rows of a candidate block and of a query block: a task holds one of each.
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 2048
#: Queries accumulated together, so that their score arrays stay in the cache.
_TOGETHER = 16


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long. Null where the vector or a component is
    null or not finite. Values beyond the range of long saturate."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    return F.when(F.exists(doubles, bad), None).otherwise(
        F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    )


def postings(matrix: np.ndarray) -> list[tuple[int, np.ndarray | slice, np.ndarray]]:
    """(term, rows, weights) of the non-zero weights of a block; ``rows`` is a slice if all
    rows have the term."""
    out = []
    for term in range(matrix.shape[1]):
        column = np.ascontiguousarray(matrix[:, term])
        rows = np.flatnonzero(column)
        if len(rows):
            out.append((term, slice(None), column) if len(rows) == len(column) else (term, rows, column[rows]))
    return out


def block_best(ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query place, candidate place, score) of each query's k best ids in one block, ties to
    the smaller id. ``ids`` ascend; of rows that share an id the best score counts, at the
    place of the first."""
    lists = postings(matrix)
    width = queries.shape[1]
    firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    names = ids[firsts]
    for start in range(0, len(queries), _TOGETHER):
        part = queries[start : start + _TOGETHER]
        scores = np.zeros((len(part), len(ids)), dtype=np.int64)
        for term, rows, weights in lists:
            if term >= width:
                break
            for q in np.flatnonzero(part[:, term]):
                scores[q, rows] += part[q, term] * weights
        if len(names) < len(ids):
            scores = np.maximum.reduceat(scores, firsts, axis=1)
        for q in range(len(part)):
            own = names != query_ids[start + q]
            places, values = np.flatnonzero(own), scores[q][own]
            if len(values) > k:
                least = np.partition(values, len(values) - k)[len(values) - k]
                above = np.flatnonzero(values > least)
                level = np.flatnonzero(values == least)[: k - len(above)]
                chosen = np.concatenate([above, level])
            else:
                chosen = np.arange(len(values))
            for c in chosen:
                yield start + q, firsts[places[c]], values[c]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(k: int):
    def run(key, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        candidates = candidates.sort_values("vec_id", kind="stable")
        width = max(candidates.q.map(len).max(), queries.q.map(len).max())
        ids, asked = candidates.vec_id.to_numpy(), queries.query_id.to_numpy()
        rows = list(block_best(ids, _matrix(candidates.q, width), asked, _matrix(queries.q, width), k))
        if not rows:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c, s = map(np.array, zip(*rows, strict=True))
        return pd.DataFrame({"query_id": asked[q], "vec_id": ids[c], "score": s.astype(np.int64)})

    return run


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest integer
    inner product for each query row, ties to the smaller id; all of them if fewer.

    ``queries`` is a predicate on the id, over the column ``vec_id``. Every row but those
    with the query's own id is a candidate. Rows whose id is null, or whose vector is null
    or holds null or non-finite components, take no part. Rows that repeat id and vector
    count once; different vectors under one id are each a candidate, and as queries
    they are answered together: the best scores over all of them, one row per candidate. Vectors of unequal length
    are compared over the shorter one's terms. An empty table gives an empty result.

    Work is rows x queries by definition; each task holds one block of either, and a
    block's winners are k rows per query.
    """
    rows = (
        vectors.select(F.col(key).cast("bigint").alias("vec_id"), quantised(vector, scale).alias("q"))
        .filter("vec_id IS NOT NULL AND q IS NOT NULL")
        .distinct()
    )
    rows = cut_lineage(rows)
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(queries, 1))).first()
    down, across = -(-n // candidates_per_block) or 1, -(-asked // queries_per_block) or 1
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one_of = lambda m: F.pmod(F.xxhash64("vec_id", "q"), F.lit(m)).cast("int")
    left = rows.withColumn("i", one_of(down)).withColumn("j", every(across))
    right = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "q", one_of(across).alias("j")).withColumn("i", every(down))
    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        _search(k), "query_id bigint, vec_id bigint, score bigint"
    )
    merged = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


