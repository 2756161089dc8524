import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm.topk import block_best, postings, top_k

SCHEMA = "vec_id bigint, embedding array<float>, score int, rank int, q int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in vectors], SCHEMA)


def brute(vectors, k, asked):
    usable = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for q in sorted({i for i, _ in usable if asked(i)}):
        scores = {}
        for i, v in usable:
            for j, w in usable:
                if i == q and j != q:
                    s = sum(a * b for a, b in zip(v, w))
                    scores[j] = max(scores.get(j, s), s)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, j, s) for r, (j, s) in enumerate(best)]
    return out


@pytest.mark.parametrize("per_block", [7, 4096])
def test_against_brute_force(spark, per_block):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 6) / 4]) for i in range(120)]  # many ties
    vectors += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6),
                (204, [1.0, 2.0]), (205, []), (3, vectors[3][1]), (10, [0.5] * 6)]
    got = top_k(frame(spark, vectors), F.col("vec_id") % 5 == 0, k=4, candidates_per_block=per_block, queries_per_block=per_block)
    assert sorted(map(tuple, got.collect())) == brute(vectors, 4, lambda i: i % 5 == 0)


def test_fewer_candidates_than_asked(spark):
    got = top_k(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [3.0])]), F.col("vec_id") == 0, k=5)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512)]
    assert top_k(frame(spark, [(0, [1.0])]), F.col("vec_id") == 0).count() == 0


def test_empty_table(spark):
    assert top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_postings_hold_non_zero_weights():
    matrix = np.array([[1, 0, 2], [3, 0, 0]])
    lists = postings(matrix)
    assert [t for t, _, _ in lists] == [0, 2]
    assert lists[1][1].tolist() == [0] and lists[1][2].tolist() == [2]
    best = list(block_best(np.array([4, 9]), matrix, np.array([1]), np.array([[1, 5, 1]]), 1))
    assert [tuple(map(int, b)) for b in best] == [(0, 0, 3)]


@pytest.mark.parametrize("per_block", [7, 4096])
def test_many_good_vectors_of_one_id(spark, per_block):
    """One id on a third of all rows, whose vectors all score higher than any other's."""
    vectors = [(i, [1.0, i / 64]) for i in range(40)] + [(500, [9.0 + i / 64, 9.0]) for i in range(20)]
    got = top_k(frame(spark, vectors), F.col("vec_id") % 10 == 0, k=4, candidates_per_block=per_block, queries_per_block=per_block)
    assert sorted(map(tuple, got.collect())) == brute(vectors, 4, lambda i: i % 10 == 0)


def test_a_block_keeps_the_best_ids():
    ids, matrix = np.array([2, 5, 5, 5, 7]), np.array([[1], [9], [8], [7], [3]])
    best = block_best(ids, matrix, np.array([1, 5]), np.array([[1], [1]]), 2)
    assert sorted((int(q), int(ids[c]), int(s)) for q, c, s in best) == [(0, 5, 9), (0, 7, 3), (1, 2, 1), (1, 7, 3)]
