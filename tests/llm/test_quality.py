import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import quality as Q

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, Q.learn(docs, labels)


def test_held_out_accuracy(learned):
    docs, labels, weights = learned
    got = Q.scored(docs, weights).join(labels, "doc_id").filter(Q.held_out("doc_id")).collect()
    right = [(r.score >= Q.THRESHOLD) == r.quality for r in got]
    assert len(right) > 500 and sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_those_of_the_remainder(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), Q.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_labels_do_not_matter(learned):
    docs, labels, weights = learned
    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.learn(docs, turned)
    assert all(np.array_equal(a, b) for a, b in zip(weights.all(), again.all()))


def test_whole_texts_count(learned):
    _, _, weights = learned
    clean, junk = b"The rain of the night was over. " * 9000, b"WORD!! AND!! THAT!! " * 60
    plain, behind = Q.scores(weights, [clean, clean + junk])
    assert behind < plain


def test_pieces_of_a_long_text_give_the_same_score(learned, monkeypatch):
    weights = learned[2]
    rng = np.random.default_rng(0)
    texts = [rng.integers(32, 127, n, dtype=np.uint8).tobytes() for n in (0, 1, 31, 32, 33, 1000, 4097, 20_000)]
    whole = Q.scores(weights, texts)
    monkeypatch.setattr(Q, "_TOGETHER", 512)
    assert np.allclose(whole, Q.scores(weights, texts), atol=1e-5)
    assert np.allclose(whole, [Q.scores(weights, [t])[0] for t in texts], atol=1e-5)


def test_odd_tables(spark, learned):
    weights = learned[2]
    rows = [(1, None), (2, ""), (None, "text"), (2, "x" * 300_000), (2, "x" * 300_000)]
    frame = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id bigint, text string, score double, label int")
    got = Q.scored(frame, weights).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert {r.score for r in got if r.doc_id == 1} <= {r.score for r in got if r.doc_id == 2}
    assert Q.scored(frame.limit(0), weights).count() == 0
    assert Q.kept(frame, weights).columns == frame.columns
    assert Q.kept(frame.limit(0), weights).count() == 0
    none = Q.learn(frame, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert Q.scored(frame, none).count() == len(rows)
