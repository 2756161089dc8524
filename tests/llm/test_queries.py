"""The registered queries against their SQL, and the pipeline against a plain one."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_exact_dedup import expected
from tests.llm.test_ngram_join import brute
from tests.llm.test_secret_ledger import spans
from tests.oracle import compare, connect
from treeline.llm import quality
from treeline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
#: Columns that each query's contract names; more may follow.
CONTRACT = {
    1: "doc_id keep_id group_size kept text_sha256", 2: "doc_id n_assign n_access n_hex base_sha256 spans",
    3: "query_id rank vec_id score", 4: "doc_id size text_crc32 law shard slot grown_shard",
    5: "doc_id held_out score predicted", 6: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    7: "doc_id n_shingles component_id", 8: "page_id url text n_chars", 9: "doc_id n_tokens ids_sha256 decoded_sha256",
    10: "doc_id families findings", 11: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    13: "doc_id piece start length ids_crc32 sequence_id offset",
}


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    held = []

    def run(session, folder):
        held.append(QUERIES[name](session, folder))
        return held[0]

    ok, message, _ = compare(spark, connect(SF_DIR), name, run, ORACLES.get(name), SF_DIR)
    assert ok, message
    df = held[0]
    assert set(CONTRACT[int(name[2:].split("_")[0])].split()) <= set(df.columns)
    keys = [c for c in ("doc_id", "page_id") if c in df.columns]
    if keys and "offset" not in df.columns:
        given = spark.read.parquet(f"{SF_DIR}/{'pages' if 'page_id' in keys else 'documents'}.parquet")
        assert int(message.split()[0]) == given.count()


def test_pipeline_against_a_plain_one(spark, monkeypatch):
    """Each stage on what the one before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram jaccard join", "secret scans", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == names
        kept.append([(r.doc_id, r.text, r.n_chars) for r in docs.collect()])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert sum(labels.get(i, 1) == 1 for i, _, _ in kept[0]) >= 0.97 * len(kept[0])
    distinct = expected([(i, t) for i, t, _ in kept[0]])
    assert sorted(i for i, _, _ in kept[1]) == sorted(min(v) for v in distinct.values())
    groups = brute([(i, t) for i, t, _ in kept[1]], 5, 80, 100)
    assert sorted(i for i, _, _ in kept[2]) == sorted(i for i, _, c in groups if i == c)
    before = {i: t for i, t, _ in kept[2]}
    for i, t, n in kept[3]:
        assert n == len(t) and not spans(t)
        assert (t == before[i]) == (not spans(before[i])) or re.search("eyJ|BEGIN", before[i])
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in kept[3]}
    totals = {}
    for r in got:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert all(totals[r.doc_id] == r.doc_tokens for r in got)


def test_pipeline_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_rejected_documents_go(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.scored(docs, quality.learn(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))).collect()}
    good = corpus_pipeline.good_documents(spark, docs, SF_DIR)
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
