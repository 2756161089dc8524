"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import exact_dedup, ngram_join, packing, quality, secret_ledger
from treeline.llm.queries import table, tokenizer
from treeline.session import prepare, scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, fitted on the labels, does not reject."""
    weights = quality.learn(docs, table(prepare(spark), sf_dir, "labels"))
    return quality.kept(docs, weights)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    prepare(spark)
    return exact_dedup.without_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one with the smallest id."""
    prepare(spark)
    return ngram_join.one_of_each(docs, words=5, num=80, den=100)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    prepare(spark)
    return secret_ledger.masked(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    prepare(spark)
    return packing.packed_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram jaccard join", dissimilar_documents),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL cannot express a fitted network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
