"""Content analysis: keywords, dates, classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from treeline.operators.texts import tokens
from treeline.session import cut_lineage
from treeline.skew import ROWS_PER_TASK, skew_join

DATE_PATTERN = r"\b[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\b"


#: The most frequent terms, by which a scan drops terms that cannot be among the best: a few megabytes.
FREQUENT = 1 << 16
#: Longer terms are not in that table.
_TERM_LENGTH = 64


def _likely(frequent: list[tuple[str, int]], bound: int, total: int, k: int):
    """For batches of (id, words) of whole documents the (id, term, tf) that may be among the k best.

    The score of a frequent term is known; that of another lies between those for ``bound``
    documents and for one. A term goes if k terms of its document score more for certain.
    """
    terms = pa.array([t for t, _ in frequent], pa.string())
    counts = np.array([n for _, n in frequent] + [0], "int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            coded = pc.dictionary_encode(words.flatten())
            if not len(coded):
                continue
            each = coded.dictionary
            own = pc.list_parent_indices(words).to_numpy().astype("int64") * len(each) + coded.indices.to_numpy()
            own, tf = np.unique(own, return_counts=True)
            row, term = own // len(each), own % len(each)
            at = pc.fill_null(pc.index_in(each, value_set=terms), len(terms)).to_numpy()
            spread, known = counts[at], at < len(terms)
            longer = pc.greater(pc.utf8_length(each), _TERM_LENGTH).to_numpy(zero_copy_only=False)
            least = tf * np.log(total / np.where(known, spread, np.where(longer, total, bound)))[term]
            most = tf * np.log(total / np.where(known, spread, 1))[term]
            _, first, n = np.unique(row, return_index=True, return_counts=True)
            kth = least[np.lexsort((-least, row))][first + np.minimum(n, k) - 1]
            keep = most >= np.repeat(np.where(n < k, -np.inf, kth), n) - 1e-6  # scores are rounded
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[keep])), each.take(pa.array(term[keep])), pa.array(tf[keep], pa.int64())],
                ["id", "term", "tf"])

    return run


def keywords(
    docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text",
    limit: int = ROWS_PER_TASK, frequent: int = FREQUENT,
) -> DataFrame:
    """The k terms per document with the highest tf * ln(N / df); ties by term.

    The terms of a document are counted where its text is read, and only those that may be
    among the k best are shuffled; documents of several rows are put together by their id first.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = named.count()
    repeated = cut_lineage(named.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("id").alias("_id")))
    single, many = named, None
    if not repeated.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_id"))
        single = named.join(repeated, same, "left_anti")
        many = (
            named.join(repeated, same, "left_semi")
            .select("id", F.explode(tokens("text")).alias("term"))
            .groupBy("id", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
    terms = single.select(F.explode(F.array_distinct(tokens("text"))).alias("term"))
    if many is not None:
        terms = terms.unionByName(many.select("term"))
    spread = cut_lineage(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    first = spread.filter(F.length("term") <= _TERM_LENGTH).orderBy(F.desc("df")).limit(frequent).collect()
    bound = min((r["df"] for r in first), default=total) if len(first) == frequent else 1
    schema = StructType([named.schema["id"], StructField("term", StringType()), StructField("tf", LongType())])
    counts = single.filter("text IS NOT NULL").select("id", tokens("text").alias("words")).mapInArrow(
        _likely([tuple(r) for r in first], bound, total, k), schema)
    if many is not None:
        counts = counts.unionByName(many)
    weighed = skew_join(counts, spread, ["term"], "inner", ["id"], limit, rows_per_key="df")
    score = F.round(F.col("tf") * F.log(total / F.col("df")), 9)
    # a window over the terms of one document
    best = Window.partitionBy("id").orderBy(F.desc("score"), "term")
    return (
        weighed.withColumn("score", score)
        .withColumn("rank", F.row_number().over(best).cast("bigint"))
        .filter(F.col("rank") <= k)
        .select("id", "term", "tf", "df", "score", "rank")
    )


def extract_dates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every valid calendar date written as yyyy-MM-dd or yyyy/MM/dd."""
    found = docs.select(
        F.col(id_col).alias("id"),
        F.explode(F.regexp_extract_all(text_col, F.lit(f"({DATE_PATTERN})"), F.lit(1))).alias("raw"),
    )
    iso = F.replace("raw", F.lit("/"), F.lit("-"))
    return found.withColumn("date", iso.try_cast("date")).filter("date IS NOT NULL")


def train_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", label_col: str = "quality", features: int = 1 << 16):
    """A text classifier fitted on the labelled documents."""
    rows = docs.join(labels.select(id_col, F.col(label_col).cast("double").alias("label")), id_col)
    steps = [
        HashingTF(inputCol="words", outputCol="features", numFeatures=features),
        LogisticRegression(maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=steps).fit(rows.select(tokens(text_col).alias("words"), "label"))


def classify_content(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The predicted class and its probability for every document."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("words")))
    return scored.select(
        "id",
        F.col("prediction").cast("int").alias("class"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
