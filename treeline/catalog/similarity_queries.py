"""Queries on similar vectors, signatures and texts, and on content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from treeline.catalog.data import query, spread, table
from treeline.functions.columns import once
from treeline.operators import content, signatures, texts, vectors
from treeline.operators.components import components
from treeline.session import cut_lineage

_VEC_SQL = """reps AS (SELECT min(vec_id) AS id, count(*) AS copies, embedding::DOUBLE[] AS v FROM embeddings GROUP BY embedding),
cos AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS similarity, a.copies AS copies_a, b.copies AS copies_b
  FROM reps a JOIN reps b ON a.id < b.id)"""
# Connected components by spreading the least label along the edges.
_COMPONENTS_SQL = """edges AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT u AS node, u AS seen FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.seen = e.u),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
_THRESHOLD = 0.35


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _pairs(spark, sf_dir):
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), _THRESHOLD)


@query("similar_pairs", f"""WITH {_VEC_SQL} SELECT a, b, round(similarity, 6) AS similarity, copies_a, copies_b
  FROM cos WHERE similarity >= {_THRESHOLD}""")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query("top_k_neighbors", f"""WITH {_VEC_SQL}, both_ways AS (SELECT a AS id, b AS neighbor, similarity FROM cos
    UNION ALL SELECT b, a, similarity FROM cos)
  SELECT id, neighbor, round(similarity, 6) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor) AS rank FROM both_ways) WHERE rank <= 3""")
def _(spark, sf_dir):
    near = vectors.top_k_neighbors(table(spark, sf_dir, "embeddings"), 3)
    return near.select("id", "neighbor", F.round("similarity", 6).alias("similarity"), "rank")


@query("similarity_groups", f"""WITH RECURSIVE {_VEC_SQL}, pairs AS (SELECT a, b, similarity FROM cos WHERE similarity >= 0.4),
  {_COMPONENTS_SQL} SELECT component, members, pairs, round(similarity, 6) AS similarity, round(confidence, 6) AS confidence FROM
    (SELECT component, count(*) AS members FROM comp GROUP BY 1) JOIN
    (SELECT component, count(*) AS pairs, min(similarity) AS similarity, avg(similarity) AS confidence
     FROM pairs JOIN comp ON a = node GROUP BY 1) USING (component)""")
def _(spark, sf_dir):
    pairs = cut_lineage(vectors.similar_pairs(table(spark, sf_dir, "embeddings"), 0.4))
    groups = vectors.similarity_groups(pairs, components(pairs))
    return groups.select("component", "members", "pairs", F.round("similarity", 6).alias("similarity"),
                         F.round("confidence", 6).alias("confidence"))


# Letters whose counts make a 64-value vector of a text.
_CELLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,"
_COUNTS_SQL = "[" + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in _CELLS) + "]"


def _letter_counts(batches):
    """(id, how often each of _CELLS is in the text), in one pass over the bytes: all are ASCII."""
    places = np.frombuffer(_CELLS.encode(), np.uint8)
    for batch in batches:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        counts = [np.bincount(np.frombuffer(t or b"", np.uint8), minlength=256)[places] for t in texts]
        flat = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ends = pa.array(np.arange(0, len(flat) + 1, len(places)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))], ["id", "v"])


_BANDS_SQL = ", ".join(
    f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN v[{16 * n} + i] < v[({16 * n} + i) % 64 + 1] THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS s{n}"
    for n in range(4)
)


@query("hamming_pairs", f"""WITH vecs AS (SELECT doc_id, {_COUNTS_SQL} AS v FROM documents),
  sig AS (SELECT doc_id, {_BANDS_SQL} FROM vecs),
  reps AS (SELECT min(doc_id) AS id, count(*) AS copies, s0, s1, s2, s3 FROM sig GROUP BY s0, s1, s2, s3)
  SELECT * FROM (SELECT a.id AS a, b.id AS b, (bit_count(xor(a.s0, b.s0)) + bit_count(xor(a.s1, b.s1)) + bit_count(xor(a.s2, b.s2))
    + bit_count(xor(a.s3, b.s3)))::BIGINT AS distance, a.copies AS copies_a, b.copies AS copies_b FROM reps a JOIN reps b ON a.id < b.id)
  WHERE distance <= 3""")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    kind = docs.schema["id"].dataType.simpleString()
    counted = docs.mapInArrow(_letter_counts, f"id {kind}, v array<bigint>")
    signed = once(counted, s=signatures.difference_signature("v")).select("id", "s.*")
    found = signatures.hamming_pairs(signed, 3)
    return found.withColumn("distance", F.col("distance").cast("bigint"))


@query("average_signatures", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_sum(embedding::DOUBLE[]) AS total FROM embeddings)
  SELECT vec_id, """ + ", ".join(
    f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN e[{16 * n} + i] > total / 64 THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS s{n}"
    for n in range(4)) + " FROM v")
def _(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vecs.select("vec_id", signatures.average_signature("v").alias("s")).select("vec_id", "s.*")


def _product_sql(values: str, first: str, step: int, frequency: str) -> str:
    return " + ".join(f"{values}[{first} + {step * x} + 1] * cs[({frequency}) * 8 + {x} + 1]" for x in range(8))


@query("phash_signatures", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, [" + ", ".join(f"{c!r}::DOUBLE" for c in signatures.COSINES)
       + f"""] AS cs FROM embeddings),
  r AS (SELECT vec_id, cs, list_transform(range(0, 64), lambda i: {_product_sql("e", "i // 8 * 8", 1, "i % 8")}) AS t FROM v),
  c AS (SELECT vec_id, list_transform(range(0, 64), lambda i: {_product_sql("t", "i % 8", 8, "i // 8")}) AS t FROM r),
  m AS (SELECT vec_id, t, (list_sort(t)[32] + list_sort(t)[33]) / 2 AS median FROM c)
  SELECT vec_id, """ + ", ".join(
    f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN t[{16 * n} + i] > median THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS s{n}"
    for n in range(4)) + " FROM m")
def _(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vecs.select("vec_id", signatures.frequency_signature("v").alias("s")).select("vec_id", "s.*")


_TEXT_SQL = """words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda w: w <> '') AS w FROM documents),
named AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS copies FROM words),
sh AS (SELECT DISTINCT doc_id, copies, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, copies, w, unnest(range(1, len(w) - 1)) AS i FROM named WHERE doc_id = rep AND len(w) >= 3)
  UNION ALL SELECT doc_id, copies, array_to_string(w, ' ') FROM named WHERE doc_id = rep AND len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, copies, count(*) AS n FROM sh GROUP BY 1, 2),
pairs AS (SELECT a, b, c / (na.n + nb.n - c) AS similarity, na.copies AS copies_a, nb.copies AS copies_b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE c / (na.n + nb.n - c) >= 0.85)"""


def _near(spark, sf_dir):
    return texts.near_duplicate_pairs(_documents(spark, sf_dir), 0.85)


@query("near_duplicate_pairs", f"WITH {_TEXT_SQL} SELECT a, b, round(similarity, 6) AS similarity, copies_a, copies_b FROM pairs")
def _(spark, sf_dir):
    return _near(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


_CLUSTERS_SQL = f"""WITH RECURSIVE {_TEXT_SQL}, {_COMPONENTS_SQL},
members AS (SELECT doc_id AS id, coalesce(component, rep) AS cluster FROM named LEFT JOIN comp ON node = rep
  WHERE component IS NOT NULL OR copies > 1)"""


@query("near_duplicate_clusters", _CLUSTERS_SQL + " SELECT id, cluster FROM members")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return texts.near_duplicate_clusters(docs, texts.near_duplicate_forest(docs, 0.85))


@query("near_duplicate_summary", _CLUSTERS_SQL + """ SELECT cluster, members, round(coalesce(least, 1.0::DOUBLE), 6) AS similarity,
    round(coalesce(mean, 1.0::DOUBLE), 6) AS confidence FROM (SELECT cluster, count(*) AS members FROM members GROUP BY 1)
  LEFT JOIN (SELECT cluster, min(similarity) AS least, avg(similarity) AS mean FROM pairs JOIN members ON a = id GROUP BY 1) USING (cluster)""")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    pairs = cut_lineage(_near(spark, sf_dir))
    found = texts.cluster_summary(texts.near_duplicate_clusters(docs, pairs), pairs)
    return found.select("cluster", "members", F.round("similarity", 6).alias("similarity"),
                        F.round("confidence", 6).alias("confidence"))


@query("keywords", """WITH terms AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda w: w <> '')) AS term FROM documents),
  tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  scored AS (SELECT id, term, tf, df, round(tf * ln((SELECT count(*) FROM documents) / df), 9) AS score FROM tf JOIN df USING (term))
  SELECT id, term, tf, df, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM scored) WHERE rank <= 5""")
def _(spark, sf_dir):
    return content.keywords(_documents(spark, sf_dir), 5)


@query("extract_dates", """WITH notes AS (SELECT l_orderkey, l_partkey, l_linenumber, 'order ' || l_orderkey || ' left ' || strftime(l_shipdate, '%Y-%m-%d')
    || ', due ' || strftime(l_shipdate, '%Y/%m/') || printf('%02d', (l_partkey % 40)::INTEGER) || ' or 2024-13-01' AS text FROM lineitem),
  found AS (SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS id,
    unnest(regexp_extract_all(text, '\\b[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}\\b')) AS raw FROM notes)
  SELECT id, raw, replace(raw, '/', '-') AS day FROM found WHERE try_cast(replace(raw, '/', '-') AS DATE) IS NOT NULL""")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    note = F.concat(
        F.lit("order "), "l_orderkey", F.lit(" left "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(", due "),
        F.date_format("l_shipdate", "yyyy/MM/"), F.format_string("%02d", F.col("l_partkey") % 40), F.lit(" or 2024-13-01"),
    )
    notes = lines.select((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), note.alias("text"))
    return content.extract_dates(notes, "id").select("id", "raw", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("classify_content", "SELECT doc_id AS id, true AS class_known, true AS confidence_in_range FROM documents")
def _(spark, sf_dir):
    # the class itself comes out of a fitted model; a test holds it against labels left out
    docs = _documents(spark, sf_dir)
    model = content.train_classifier(docs, table(spark, sf_dir, "labels"))
    found = content.classify_content(docs, model)
    return found.select("id", F.col("class").isin(0, 1).alias("class_known"),
                        F.col("confidence").between(0.5, 1.0).alias("confidence_in_range"))
