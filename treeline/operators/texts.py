"""Near-duplicate texts by exact Jaccard similarity of their word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions.columns import as_col
from treeline.operators import shingles
from treeline.operators.components import components
from treeline.session import cut_lineage, discard, scratch
from treeline.skew import skew_join, skew_self_join

_POSTINGS_PER_TASK = 20_000
#: Shingles of texts that a task compares with each other; a text counts as this many more.
_SHINGLES_PER_BLOCK, _PER_TEXT = 1_000_000, 1_000


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(as_col(text)), "[ \\t\\r\\n]+"), lambda w: w != "")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.lower(as_col(text_col)).alias("text"))


def _typed(named: DataFrame, rest: str) -> T.StructType:
    """A schema that begins with the id."""
    return T.StructType([T.StructField("id", named.schema["id"].dataType), *T.StructType.fromDDL(rest).fields])


def _word_digests(named: DataFrame) -> DataFrame:
    """(id, words) of every text: a digest of its words, null without a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else shingles.digest(shingles.plain(t)) for t in shingles.texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "words"])

    return named.select("id", "text").mapInArrow(run, _typed(named, "words binary"))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rep, id, copies) for every document: the least id among those with the same words.

    Only digests are grouped, so copies of one text collapse before the shuffle.
    """
    keyed = cut_lineage(_word_digests(_named(docs, id_col, text_col)))
    reps = keyed.groupBy("words").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return skew_join(keyed, reps, ["words"], "inner", ["id"], rows_per_key="copies").select(
        "rep", "id", "copies"
    )


def _survey(named: DataFrame) -> DataFrame:
    """(id, words, n) of every text that has a word: a digest of its words and the number of its
    distinct shingles. Each task adds rows (part, counts): how often it met the shingles of each bucket."""
    schema = _typed(named, "words binary, n int, part int, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = shingles.Counts(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            held = [(i, shingles.plain(t)) for i, t in enumerate(shingles.texts_of(batch.column(1))) if t is not None]
            held = [(i, words) for i, words in held if words]
            sizes = []
            for each in shingles.shingles([words for _, words in held]):
                counts.add(each)
                sizes.append(len(shingles.distinct(each)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([i for i, _ in held], pa.int64())), pa.array([shingles.digest(words) for _, words in held], pa.binary()),
                 pa.array(sizes, pa.int32()), pa.nulls(len(held), pa.int32()), pa.nulls(len(held), pa.binary())], names=schema.names)
        if kind is not None:
            packed = counts.packed()
            rows = len(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, kind), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int32()),
                 pa.array(range(rows), pa.int32()), pa.array(packed, pa.binary())], names=schema.names)

    return named.select("id", "text").mapInArrow(run, schema)


def _texts_among(named: DataFrame, ids: shingles.Bits, schema: T.StructType, found) -> DataFrame:
    """What ``found`` makes of the ids and the words of the texts with these ids and few others; texts
    without a word are left out."""
    wanted = named.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.flatnonzero(wanted.value.of(batch.column(0).to_numpy().view(np.uint64)))
            given = shingles.texts_of(batch.column(2).take(pa.array(there)))
            held = [(i, words) for i, t in zip(there.tolist(), given, strict=True) if t is not None and (words := shingles.plain(t))]
            if held:
                yield found(batch.column(1).take(pa.array([i for i, _ in held], pa.int64())), [words for _, words in held])

    keyed = named.filter(F.col("id").isNotNull()).select(F.xxhash64("id"), "id", "text")
    return keyed.mapInArrow(run, schema)


def _heads(named: DataFrame, ids: shingles.Bits, levels: bytes, threshold: float) -> DataFrame:
    """(id, n, head) of the texts with these ids and few others: how many shingles they have, and the
    rarest of them, packed; two texts at the threshold share one of these."""
    schema = _typed(named, "n int, head binary")
    known = named.sparkSession.sparkContext.broadcast(levels)

    def found(ids: pa.Array, words: list[bytes]) -> pa.RecordBatch:
        grades, sizes, heads = np.frombuffer(known.value, dtype=np.uint8), [], []
        for each in shingles.shingles(words):
            ordered = shingles.rare_first(each, grades)
            n = len(ordered)
            sizes.append(n)
            heads.append(ordered[: n - math.ceil(threshold * n - 1e-9) + 1].astype("<u8").tobytes())
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array(heads, pa.binary())], names=schema.names)

    return _texts_among(named, ids, schema, found)


def _postings(heads: DataFrame, met: shingles.Bits) -> DataFrame:
    """(id, n, at, h) of the shingles in heads, as far as the table has them."""
    schema = _typed(heads, "n int, at int, h bigint")
    wanted = heads.sparkSession.sparkContext.broadcast(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                blobs = part.column(2).to_pylist()
                sizes = np.array([len(x) // 8 for x in blobs])
                h = np.frombuffer(b"".join(blobs), dtype="<u8")
                kept = np.flatnonzero(wanted.value.of(h))
                row = np.repeat(np.arange(len(blobs)), sizes)[kept]
                at = kept - (np.cumsum(sizes) - sizes)[row]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(at, pa.int32()), pa.array(h[kept].view(np.int64))],
                    names=schema.names)

    return heads.mapInArrow(run, schema)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written in columns: postings take a fifth of what they take in a checkpoint."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(
    docs: DataFrame, threshold: float, id_col: str, text_col: str, path: str
) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(id, text) of all texts, (id, copies, n) of the distinct ones, and the postings (id, n, at, h) of their
    rarest shingles that another text has too (and few others), stored at the path. Last the threshold by which
    places rule out pairs of ids: 0, that is none, if an id has several texts, whose postings would be taken for
    those of one.

    Most postings meet no other. What is shuffled of all are four bytes each, to find out which ones do.
    """
    spark = docs.sparkSession
    named = _named(docs, id_col, text_col)
    surveyed, headed = scratch(spark, "survey"), scratch(spark, "heads")
    survey = _stored(_survey(named), surveyed)
    keyed = survey.filter("part IS NULL")
    reps = cut_lineage(
        keyed.groupBy("words").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
        .select("id", "copies", "n")
    )
    several = keyed.groupBy("id").agg(F.min("words").alias("x"), F.max("words").alias("y")).filter("x <> y")
    bound = threshold if several.isEmpty() else 0.0
    levels = shingles.levels(survey.filter("part IS NOT NULL"))
    discard(spark, surveyed)
    wanted = shingles.bits(reps.filter("id IS NOT NULL").select(F.xxhash64("id").alias("h")), reps.count())
    heads = _stored(_heads(named, wanted, levels, threshold), headed)
    count = heads.agg(F.sum(F.length("head"))).first()[0] or 0
    found = shingles.bits(heads.select("head"), count // 8, several=True)
    met = _stored(_postings(heads, found).join(reps.select("id"), "id", "left_semi"), path)
    discard(spark, headed)
    return named, reps, met, bound


def _alike(n: Column | str, m: Column | str, threshold: float) -> Column:
    """Whether sets of so many shingles can reach the threshold at all."""
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9


def _may_be_first(l_n: str, l_at: str, r_n: str, r_at: str, threshold: float) -> Column:
    """Whether a shingle may be the first that two texts at the threshold share: from it on either has
    enough shingles. Of those that two texts share these come before all others, so a pair without one falls out
    before it is counted."""
    rest = F.least(F.col(l_n) - F.col(l_at), F.col(r_n) - F.col(r_at))
    return rest >= F.lit(threshold / (1 + threshold)) * (F.col(l_n) + F.col(r_n)) - 1e-6


def _can_reach(met: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Of pairs of postings (l_n, l_at, r_n, r_at), the pairs by these columns that can reach the
    threshold, with ``times``, how many they are. All that two texts share up to the last shingle
    of these is among them, and behind it either text has only so many more."""
    pairs = met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("times"),
        F.min(F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) - 1).alias("_more"),
        F.max(F.col("l_n") + F.col("r_n")).alias("_both"),
    )
    enough = F.col("times") + F.col("_more") >= F.lit(threshold / (1 + threshold)) * F.col("_both") - 1e-6
    return pairs.filter(enough).drop("_more", "_both")


def _blocks(candidates: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, copies, block, rows) of the texts in candidates, with how many they are in. Texts whose least
    partner is the same are in one block, unless they are too many for a task."""
    sides = candidates.select(F.col("a").alias("id"), "a").unionByName(candidates.select(F.col("b").alias("id"), "a"))
    asked = cut_lineage(
        sides.groupBy("id").agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("rows")).join(reps, "id")
        .withColumn("weight", F.col("n") + F.lit(_PER_TEXT))
    )
    blocks = max(1, -(-(asked.agg(F.sum("weight")).first()[0] or 0) // _SHINGLES_PER_BLOCK))
    large = asked.groupBy("least").agg(F.ceil(F.sum("weight") / _SHINGLES_PER_BLOCK).cast("int").alias("slots")).filter("slots > 1")
    own = F.xxhash64("least", F.pmod(F.xxhash64("id"), F.col("slots")))
    block = F.coalesce(own, F.pmod(F.xxhash64("least"), F.lit(blocks)))
    return asked.join(large, "least", "left").select("id", "copies", "rows", block.alias("block"))


def _similarities(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y, a, b) of texts (x, y, id, copies, words) that reach the threshold, by their whole sets. All
    texts of the same x and y are compared by one task, which computes each set once."""
    kind = texts.schema["id"].dataType
    schema = T.StructType([
        T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType()),
        T.StructField("copies_a", T.LongType()), T.StructField("copies_b", T.LongType()),
    ])

    def run(given: pa.Table, asked: pa.Table) -> pa.Table:
        p, q = len(given), len(asked)
        ids = pa.concat_arrays([x.combine_chunks() for x in (given["id"], asked["a"], asked["b"])])
        number = ids.dictionary_encode().indices.to_numpy()
        # an id may have several rows: pairs are those of all of them
        order = np.argsort(number[:p], kind="stable")
        first, last = (np.searchsorted(number[:p][order], number[p:], side).astype(np.int64) for side in ("left", "right"))
        rows = (last - first).reshape(2, q)
        each = np.repeat(np.arange(q), rows[0] * rows[1])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(rows[0] * rows[1]) - rows[0] * rows[1], rows[0] * rows[1])
        a = order[first[:q][each] + nth // rows[1][each]]
        b = order[first[q:][each] + nth % rows[1][each]]
        sets = [shingles.distinct(h) for h in shingles.shingles([shingles.whole(x) for x in given["words"].to_pylist()])]
        similarity = np.zeros(0)
        if len(a):
            shared, sizes = shingles.common(sets, a, b), np.array([len(s) for s in sets])
            similarity = shared / (sizes[a] + sizes[b] - shared)
        near = np.flatnonzero(similarity >= threshold)
        pair, copies = pa.array(each[near]), given["copies"].combine_chunks()
        return pa.Table.from_arrays(
            [asked["a"].take(pair), asked["b"].take(pair), pa.array(similarity[near]),
             copies.take(pa.array(a[near])), copies.take(pa.array(b[near]))], names=schema.names)

    asked = pairs.select(F.col("x").alias("p_x"), F.col("y").alias("p_y"), "a", "b")
    return texts.groupBy("x", "y").cogroup(asked.groupBy("p_x", "p_y")).applyInArrow(run, schema)


def _verified(
    candidates: DataFrame, named: DataFrame, reps: DataFrame, threshold: float, limit: int
) -> DataFrame:
    """Those of the candidates (a, b) that reach the threshold, by their whole sets. The words of a
    text move once for each block that has a partner, not for each partner."""
    blocks = cut_lineage(_blocks(candidates, reps))
    placed = candidates.select("a", "b")
    for x, other in (("a", "b"), ("b", "a")):
        side = blocks.groupBy(F.col("id").alias(x)).agg(F.first("block").alias(f"_{x}"), F.first("rows").alias("_rows"))
        placed = skew_join(placed, side, [x], "inner", [other], limit, rows_per_key="_rows").drop("_rows")
    pairs = cut_lineage(placed.select("a", "b", F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y")))
    ends = F.explode(F.array("a", "b")).alias("id")
    places = pairs.select(ends, "x", "y").distinct().join(blocks.select("id", "copies"), "id")
    schema = _typed(named, "words binary")

    def found(ids: pa.Array, words: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([shingles.squeezed(x) for x in words], pa.binary())], names=schema.names)

    wanted = shingles.bits(blocks.select(F.xxhash64("id").alias("h")), blocks.count())
    texts = _texts_among(named, wanted, schema, found).join(places, "id")
    return _similarities(texts.select("x", "y", "id", "copies", "words"), pairs, threshold)


def near_duplicate_pairs(
    docs: DataFrame,
    threshold: float = 0.99,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = _POSTINGS_PER_TASK,
) -> DataFrame:
    """All pairs (a < b) of distinct texts with Jaccard >= threshold, once each, with the
    number of copies of either side. Texts without a word are in no pair.

    A pair at the threshold shares one of the first n - ceil(t*n) + 1 shingles of either text in any order
    that is the same for all, so only those are joined; rare ones come first, by counts per
    bucket. Exact up to equal 64-bit hashes: nothing is capped or sampled.
    """
    spark = docs.sparkSession
    met_path = scratch(spark, "met-postings")
    named, reps, prefix, bound = _met(docs, threshold, id_col, text_col, met_path)

    def possible(left: str, right: str) -> Column:
        first = _may_be_first(left + "n", left + "at", right + "n", right + "at", bound)
        return (F.col(left + "id") < F.col(right + "id")) & _alike(left + "n", right + "n", threshold) & first

    met = skew_self_join(prefix, ["h"], possible, ["id"], limit).withColumnsRenamed({"l_id": "a", "r_id": "b"})
    candidates = cut_lineage(_can_reach(met, ["a", "b"], bound).select("a", "b"))
    discard(spark, met_path)
    return _verified(candidates, named, reps, threshold, limit)


def _shared_postings(prefix: DataFrame, limit: int) -> DataFrame:
    """Postings whose shingle another text has too, with the least (id, n, place) of their list."""
    lists = (
        prefix.groupBy("h").agg(F.min(F.struct("id", "n", "at")).alias("centre"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )
    return skew_join(prefix, lists, ["h"], "inner", ["id"], limit, rows_per_key="rows").drop("rows")


def _star_candidates(shared: DataFrame, threshold: float, bound: float) -> DataFrame:
    """One candidate (a < b) per text: with the least id of its lists that it meets most often."""
    met = shared.filter((F.col("id") != F.col("centre.id")) & _alike("n", "centre.n", threshold))
    sides = met.select("id", F.col("centre.id").alias("centre"), F.col("n").alias("l_n"), F.col("at").alias("l_at"),
                       F.col("centre.n").alias("r_n"), F.col("centre.at").alias("r_at"))
    sides = sides.filter(_may_be_first("l_n", "l_at", "r_n", "r_at", bound))
    times = _can_reach(sides, ["id", "centre"], bound)
    best = times.groupBy("id").agg(F.max(F.struct("times", "centre")).alias("best"))
    return best.select(F.col("best.centre").alias("a"), F.col("id").alias("b"))


def _candidates_between(
    shared: DataFrame, linked: DataFrame, tried: DataFrame, threshold: float, bound: float, limit: int
) -> DataFrame:
    """Candidates (a < b) whose texts are in different components and that are not among the
    tried ones. Lists whose texts are all in one component fall out before they are joined."""
    groups = shared.join(linked.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "h", "id", "n", "at", F.coalesce("component", "id").alias("group")
    )
    mixed = groups.groupBy("h").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least <> most")
    left = groups.join(mixed, "h", "left_semi")

    def possible(x: str, y: str) -> Column:
        apart = F.col(x + "group") != F.col(y + "group")
        first = _may_be_first(x + "n", x + "at", y + "n", y + "at", bound)
        return (F.col(x + "id") < F.col(y + "id")) & apart & _alike(x + "n", y + "n", threshold) & first

    found = skew_self_join(left, ["h"], possible, ["id"], limit).withColumnsRenamed({"l_id": "a", "r_id": "b"})
    return _can_reach(found, ["a", "b"], bound).select("a", "b").join(tried, ["a", "b"], "left_anti")


def near_duplicate_forest(
    docs: DataFrame,
    threshold: float = 0.99,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = _POSTINGS_PER_TASK,
) -> DataFrame:
    """Links (a < b) between distinct texts with Jaccard >= threshold whose components are
    those of ``near_duplicate_pairs``, without its table of all pairs.

    First every text is compared with one centre, so that m near copies cost m comparisons.
    Only candidates whose texts are then still in different components are compared after
    that: a pair within a component cannot change the components, and of the others none is
    left out.
    """
    spark = docs.sparkSession
    met_path, shared_path = scratch(spark, "met-postings"), scratch(spark, "shared-postings")
    named, reps, met, bound = _met(docs, threshold, id_col, text_col, met_path)
    shared = _stored(_shared_postings(met, limit), shared_path)
    discard(spark, met_path)
    tried = cut_lineage(_star_candidates(shared, threshold, bound))
    near = cut_lineage(_verified(tried, named, reps, threshold, limit))
    between = cut_lineage(_candidates_between(shared, components(near), tried, threshold, bound, limit))
    discard(spark, shared_path)
    return near.unionByName(_verified(between, named, reps, threshold, limit))


def near_duplicate_clusters(
    docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, cluster) for every text that has a near copy or an exact one, from all pairs or
    from a forest of them. The cluster is the least id in it; copies follow their
    representative without forming pairs."""
    linked = components(pairs.select("a", "b"))
    texts = distinct_texts(docs, id_col, text_col)
    groups = (
        texts.filter("id = rep")
        .join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .filter("component IS NOT NULL OR copies > 1")
        .select("rep", "copies", F.coalesce("component", "rep").alias("cluster"))
    )
    return skew_join(
        texts.select("id", "rep"), groups, ["rep"], "inner", ["id"], rows_per_key="copies"
    ).select("id", "cluster")


def cluster_summary(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members, least and mean similarity per cluster; copies alone count as 1.0."""
    edges = pairs.join(members.select(F.col("id").alias("a"), "cluster"), "a").groupBy("cluster").agg(
        F.min("similarity").alias("least"), F.avg("similarity").alias("mean")
    )
    return (
        members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
        .join(edges, "cluster", "left")
        .select("cluster", "members", F.coalesce("least", F.lit(1.0)).alias("similarity"),
                F.coalesce("mean", F.lit(1.0)).alias("confidence"))
    )
