"""The queries of the operators in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import (
    alignment, best_fit, exact_dedup, html_blocks, licences, ngram_join, packing, pieces, prefix_trie, quality,
    secret_ledger, sharding, topk,
)
from treeline.session import cut_lineage, prepare
from treeline.skew import skew_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents repeat the text of another, up to white space."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _secret_sql() -> str:
    """Gaps before and lengths of the matches of each rule give the positions."""
    def rule(i: int, r: secret_ledger.Rule) -> str:
        p = (r.plain or r.pattern).replace("'", "''")
        value = f"regexp_extract(m, '{p}', {r.value})" if r.value else "m"
        return f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, m, length({value}) >= {r.least} AS counts, j,
      list_sum(list_transform(gaps[:j], lambda x: length(x))) + list_sum(list_transform(ms[:j], lambda x: length(x))) AS stop
    FROM (SELECT doc_id, ms, string_split_regex(text, '{p}') AS gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS j
          FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS ms FROM documents) WHERE len(ms) > 0)"""

    rules = "\n    UNION ALL ".join(rule(i, r) for i, r in enumerate(secret_ledger.RULES))
    spans = "string_agg(kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - length(m), rank)"
    return f"""WITH found AS (
    {rules}),
per AS (
  SELECT doc_id, {spans} FILTER (rank < 3) AS base, {spans} AS every, count(*) FILTER (rank = 0) AS n_assign,
         count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex
  FROM found WHERE counts GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)"""


@query("op2_secret_scan", _secret_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, from a ledger that begins empty."""
    found, _ = secret_ledger.scan_versions(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secret_ledger.joined_spans(F.col("found"), len(secret_ledger.BASE_RULES)), 256).alias("base_sha256"),
        secret_ledger.joined_spans(F.col("found")).alias("spans"),
    )


@query("op3_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM s) WHERE rank <= 5""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth one, by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op4_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of nearly equal bytes."""
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a network fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    weights = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, weights).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op7_ngram_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) - count(*) AS whole, count(*) AS common
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * common >= 90 * whole),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id
FROM s JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by nearly equal sets of three-word shingles."""
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = html_blocks.main_text(pages, html_blocks.learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what they decode to."""
    done = pieces.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return done.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_licences")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents: confirmed families, and every finding."""
    docs = table(spark, sf_dir, "documents")
    found = licences.licences(docs, licences.learn(docs))
    sure = F.filter("findings", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("bigint").alias("n_confirmed"), F.size("findings").cast("bigint").alias("n_findings"), "findings",
    )


# CRC-32 of the digits, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query("op11_prefix_trie", f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT c, count(*) AS n FROM t GROUP BY c),
ids AS (
  SELECT conv_id AS c, conv_id - conv_id % 5 AS base, {_CRC_SQL} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
r AS (
  SELECT ids.c, n AS d, role, text FROM ids JOIN t ON t.c = base WHERE base <> ids.c AND n <= h
  UNION ALL SELECT c, n, role, text FROM ids JOIN t USING (c) WHERE base = c
  UNION ALL SELECT ids.c, t.n - h + least(h, coalesce(l.n, 0)), role, text
    FROM ids JOIN t USING (c) LEFT JOIN lengths l ON l.c = base WHERE base <> ids.c AND t.n > h),
p AS (
  SELECT c, d, string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d) AS k, strlen(text) AS bytes FROM r
  UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (SELECT k, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM p GROUP BY k),
parents AS (SELECT n.k, q.k AS parent FROM nodes n JOIN p q ON q.c = n.conv_id AND q.d = n.depth - 1),
kids AS (SELECT parent AS k, count(*) AS n_children FROM parents GROUP BY parent),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k)),
sums AS (
  SELECT q.k, count(*) FILTER (n.n_children = 0) AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
  FROM full_nodes n JOIN p q ON q.c = n.conv_id AND q.d <= n.depth GROUP BY q.k),
ends AS (
  SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, k FROM p QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY k)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes n JOIN sums USING (k) LEFT JOIN parents USING (k) LEFT JOIN nodes u ON u.k = parents.parent LEFT JOIN ends ON ends.k = n.k""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its group's first."""
    given = cut_lineage(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")))
    turns, people = rebuilt(given)
    nodes, members = prefix_trie.prefix_trie(turns, people)
    ends = prefix_trie.joined_digests(members)
    return nodes.join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations that begin with the first turns of their group's first one:
    h = crc32(id) mod (most + 1) of them, then their own turns behind the h-th."""
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv") - F.col("conv") % group
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    people = lengths.select("conv", "n", base.alias("base"), h.alias("h")).join(
        lengths.select(F.col("conv").alias("base"), F.col("n").alias("has")), "base", "left")
    people = cut_lineage(people.withColumn("moved", F.when(F.col("base") == F.col("conv"), 0).otherwise(
        F.least("h", F.coalesce("has", F.lit(0))) - F.col("h"))))
    heads = turns.filter(F.col("at") <= most).withColumnRenamed("conv", "base")
    lent = people.filter("base <> conv").select("conv", "base", "h").join(heads, "base").filter("at <= h")
    own = skew_join(turns, people.select("conv", "n", "base", "h", "moved"), ["conv"], "inner", ["at"], rows_per_key="n")
    own = own.filter("base = conv OR at > h").withColumn("at", F.col("at") + F.col("moved"))
    columns = ("conv", "at", "digest", "bytes")
    return cut_lineage(lent.select(*columns).unionByName(own.select(*columns))), people.select("conv")


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies lie over each other in all documents."""
    found = alignment.alignments(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"),
        keep=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)))
    return found.withColumnRenamed("groups", "groups_sha256")


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed best-fit into sequences of at most 2048 tokens."""
    return best_fit.packed_best_fit(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
