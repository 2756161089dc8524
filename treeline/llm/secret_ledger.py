"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every historical version of a text is a blob, addressed by the SHA-256 of its content.
The ledger has one row per blob and rule version with the spans found. A scan reads only
blobs, and on them runs only rules, whose pair is not in the ledger yet; findings are
then joined back to every path that ever held the blob.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` (Java syntax) whose group
    ``value`` has at least ``least`` characters. A changed rule needs a new version."""

    kind: str
    pattern: str
    least: int = 1
    value: int = 0
    version: int = 1
    #: The same matches for engines without possessive quantifiers.
    plain: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: For runs of one class a least length in the pattern finds the same matches as a check
#: afterwards: a run that is too short holds no longer one.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         least=6, value=2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
def _pem(only: str) -> str:
    """From BEGIN to the END that no other such line parts from it (headers of encrypted keys
    hold single dashes), however long that is. Without one: all base64 and line ends, also escaped,
    and lines set in. ``only`` makes quantifiers possessive, so that nothing is kept to go back to."""
    key = "[A-Z0-9 ]{0,40}PRIVATE KEY-----"
    return (
        rf"-----BEGIN {key}(?:[^-]*{only}(?:-{{1,4}}{only}[^-]+{only})*{only}-----END {key}"
        rf"|[A-Za-z0-9+/=\\\r\n]*{only}(?:[\x20\t]+{only}[A-Za-z0-9+/=\\]{{16,}}{only}[A-Za-z0-9+/=\\\r\n]*{only})*{only})"
    )


MORE_RULES = (
    Rule("pem", _pem("+"), version=3, plain=_pem("")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob binary, rule string, spans array<struct<start: bigint, `end`: bigint>>"


def blob_of(text: str | Column) -> Column:
    """The content address; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def empty_ledger(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], LEDGER)


def _matches(rule: Rule, seen: Column) -> Column:
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    return F.when(~F.array_contains(seen, rule.key), found)


def _parts(rule: Rule, matches: Column) -> Column:
    """For each match: the characters between it and the one before, its own, and whether
    it counts. Only texts with a match are split."""
    def part(gap: Column, match: Column) -> Column:
        value = F.regexp_extract(match, rule.pattern, rule.value) if rule.value else match
        counts = F.length(value) >= rule.least if rule.value else F.lit(True)
        return F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("len"),
                        counts.alias("counts"))

    gaps = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(matches))
    return F.when(F.size(matches) > 0, F.zip_with(gaps, matches, part))


def scan_blobs(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows for blobs (blob, text): one per pair that ``ledger`` does not have."""
    known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    todo = todo.filter(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("seen"))) > 0)
    matched = todo.select("blob", "text", "seen", *[_matches(r, F.col("seen")).alias(f"m{i}") for i, r in enumerate(rules)])
    parts = matched.select(
        "blob",
        F.array(*[
            F.struct(F.lit(r.key).alias("rule"), F.col(f"m{i}").isNotNull().alias("run"),
                     _parts(r, F.col(f"m{i}")).alias("parts"))
            for i, r in enumerate(rules)
        ]).alias("results"),
    )
    pairs = cut_lineage(parts.select("blob", F.inline("results")).filter("run").drop("run"))
    # positions: a running sum over one blob's matches of one rule
    single = pairs.filter("parts IS NOT NULL").select("blob", "rule", F.posexplode("parts").alias("i", "p"))
    upto = Window.partitionBy("blob", "rule").orderBy("i")
    ends = single.select("blob", "rule", "p", F.sum(F.col("p.gap") + F.col("p.len")).over(upto).alias("end"))
    spans = (
        ends.filter("p.counts").groupBy("blob", "rule")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("p.len")).alias("start"), "end"))).alias("spans"))
    )
    nothing = F.array().cast("array<struct<start: bigint, `end`: bigint>>")
    return pairs.select("blob", "rule").join(spans, ["blob", "rule"], "left").select(
        "blob", "rule", F.coalesce("spans", nothing).alias("spans")
    )


def ledger_of(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with a row for every blob of ``versions`` and every rule: pairs that
    ``ledger`` lacks are scanned, all others are taken from it."""
    ledger = empty_ledger(versions) if ledger is None else ledger
    # grouping by the text too compares whole contents, and copies leave each input partition once
    held = versions.select(blob_of(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
    blobs = held.groupBy("blob", "text").agg(F.count(F.lit(1)).alias("paths")).select("blob", "text")
    return cut_lineage(ledger.unionByName(scan_blobs(blobs, ledger, rules)))


def found_in(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Blobs with findings of the rules: blob and found, in order of start and rule."""
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    return cut_lineage(
        ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
        .select("blob", ranks[F.col("rule")].alias("rank"), kinds[F.col("rule")].alias("kind"), F.inline("spans"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))
    )


def scan_versions(
    versions: DataFrame,
    path: str = "doc_id",
    text: str = "text",
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): a row per row of ``versions`` with path, blob and ``found``, an
    array of (start, rank, kind, end) in order; and the ledger with all pairs known now.

    Positions count characters; ends are exclusive. ``rank`` is the place of the rule.
    Null texts count as empty and have no findings; so have empty tables. Repeated rows
    and equal texts under many paths are scanned once and all get the findings. Columns
    other than path and text are not read.
    """
    known = ledger_of(versions, text, ledger, rules)
    held = versions.select(F.col(path).alias("path"), blob_of(text).alias("blob"))
    # a blob under very many paths: its one row of findings meets a join that Spark may split
    findings = held.join(found_in(known, rules), "blob", "left").select(
        F.col("path").alias(path), "blob",
        F.coalesce("found", F.array().cast("array<struct<start: bigint, rank: int, kind: string, `end`: bigint>>"))
        .alias("found"),
    )
    return findings, known


def joined_spans(found: Column, below: int | None = None) -> Column:
    """kind:start:end, comma-joined; only of rules ranked below ``below`` where given."""
    if below is not None:
        found = F.filter(found, lambda x: x["rank"] < below)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text", length: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every span found replaced by [kind], and with ``length``, if named, set
    to the new number of characters where a text changed. Of overlapping spans the first
    names the mask, and the rest of the others goes too. All rows and columns stay."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), blob_of(text).alias("blob"))
    joined = rows.join(found_in(ledger_of(docs, text, rules=rules), rules), "blob", "left")
    held = F.col(f"row.`{text}`")
    cut = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(held, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(held, (acc["at"] + 1).cast("int"), F.length(held))),
    )
    new = joined.withColumn("new", F.when(F.col("found").isNotNull(), cut))

    def value(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name == text:
            return F.coalesce("new", old)
        if name == length:
            return F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[name].dataType)).otherwise(old)
        return old

    return new.select(*[value(c).alias(f"_c{i}") for i, c in enumerate(names)]).toDF(*names)
