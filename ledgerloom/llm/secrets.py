"""Secret scans over an incremental blob ledger, in SQL functions.

Every text is a version of the blob named by its SHA-256. A ledger holds the
(blob, rule version) pairs that were scanned, with their findings; a run scans
the pairs that it lacks, adds them, and findings are joined back to all paths
with that blob. Which row of a blob is scanned is decided on hashes alone, and the
text is scanned where it lies: texts move only where a run has more unseen blobs
than may be sent to every task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared_dir, stored

#: Keys of some 60 bytes that may be sent to every task.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """kind, the pattern that is matched leftmost without overlap, and what a
    match must then fulfil: at least min_length characters in group `group`."""

    kind: str
    pattern: str
    group: int
    min_length: int


# The base patterns, in the order of their kinds.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so the shorter ones need not be matched
)
#: A later rule version: marks of key files.
KEY_FILE_RULES = (Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),)
RULE_SETS = {1: BASE_RULES, 2: KEY_FILE_RULES}

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER_SCHEMA = f"blob string, rule_version int, spans {SPAN}"


class Ledger:
    """The scanned (blob, rule version) pairs and their spans, as a folder of
    Parquet tables with one for each run. A run's table has its number, so a run
    that is repeated replaces its own rows. `runs` says how many were completed;
    what lies beyond them isn't read."""

    def __init__(self, spark: SparkSession, path: str, runs: int = 0):
        self.spark, self.path, self.runs = spark, path.rstrip("/"), runs

    def read(self) -> DataFrame:
        parts = [f"{self.path}/run={n}" for n in range(self.runs)]
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], LEDGER_SCHEMA)

    def scan(self, versions: DataFrame, rule_sets: dict[int, tuple[Rule, ...]] | None = None, known: DataFrame | None = None) -> None:
        """Scan what the ledger lacks of these versions and rules, and add it.
        known: the versions without their texts, where they are stored already."""
        rule_sets = rule_sets or RULE_SETS
        fresh = scan_blobs(unseen_blobs(versions, self.read(), list(rule_sets), known), rule_sets)
        fresh = fresh.dropDuplicates(["blob", "rule_version"])  # rows that are wholly equal are scanned each
        fresh.write.mode("overwrite").parquet(f"{self.path}/run={self.runs}")
        self.runs += 1


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches in code points, end exclusive.

    The pieces between the matches and the matches alternate, so each start is
    the length of all that comes before it.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("match"),
        F.transform(groups, lambda x: F.length(x)).alias("part"),
    )
    none = F.array().cast(SPAN)
    walked = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["match"], F.lit(0))).alias("at"),
            F.when(
                x["match"].isNotNull() & (x["part"] >= F.lit(rule.min_length)),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(rank).alias("rank"),
                            F.lit(rule.kind).alias("kind"),
                            (acc["at"] + x["gap"] + x["match"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.regexp_like(text, pattern), walked).otherwise(none)


def _blob(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, row, blob, text) of every row; null text is the empty blob. row is
    a quick hash of path and text, by which a row is found again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.xxhash64(F.col(id_col), text).alias("row"), _blob(text).alias("blob"), text.alias("text"))


def unseen_blobs(versions: DataFrame, ledger: DataFrame, rule_versions: list[int], known: DataFrame | None = None) -> DataFrame:
    """One row for each blob (rows that are equal stay each) with the rule
    versions that it hasn't been scanned by (`todo`); its text comes with it. The
    row is chosen on hashes alone; copies meet before and after that shuffle, so a
    blob with a third of the paths is one row of each task."""
    done = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
    chosen = (versions if known is None else known).groupBy("blob").agg(F.min("row").alias("row"))
    wanted = F.array(*[F.lit(v) for v in sorted(rule_versions)])
    left = chosen.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<int>"))))
    left = stored(left.filter(F.size("todo") > 0).select("row", F.xxhash64("blob").alias("_check"), "todo"), "unseenblobs")
    left = F.broadcast(left) if left.count() <= BROADCAST_ROWS else left
    rows = versions.select("row", "text").join(left, "row").withColumn("blob", _blob(F.col("text")))  # hashed again for these rows alone
    return rows.filter(F.xxhash64("blob") == F.col("_check")).select("blob", "text", "todo")


def scan_blobs(blobs: DataFrame, rule_sets: dict[int, tuple[Rule, ...]]) -> DataFrame:
    """Findings: a row for each (blob, rule version) of `todo`, with its spans."""
    rank, per_version = 0, []
    for version in sorted(rule_sets):
        spans = []
        for rule in rule_sets[version]:
            spans.append(_spans(F.col("text"), rule, rank))
            rank += 1
        per_version.append(
            F.when(
                F.array_contains("todo", version),
                F.struct(F.lit(version).alias("rule_version"), F.concat(*spans).alias("spans")),
            )
        )
    each = F.explode(F.filter(F.array(*per_version), lambda x: x.isNotNull()))
    return blobs.select("blob", each.alias("f")).select("blob", "f.rule_version", "f.spans")


def findings_by_path(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """Every path with all spans of its blob, by start and kind; paths without
    a finding have an empty array. Texts don't move, and a blob with very many
    paths is a skewed side of a left join, which Spark can split."""
    merged = findings.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = versions.select("path", "blob").join(merged, "blob", "left")
    return joined.select("path", "blob", F.array_sort(F.coalesce("spans", F.array().cast(SPAN))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts and spans of its secrets.

    The documents are the history of a store, scanned in two runs over one
    ledger: first one half of the versions (by their ids' hashes) under the
    first rule version, then all versions under all rules, of which only the
    unseen pairs are scanned. Null and empty texts have none; ids may be null or
    repeat; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    versions = versions_of(docs, id_col, text_col)
    ledger = Ledger(spark, f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    known = stored(versions.select("path", "row", "blob"), "versions", lasting=True)
    half = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    ledger.scan(versions.filter(half), {1: BASE_RULES}, known.filter(half))
    ledger.scan(versions, known=known)
    spans = findings_by_path(known, ledger.read())
    base = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return spans.select(
        F.col("path").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
