"""Digests of seq ranges, so that a second full check looks only where rows changed.

A row's digest is of all its columns; a range's is of its rows' in order, and each
node above is of up to FAN_OUT nodes below (Merkle, 1987). Digests are built-in hash functions
over stored text: no payload is parsed and no commitment computed for a range
whose digest is that of a range which was found sound before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import LedgerConfig
from ledgerloom.operators.tables import broadcast_if_small, event_keys, staged
from ledgerloom.operators.verify import row_violations
from ledgerloom.schemas import EVENT_COLUMNS

RANGE = 4096
FAN_OUT = 256
#: Changed ranges that are named one by one in the scan's filter, which each row meets; more are read by a join.
NAMED_RANGES = 64


def range_digests(events: DataFrame, size: int = RANGE, chain: str | None = None) -> DataFrame:
    """(chain, node, n, digest) of every range of `size` seqs that has a row. A
    seq with several rows counts by their number and least and largest digest,
    so a range's list has at most `size` entries."""
    keys = event_keys(chain)
    texts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in EVENT_COLUMNS]
    row = F.sha2(F.concat(*[F.coalesce(t, F.lit("-")) for t in texts]).cast("binary"), 256)
    rows = events.select(*keys, row.alias("d")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    entry = F.struct("seq", F.concat_ws(",", "seq", "n", "lo", "hi").alias("text"))
    node = F.floor(F.col("seq") / F.lit(size))
    grouped = rows.groupBy(*keys[:-1], node.alias("node")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("l"))
    return grouped.select(*keys[:-1], "node", "n", F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), ";").cast("binary"), 256).alias("digest"))


def tree(ranges: DataFrame, chain: str | None = None) -> DataFrame:
    """(chain, level, node, n, digest): the ranges are level 0, and the last level
    has one node for each chain. Two tables are equal if their roots are."""
    by = event_keys(chain)[:-1]
    level, below = 0, ranges.select(*by, F.lit(0).alias("level"), "node", "n", "digest")
    out = below
    while below.agg(F.max("node")).first()[0]:
        level += 1
        entry = F.struct("node", F.concat_ws(",", "node", "n", "digest").alias("text"))
        grouped = below.groupBy(*by, F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(entry)).alias("l"))
        digest = F.sha2(F.array_join(F.transform("l", lambda x: x["text"]), ";").cast("binary"), 256)
        below = staged(grouped.select(*by, F.lit(level).alias("level"), "node", "n", digest.alias("digest")), "digests")
        out = out.unionByName(below)
    return out


def changed_ranges(before: DataFrame, now: DataFrame, chain: str | None = None) -> DataFrame:
    """(chain, node, change) of ranges that are new, changed or gone."""
    by = [*event_keys(chain)[:-1], "node"]
    joined = before.select(*by, F.col("digest").alias("_before")).join(now.select(*by, F.col("digest").alias("_now")), by, "full")
    change = F.when(F.col("_before").isNull(), F.lit("new")).when(F.col("_now").isNull(), F.lit("gone")).otherwise(F.lit("changed"))
    return joined.filter(~F.equal_null("_before", "_now")).select(*by, change.alias("change"))


def rows_of_ranges(events: DataFrame, ranges: DataFrame, size: int = RANGE, chain: str | None = None, more: int = 0) -> DataFrame:
    """The rows of some ranges and `more` rows on both sides. Few ranges of one
    chain are a filter that the scan skips row groups by."""
    near = ranges.select(*event_keys(chain)[:-1], (F.col("node") * size - more).alias("_from"), ((F.col("node") + 1) * size - 1 + more).alias("_to"))
    if chain is None:
        some = near.orderBy("_from").limit(NAMED_RANGES + 1).collect()
        if len(some) <= NAMED_RANGES:
            return events.filter(_any([F.col("seq").between(r["_from"], r["_to"]) for r in some]))
    by = event_keys(chain)[:-1]
    parts = ranges.select(*by, F.explode(F.array(*[F.col("node") + i for i in ((-1, 0, 1) if more else (0,))])).alias("_node")).distinct()
    return events.withColumn("_node", F.floor(F.col("seq") / size)).join(broadcast_if_small(parts), [*by, "_node"], "left_semi").drop("_node")


def _any(terms: list[Column]) -> Column:
    """Does one of them hold: in halves, as a row of several hundred is too deep for the planner."""
    half = len(terms) // 2
    return (_any(terms[:half]) | _any(terms[half:])) if half else terms[0] if terms else F.lit(False)


def check_changed(events: DataFrame, before: DataFrame, redactions: DataFrame | None = None, size: int = RANGE, config: LedgerConfig = LedgerConfig(), chain: str | None = None) -> DataFrame:
    """row_violations of the ranges that aren't as they were when `before`, the
    range_digests of a table found sound, was taken; the row before a range and
    the one after it are looked at too, as links lead out of it. Redactions made
    since then have changed their rows, and so their ranges."""
    keys = event_keys(chain)
    ranges = staged(changed_ranges(before, range_digests(events, size, chain), chain).filter("change != 'gone'"), "changedranges")
    found = row_violations(rows_of_ranges(events, ranges, size, chain, more=1), redactions, config=config, chain=chain)
    own = F.explode(F.array(F.col("seq"), F.col("seq") - 1)).alias("_seq")  # a changed row may break the link of the row after its range
    hit = found.select("*", own).withColumn("node", F.floor(F.col("_seq") / size)).join(ranges.select(*keys[:-1], "node"), [*keys[:-1], "node"], "left_semi")
    return hit.drop("_seq", "node").distinct()
