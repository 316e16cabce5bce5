"""Chain verification in parallel, of one chain or of many.

What a row says about itself (leaves, content hash, record hash) is checked where
the row lies; only rows that fail leave that scan, and they meet the redactions.
Links, gaps and repeated keys need a row's neighbours: hashes and ids alone are
dealt into buckets of seqs, each with the row before it, and one window over a
bucket tells them all. No exchange carries a payload. The report of a walk that
stops at the first inconsistency follows from the least violating row and the
least missing seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import messages as M
from ledgerloom.config import DUPLICATE_KEY, LedgerConfig
from ledgerloom.functions import hashing as H
from ledgerloom.functions.json_text import parse_payload
from ledgerloom.operators.tables import broadcast_if_small, contiguous_runs, event_keys, staged

FACTS = "array<struct<pointer:string,commitment:string>>"
FAULTS = "array<struct<rank:int,place:int,pointer:string,type:string,detail:string>>"
REPORT = (
    "intact boolean, records_checked long, from_seq long, to_seq long, deep boolean, "
    "archived_segments array<struct<from_seq:bigint,to_seq:bigint>>, "
    "first_inconsistency struct<seq:bigint,event_id:string,violation_type:string,detail:string>"
)
#: Seqs of a bucket whose rows meet in one window.
BUCKET = 1 << 16
# The order in which a row's checks are made.
_GENESIS, _LINK, _NO_COPY, _LEAVES, _CONTENT, _RECORD, _TWICE, _HEAD = range(8)


def _fault(rank: int, kind: str, detail: Column | str, pointer: Column | None = None, place: Column | None = None) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    none = F.lit(None).cast("string")
    return F.struct(F.lit(rank).alias("rank"), (F.lit(0) if place is None else place).alias("place"), (none if pointer is None else pointer).alias("pointer"), F.lit(kind).alias("type"), detail.alias("detail"))


def leaf_facts(payload: Column, salts_json: Column) -> Column:
    """The commitments that a payload and its salts give, null where a salt is missing."""
    leaves, salts = F.coalesce(parse_payload(F.coalesce(payload, F.lit("null")))["leaves"], F.array().cast("array<struct<pointer:string,leaf:string>>")), H.string_map(salts_json)
    facts = F.transform(leaves, lambda x: F.struct(x["pointer"].alias("pointer"), H.leaf_commitment(salts[x["pointer"]], x["leaf"]).alias("commitment")))
    return F.when(payload.isNull(), F.array().cast(FACTS)).otherwise(facts)


def _leaf_faults(facts: Column) -> Column:
    """All leaves that fail: stored ones in their order, then added ones, which
    no redaction excuses."""
    now = F.map_from_entries(facts)

    def check(entry: Column, i: Column) -> Column:
        pointer, own = entry["key"], now[entry["key"]]
        text = F.concat(F.lit(M.LEAF), pointer)
        return (
            F.when(~F.map_contains_key(now, pointer), _fault(_LEAVES, "LEAF_COMMITMENT_MISMATCH", F.concat(text, F.lit(M.LEAF_MISSING)), pointer, i))
            .when(own.isNull(), _fault(_LEAVES, "MISSING_SALT", F.concat(F.lit(M.NO_SALT), pointer), pointer, i))
            .when(own != entry["value"], _fault(_LEAVES, "LEAF_COMMITMENT_MISMATCH", F.concat(text, F.lit(M.LEAF_MODIFIED)), pointer, i))
        )

    failed = F.array_compact(F.transform(H.entries(F.col("leaf_commitments_json")), check))
    added = F.array_except(F.transform(facts, lambda x: x["pointer"]), F.map_keys(H.string_map(F.col("leaf_commitments_json"))))
    more = F.transform(added, lambda p, i: _fault(_LEAVES, "LEAF_COMMITMENT_MISMATCH", F.concat(F.lit(M.LEAF), p, F.lit(M.LEAF_ADDED)), None, F.lit(1 << 30) + i))
    return F.concat(failed.cast(FAULTS), more.cast(FAULTS))


def _own_faults(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id, fault): what rows say against themselves. An archived row
    has no payload here; a deep check takes the one of its copy."""
    archived = F.col("archived_at").isNotNull()
    facts = leaf_facts(F.when(~archived, F.col("payload_json")), F.col("leaf_salts_json"))
    rows = events.withColumn("_facts", facts)
    content = F.when(archived, _fault(_CONTENT, "CONTENT_HASH_MISMATCH", M.CONTENT_DIFFERS_ARCHIVED)).otherwise(_fault(_CONTENT, "CONTENT_HASH_MISMATCH", M.CONTENT_DIFFERS))
    none = F.array().cast(FAULTS)
    faults = F.concat(
        F.when(archived, none).otherwise(_leaf_faults(F.col("_facts"))),
        F.when(F.equal_null(H.content_hash(), F.col("content_hash")), none).otherwise(F.array(content).cast(FAULTS)),
        F.when(F.equal_null(H.record_hash(F.col("prev_hash"), F.col("content_hash")), F.col("record_hash")), none).otherwise(F.array(_fault(_RECORD, "RECORD_HASH_MISMATCH", M.RECORD_DIFFERS)).cast(FAULTS)),
    )
    return rows.select(*keys, "event_id", F.explode(faults).alias("fault"))


def _copy_faults(events: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id, fault) of archived rows whose copy is missing or fails:
    commitments made of the copies meet those of the rows."""
    copies = archive.select(*keys, leaf_facts(F.col("payload_json"), F.col("leaf_salts_json")).alias("_facts"))
    rows = events.filter(F.col("archived_at").isNotNull()).select(*keys, "event_id", "leaf_commitments_json").join(copies, keys, "left")
    faults = F.when(F.col("_facts").isNull(), F.array(_fault(_NO_COPY, "CONTENT_HASH_MISMATCH", M.NO_ARCHIVE_COPY)).cast(FAULTS)).otherwise(_leaf_faults(F.col("_facts")))
    return rows.select(*keys, "event_id", F.explode(faults).alias("fault"))


def neighbours(events: DataFrame, chain: str | None = None) -> DataFrame:
    """(keys, event_id, prev_hash, archived, before_lo, before_hi, twins, alone,
    ends, run_ends) of every row: the record hashes at the seq before, how many
    rows have its seq, whether no row has the one before or after it, and whether
    a run of archived rows ends with it. Each bucket also has the last row of the one before."""
    keys = event_keys(chain)
    at = F.floor(F.col("seq") / BUCKET)
    rows = events.select(*keys, "event_id", "prev_hash", "record_hash", F.col("archived_at").isNotNull().alias("archived"))
    dealt = rows.withColumn("_bucket", F.explode(F.when(F.pmod("seq", F.lit(BUCKET)) == BUCKET - 1, F.array(at, at + 1)).otherwise(F.array(at))))
    near = Window.partitionBy(*keys[:-1], "_bucket").orderBy("seq")
    before, here, after = near.rangeBetween(-1, -1), near.rangeBetween(0, 0), near.rangeBetween(1, 1)
    n = F.count(F.lit(1))
    seen = dealt.select(
        *keys, "event_id", "prev_hash", "record_hash", "archived", "_bucket", F.min("record_hash").over(before).alias("before_lo"), F.max("record_hash").over(before).alias("before_hi"),
        n.over(before).alias("_before"), n.over(here).alias("twins"), n.over(after).alias("_after"), F.max("archived").over(after).alias("_next"),
    )
    # A bucket's last row looks back in its own bucket and ahead in the next one.
    own, ahead = F.col("_bucket") == at, F.col("_bucket") == F.floor((F.col("seq") + 1) / BUCKET)
    return seen.select(
        *keys, "event_id", "prev_hash", "record_hash", "archived", "before_lo", "before_hi", F.when(own, F.col("twins")).otherwise(F.lit(0)).alias("twins"), own.alias("own"),
        (own & (F.col("_before") == 0)).alias("alone"), (ahead & (F.col("_after") == 0)).alias("ends"), (ahead & F.col("archived") & ~F.coalesce("_next", F.lit(False))).alias("run_ends"),
    )


def _link_fault(config: LedgerConfig) -> Column:
    """What is wrong with how a row goes on from the row before; null: nothing."""
    differs = F.col("before_lo").isNotNull() & ((F.col("prev_hash") != F.col("before_lo")) | (F.col("prev_hash") != F.col("before_hi")))
    return F.when((F.col("seq") == 1) & (F.col("prev_hash") != config.genesis), _fault(_GENESIS, "GENESIS_MISMATCH", M.GENESIS_DIFFERS)).when(
        (F.col("seq") != 1) & differs, _fault(_LINK, "PREV_HASH_MISMATCH", M.LINK_DIFFERS)
    )


def _twice(seen: DataFrame, events: DataFrame, chain: str | None) -> DataFrame:
    """(keys, event_id, fault) of seqs and event ids that more than one row has,
    at the largest seq of such rows. An event id is one of all chains."""
    keys = event_keys(chain)
    seqs = seen.filter("twins > 1").groupBy(*keys).agg(F.max("twins").alias("n")).withColumn("event_id", F.lit(None).cast("string"))
    text = F.format_string("%d rows have seq %d", "n", "seq")
    seqs = seqs.select(*keys, "event_id", _fault(_TWICE, DUPLICATE_KEY, text).alias("fault"))
    ids = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*keys)).alias("k")).filter("n > 1")
    text = F.concat(F.col("n").cast("string"), F.lit(" rows have event_id "), F.coalesce("event_id", F.lit("null")))
    return seqs.unionByName(ids.select("k.*", "event_id", _fault(_TWICE, DUPLICATE_KEY, text).alias("fault")))


def _excused(faults: DataFrame, redactions: DataFrame | None, chain: str | None) -> DataFrame:
    """faults without those of leaves that a redaction names."""
    if redactions is None:
        return faults
    keys = event_keys(chain)
    gone = redactions.select(*keys[:-1], F.col("event_seq").alias("seq"), F.col("field_path").alias("_pointer")).distinct()
    own = faults.withColumn("_pointer", F.col("fault.pointer"))
    return own.join(gone, [*keys, "_pointer"], "left_anti").drop("_pointer")


def _own_and_copy_faults(events: DataFrame, redactions: DataFrame | None, archive: DataFrame | None, deep: bool, chain: str | None) -> DataFrame:
    keys = event_keys(chain)
    if deep and archive is None:
        raise ValueError("a deep check needs the archive")
    found = _own_faults(events, keys)
    if deep:
        found = found.unionByName(_copy_faults(events, archive, keys))
    return _excused(found, redactions, chain)


def row_violations(
    events: DataFrame,
    redactions: DataFrame | None = None,
    archive: DataFrame | None = None,
    deep: bool = False,
    config: LedgerConfig = LedgerConfig(),
    chain: str | None = None,
) -> DataFrame:
    """(keys, event_id, violation_type, detail) of every row that fails a check,
    by its first failing one. Missing rows are for missing_after. Events of many
    chains name theirs in a column, which redactions, archive and result have too."""
    keys = event_keys(chain)
    links = neighbours(events, chain).filter("own").select(*keys, "event_id", _link_fault(config).alias("fault")).filter("fault is not null")
    found = _own_and_copy_faults(events, redactions, archive, deep, chain).unionByName(links)
    first = found.groupBy(*keys, "event_id").agg(F.min("fault").alias("v"))
    return first.select(*keys, "event_id", F.col("v.type").alias("violation_type"), F.col("v.detail").alias("detail"))


def missing_after(events: DataFrame, from_seq: int, to_seq: int) -> DataFrame:
    """(seq): the first missing seq of each gap within [from_seq, to_seq]."""
    spark = events.sparkSession
    after = events.filter((F.col("seq") >= from_seq) & (F.col("seq") < to_seq)).select((F.col("seq") + 1).alias("seq"))
    wanted = after.unionByName(spark.range(from_seq, from_seq + 1).select(F.col("id").alias("seq")))
    return wanted.join(events.select("seq"), "seq", "left_anti")


def duplicate_keys(events: DataFrame) -> DataFrame:
    """(key, value, n, seq): seqs and event ids that more than one row has, and
    the largest seq of such rows; a lake table doesn't enforce its keys."""
    out = None
    for key in ("seq", "event_id"):
        rows = events.groupBy(F.col(key).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")).filter("n > 1")
        rows = rows.select(F.lit(key).alias("key"), "value", "n", "seq")
        out = rows if out is None else out.unionByName(rows)
    return out


def archived_runs(events: DataFrame, from_seq: int | None = None, to_seq: int | None = None, chain: str | None = None) -> DataFrame:
    """(chain, from_seq, to_seq) of the contiguous runs of archived rows in a range."""
    rows = events.filter(F.col("archived_at").isNotNull())
    rows = rows if from_seq is None else rows.filter(F.col("seq") >= from_seq)
    rows = rows if to_seq is None else rows.filter(F.col("seq") <= to_seq)
    return contiguous_runs(rows, event_keys(chain)[:-1])


def _walks(events: DataFrame, bounds: DataFrame, chain: str, redactions: DataFrame | None, archive: DataFrame | None, deep: bool, config: LedgerConfig) -> DataFrame:
    """A row for each row of bounds (chain, lo, hi, first, last, head_seq,
    head_hash): what a walk from first to last finds. Only hashes and failing
    rows are shuffled; they meet the bounds of their chains afterwards."""
    keys = event_keys(chain)
    seen = neighbours(events, chain)
    limits = broadcast_if_small(bounds.select(chain, "first", "last", "head_seq", "head_hash"))
    near = seen.join(limits, chain).filter(F.col("seq").between(F.col("first") - 1, F.col("last")))
    near = near.select(
        *keys, "event_id", "own", "twins", "alone", "ends", _link_fault(config).alias("link"), (F.col("own") & (F.col("seq") == F.col("first") - 1)).alias("anchor"),
        (F.col("seq") >= F.col("first")).alias("within"), (F.col("own") & (F.col("seq") == F.col("head_seq")) & (F.col("record_hash") != F.col("head_hash"))).alias("other_head"),
        (F.col("run_ends") | (F.col("archived") & (F.col("seq") == F.col("last")))).alias("run_ends"), "last",
    )
    # One pass over all rows keeps those that a report needs: ends of gaps and runs, and what fails.
    marks = staged(near.filter("(own and (link is not null or twins > 1 or alone or other_head)) or anchor or ends or run_ends"), "marks")
    twice = marks.withColumn("twins", F.when(F.col("own"), F.col("twins")).otherwise(F.lit(0)))
    links = marks.filter("own and link is not null").select(*keys, "event_id", F.col("link").alias("fault"))
    head = marks.filter("other_head").select(*keys, "event_id", _fault(_HEAD, "RECORD_HASH_MISMATCH", "record_hash is not that of the expected head").alias("fault"))
    found = _own_and_copy_faults(events, redactions, archive, deep, chain).unionByName(links).unionByName(head).unionByName(_twice(twice, events, chain))
    found = found.join(limits, chain).filter(F.col("seq").between(F.col("first"), F.col("last")))
    worst = found.groupBy(chain).agg(F.min(F.struct("seq", "fault", "event_id")).alias("b"))
    # A gap begins after a row without a successor, and ends at a row without a predecessor.
    sums = marks.groupBy(chain).agg(F.min(F.when(F.col("ends") & (F.col("seq") < F.col("last")), F.col("seq") + 1)).alias("gap"), F.count(F.when(F.col("anchor"), 1)).alias("anchors"))
    walks = bounds.join(worst, chain, "left").join(sums, chain, "left")
    walks = walks.withColumn("e", F.when(F.coalesce(F.col("lo") > F.col("first"), F.lit(True)), F.col("first")).otherwise(F.col("gap")))
    limit = F.when(F.col("b.seq") < F.coalesce("e", F.lit((1 << 63) - 1)), F.col("b.seq") - 2).otherwise(F.coalesce(F.col("e") - 1, F.col("last")))
    walks = staged(walks.withColumn("limit", limit), "walks")
    after = marks.join(walks.select(chain, "e", "limit"), chain).groupBy(chain).agg(
        F.min(F.when(F.col("alone") & (F.col("seq") > F.col("e")), F.col("seq"))).alias("n"),
        F.count_distinct(F.when(F.col("run_ends") & F.col("within") & (F.col("seq") <= F.col("limit")), F.col("seq"))).alias("archived_runs"),
    )
    walks = walks.join(after, chain, "left")
    b, e, n = F.col("b.seq"), F.col("e"), F.col("n")
    told = b.isNotNull() & (e.isNull() | (b < e))
    nothing = F.col("first") > F.col("last")
    loose = (F.col("first") > 1) & (F.coalesce("anchors", F.lit(0)) == 0) & ~nothing
    gap = F.when(n.isNotNull(), F.format_string(M.GAP.replace("{}", "%d"), e, n)).otherwise(F.format_string(M.CUT_OFF.replace("{}", "%d"), e - 1, F.col("last")))

    def case(at_row: Column, at_gap: Column, cut_off: Column, intact: Column, none: Column) -> Column:
        return F.when(nothing, none).when(told, at_row).when(e.isNotNull() & n.isNotNull(), at_gap).when(e.isNotNull(), cut_off).otherwise(intact)

    null = F.lit(None)
    shown = walks.select(
        chain,
        F.when(loose, null.cast("boolean")).otherwise(nothing | (~told & e.isNull())).alias("intact"),
        case(b - F.col("first") + 1, e - F.col("first") + 1, e - F.col("first"), F.col("last") - F.col("first") + 1, F.lit(0)).cast("long").alias("records_checked"),
        F.col("first").alias("from_seq"),
        case(b, n, e - 1, F.col("last"), F.lit(0)).cast("long").alias("to_seq"),
        F.lit(deep).alias("deep"),
        F.when(nothing, F.lit(0)).otherwise(F.coalesce("archived_runs", F.lit(0))).alias("archived_runs"),
        F.col("limit").alias("runs_until"),
        F.when(loose, null.cast("long")).otherwise(case(b, e, e, null, null)).cast("long").alias("violation_seq"),
        F.when(loose, null.cast("string")).otherwise(case(F.col("b.event_id"), null, null, null, null)).alias("event_id"),
        F.when(loose, null.cast("string")).otherwise(case(F.col("b.fault.type"), F.lit("SEQUENCE_GAP"), F.lit("SEQUENCE_GAP"), null, null)).alias("violation_type"),
        F.when(loose, F.format_string(M.NOT_ANCHORED, "first")).otherwise(case(F.col("b.fault.detail"), gap, gap, null, null)).alias("detail"),
    )
    return shown


def verify_chain(
    events: DataFrame,
    redactions: DataFrame | None = None,
    archive: DataFrame | None = None,
    from_seq: int | None = None,
    to_seq: int | None = None,
    deep: bool = False,
    expected_head: tuple[int, str] | None = None,
    config: LedgerConfig = LedgerConfig(),
) -> DataFrame:
    """The one-row report of a check of [from_seq, to_seq] (the whole chain by
    default): intact, records_checked, from_seq, to_seq, deep, archived_segments
    and first_inconsistency.

    expected_head also finds rows that were cut off at the end, which the chain
    alone can't show. Keys that repeat in the range are violations at the largest
    seq of their rows. The segments are one array; archived_runs gives them as a
    table. ValueError if the row before from_seq is missing.
    """
    spark, one = events.sparkSession, "_chain"
    ends = events.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"] or 0
    head_seq, head_hash = expected_head or (None, None)
    if not hi and not head_seq:
        return _report(spark, True, 0, 0, 0, deep, None, None)
    first = (lo or 1) if from_seq is None else max(from_seq, 1)
    last = max(hi, head_seq or 0) if to_seq is None else min(to_seq, hi)
    part = events.filter(F.col("seq").between(first - 1, last))
    bounds = spark.createDataFrame([("", lo, hi, first, last, head_seq, head_hash)], f"{one} string, lo long, hi long, first long, last long, head_seq long, head_hash string")

    def named(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.withColumn(one, F.lit(""))

    row = _walks(named(part), bounds, one, named(redactions), named(archive), deep, config).first()
    if row["intact"] is None:
        raise ValueError(row["detail"])
    found = None if row["intact"] else (row["violation_seq"], row["event_id"], row["violation_type"], row["detail"])
    runs = archived_runs(part, first, last).filter(F.col("to_seq") <= row["runs_until"]) if row["archived_runs"] else None
    return _report(spark, row["intact"], row["records_checked"], first, row["to_seq"], deep, runs, found)


def verify_chains(
    events: DataFrame,
    chain: str,
    redactions: DataFrame | None = None,
    archive: DataFrame | None = None,
    ranges: DataFrame | None = None,
    heads: DataFrame | None = None,
    deep: bool = False,
    config: LedgerConfig = LedgerConfig(),
) -> DataFrame:
    """A row for each of many chains, named by a column that all tables have: the
    chain, intact, records_checked, from_seq, to_seq, deep, archived_runs (how
    many; the function gives them), last_seq and the first inconsistency's seq,
    event id, type and detail. Chains are checked beside each other.

    ranges (chain, from_seq, to_seq; nulls stand for 1 and the last seq) limits
    the check to its chains. heads (chain, last_seq, last_hash) also finds rows
    cut off at the end, and chains that are gone. Where the row before a range is
    missing, intact is null and detail says so.
    """
    ends = events.groupBy(chain).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    if heads is not None:
        ends = ends.join(heads.select(chain, F.col("last_seq").alias("head_seq"), F.col("last_hash").alias("head_hash")), chain, "full")
    else:
        ends = ends.withColumns({"head_seq": F.lit(None).cast("long"), "head_hash": F.lit(None).cast("string")})
    if ranges is not None:
        ends = ends.join(ranges.select(chain, "from_seq", "to_seq"), chain)
        events = events.join(broadcast_if_small(ranges.select(chain)), chain, "left_semi")
    else:
        ends = ends.withColumns({"from_seq": F.lit(None).cast("long"), "to_seq": F.lit(None).cast("long")})
    reached = F.greatest(F.coalesce("hi", F.lit(0)), F.coalesce("head_seq", F.lit(0)))
    first, last = F.greatest(F.coalesce("from_seq", F.lit(1)), F.lit(1)), F.when(F.col("to_seq").isNull(), reached).otherwise(F.least("to_seq", F.coalesce("hi", F.lit(0))))
    bounds = ends.select(chain, "lo", "hi", first.cast("long").alias("first"), last.cast("long").alias("last"), "head_seq", "head_hash")
    walks = _walks(events, bounds, chain, redactions, archive, deep, config).drop("runs_until")
    return walks.join(bounds.select(chain, F.coalesce("hi", F.lit(0)).alias("last_seq")), chain)


def _report(spark: SparkSession, intact, checked, first, last, deep, runs: DataFrame | None, found) -> DataFrame:
    row = spark.createDataFrame([(intact, checked, first, last, deep, [], found)], REPORT)
    if runs is None:
        return row
    segments = runs.agg(F.array_sort(F.collect_list(F.struct("from_seq", "to_seq"))).alias("_runs"))
    return row.crossJoin(segments).withColumn("archived_segments", F.col("_runs")).drop("_runs")
