"""Verifiable exports of subsets of a chain, and their check by a recipient."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import messages as M
from ledgerloom.config import LedgerConfig
from ledgerloom.functions import hashing as H
from ledgerloom.functions.json_text import json_string, parse_payload
from ledgerloom.operators.tables import contiguous_runs, event_keys, staged, with_redacted_paths, with_running_max


@dataclass
class Bundles:
    """headers: bundle_key, version, export time, filter, genesis, hash, hmac;
    records: bundle_key, seq and the record's fields; segments: bundle_key,
    from_seq, to_seq, prior_record_hash."""

    headers: DataFrame
    records: DataFrame
    segments: DataFrame


def selector(resource_id: str | None = None, actor_id: str | None = None) -> tuple[str, str]:
    """(column, value) of an export by exactly one of the two."""
    given = [(k, v) for k, v in (("resource_id", resource_id), ("actor_id", actor_id)) if v is not None and v.strip()]
    if len(given) != 1:
        raise ValueError("exactly one of resource_id and actor_id is needed")
    return given[0]


def select_by(events: DataFrame, column: str, filter_type: str, chain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, filters) of one bundle for every value of a column, and for
    every chain where there are many: a bundle proves rows of one chain."""
    key = F.concat(F.lit(f"{filter_type}="), F.col(column))
    key = key if chain is None else F.concat(F.col(chain), F.lit("/"), key)
    selection = events.select(key.alias("bundle_key"), *event_keys(chain))
    filters = events.select(key.alias("bundle_key"), F.lit(filter_type).alias("filter_type"), F.col(column).alias("filter_value")).distinct()
    return selection, filters


def record_text() -> Column:
    """Canonical JSON of a record; payloads are canonical in the table."""
    paths = F.concat(F.lit("["), F.array_join(F.transform("redacted_paths", json_string), ","), F.lit("]"))
    return H.object_text(
        [
            ("actorId", json_string(F.col("actor_id"))),
            ("archived", F.col("archived").cast("string")),
            ("contentHash", json_string(F.col("content_hash"))),
            ("eventId", json_string(F.col("event_id"))),
            ("eventTimestamp", json_string(F.col("event_ts_c"))),
            ("eventType", json_string(F.col("event_type"))),
            ("leafCommitments", H.sorted_map_json(F.col("leaf_commitments_json"))),
            ("leafSalts", H.sorted_map_json(F.col("leaf_salts_json"))),
            ("payload", F.coalesce("payload_canonical", F.lit("null"))),
            ("prevHash", json_string(F.col("prev_hash"))),
            ("recordHash", json_string(F.col("record_hash"))),
            ("recordedAt", json_string(F.col("recorded_at_c"))),
            ("redactedPaths", paths),
            ("resourceId", json_string(F.col("resource_id"))),
            ("resourceType", json_string(F.col("resource_type"))),
            ("seq", F.col("seq").cast("string")),
        ]
    )


def runs(selection: DataFrame, key: str | list[str] = "bundle_key") -> DataFrame:
    """(bundle_key, from_seq, to_seq) of the contiguous runs of selected seqs,
    by their ends, so a bundle with most of the rows is no single window."""
    return contiguous_runs(selection, [key] if isinstance(key, str) else key)


def anchored(segments: DataFrame, events: DataFrame, genesis: str, chain: str | None = None) -> DataFrame:
    """segments with the record hash before each; reading it fails where that
    row is missing, as such a proof can't be made."""
    by = [*event_keys(chain)[:-1], "from_seq"]
    prior = events.select(*by[:-1], (F.col("seq") + 1).alias("from_seq"), F.col("record_hash").alias("_prior"))
    joined = segments.join(prior, by, "left")
    missing = F.raise_error(F.concat(F.lit("predecessor of seq "), F.col("from_seq").cast("string"), F.lit(" missing; cannot build segment proof")))
    prior_hash = F.when(F.col("from_seq") <= 1, F.lit(genesis)).when(F.col("_prior").isNotNull(), F.col("_prior")).otherwise(missing.cast("string"))
    return joined.select("bundle_key", "from_seq", "to_seq", prior_hash.alias("prior_record_hash"))


def ordered_digests(parts: DataFrame, key: str = "bundle_key", repeats: bool = False, text: Column | None = None) -> DataFrame:
    """(key, digest): SHA-256 of the texts of each key in the order of column
    `place`, read as a stream: a key's texts are never in memory together. Texts
    that follow one of their own `kind`, where parts have that column, have a
    comma before them. A place that repeats is an error unless `repeats`, which
    forged bundles may have. `text`, the column of that name by default, is made
    of the parts where they have been put in order, so that longer texts aren't shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, digest, last, of = None, None, None, None
        for frame in frames:
            done = []
            for k, place, kind, text in zip(frame[key], frame["place"], frame["kind"], frame["text"]):
                if k != open_key:
                    if digest is not None:
                        done.append((open_key, digest.hexdigest()))
                    open_key, digest, last, of = k, hashlib.sha256(), None, None
                if last is not None and (place < last or place == last and not repeats):
                    raise ValueError(f"place {place} follows {last} in {k}")
                if kind == of:
                    digest.update(b",")
                last, of = place, None if kind < 0 else kind
                digest.update(text.encode())
            yield pd.DataFrame(done, columns=[key, "digest"])
        if digest is not None:
            yield pd.DataFrame([(open_key, digest.hexdigest())], columns=[key, "digest"])

    parts = parts if "kind" in parts.columns else parts.withColumn("kind", F.lit(-1))
    ordered = parts.repartition(key).sortWithinPartitions(key, "place")
    return ordered.select(key, "place", "kind", (F.col("text") if text is None else text).alias("text")).mapInPandas(run, f"{key} string, digest string")


def bundle_hashes(headers: DataFrame, records: DataFrame, segments: DataFrame, repeats: bool = False) -> DataFrame:
    """(bundle_key, digest) of the canonical text without hash and hmac."""
    lead = H.object_text([
        ("bundleVersion", json_string(F.col("bundle_version"))),
        ("exportedAt", json_string(F.col("exported_at"))),
        ("filter", H.object_text([("type", json_string(F.col("filter_type"))), ("value", json_string(F.col("filter_value")))])),
        ("genesisHash", json_string(F.col("genesis_hash"))),
    ])
    opening = F.concat(F.substr(lead, F.lit(1), F.length(lead) - 1), F.lit(',"records":['))
    segment = H.object_text([("fromSeq", F.col("from_seq").cast("string")), ("priorRecordHash", json_string(F.col("prior_record_hash"))), ("toSeq", F.col("to_seq").cast("string"))])

    def at(kind: int, n: Column) -> list[Column]:
        return ["bundle_key", F.lit(kind).alias("kind"), (F.lit(kind).cast("long") * F.lit(1 << 56) + n).alias("place")]

    def fixed(kind: int, text: Column) -> DataFrame:
        return headers.select(*at(kind, F.lit(0).cast("long")), text.alias("text"))

    parts = fixed(0, opening).unionByName(fixed(2, F.lit('],"segments":['))).unionByName(fixed(4, F.lit("]}")))
    parts = parts.unionByName(segments.select(*at(3, F.col("from_seq")), segment.alias("text")))
    # Records go as their columns, which are half as long as their texts.
    parts = parts.unionByName(records.select(*at(1, F.col("seq")), *TEXT_COLUMNS), allowMissingColumns=True)
    return ordered_digests(parts, repeats=repeats, text=F.coalesce("text", record_text()))


RECORD_COLUMNS = ["seq", "event_id", "event_type", "actor_id", "resource_type", "resource_id", "payload_json", "payload_canonical", "leaf_salts_json", "leaf_commitments_json", "redacted_paths", "event_ts_c", "recorded_at_c", "content_hash", "prev_hash", "record_hash", "archived"]
#: What record_text needs.
TEXT_COLUMNS = [c for c in RECORD_COLUMNS if c != "payload_json"]


def export_bundles(
    events: DataFrame,
    selection: DataFrame,
    filters: DataFrame,
    exported_at: str,
    redactions: DataFrame | None = None,
    config: LedgerConfig = LedgerConfig(),
    chain: str | None = None,
) -> Bundles:
    """One bundle for each row of filters (bundle_key, filter_type,
    filter_value), of the seqs that selection (bundle_key, seq) names; where
    events are of many chains, selection names the chain too, one for a bundle."""
    keys = event_keys(chain)
    chosen = selection.select("bundle_key", *keys).distinct()
    shown = with_redacted_paths(events, redactions, chain).withColumn("archived", F.col("archived_at").isNotNull()).withColumn("payload_canonical", F.col("payload_json"))
    records = chosen.join(shown, keys).select("bundle_key", *RECORD_COLUMNS)
    present = chosen.join(events.select(*keys), keys, "left_semi")
    segments = staged(anchored(runs(present, ["bundle_key", *keys[:-1]]), events, config.genesis, chain), "segments")
    headers = filters.select("bundle_key", F.lit("1").alias("bundle_version"), F.lit(exported_at).alias("exported_at"), "filter_type", "filter_value", F.lit(config.genesis).alias("genesis_hash"))
    digests = bundle_hashes(headers, records, segments).withColumnRenamed("digest", "bundle_hash")
    signed = H.hmac_sha256_hex(config.hmac_secret, F.col("bundle_hash")) if config.hmac_secret else F.lit(None).cast("string")
    return Bundles(headers.join(digests, "bundle_key").withColumn("hmac", signed), records, segments)


def bundle_problems(bundles: Bundles, secret: str | None = None) -> DataFrame:
    """(bundle_key, problem): a row for everything that is wrong with a bundle.
    Records are parsed once: their own problems and canonical payloads are staged,
    and the latter are what the bundles' hashes are made of."""
    at = F.concat(F.lit(M.AT_SEQ), F.col("seq").cast("string"))
    linked = H.record_hash(F.col("prev_hash"), F.col("content_hash"))
    none = F.array().cast("array<string>")
    parsed = bundles.records.withColumn("_parsed", parse_payload(F.col("payload_json")))
    own = F.when(F.col("seq").isNull(), F.array(F.lit(M.BUNDLE_RECORD_UNREADABLE))).otherwise(F.concat(
        F.when(F.col("payload_json").isNull(), none).otherwise(_leaf_problems(at)),
        F.when(F.equal_null(H.content_hash(), F.col("content_hash")), none).otherwise(F.array(F.concat(F.lit(M.BUNDLE_CONTENT_DIFFERS), at))),
        F.when(F.equal_null(linked, F.col("record_hash")), none).otherwise(F.array(F.concat(F.lit(M.BUNDLE_RECORD_DIFFERS), at))),
    ))
    checked = parsed.withColumn("payload_canonical", F.col("_parsed.canonical"))
    checked = staged(checked.select("bundle_key", *TEXT_COLUMNS, own.alias("problems")), "checkedrecords")
    known, segments = checked.filter("seq is not null"), bundles.segments.filter("from_seq is not null")
    digests = bundle_hashes(bundles.headers, known, segments, repeats=True)
    headers = bundles.headers.join(digests, "bundle_key", "left")
    problems = headers.filter(~F.equal_null("digest", "bundle_hash")).select("bundle_key", F.lit(M.BUNDLE_HASH_DIFFERS).alias("problem"))
    if secret is not None:
        wrong = F.col("hmac").isNotNull() & (H.hmac_sha256_hex(secret, F.col("bundle_hash")) != F.col("hmac"))
        problems = problems.unionByName(headers.filter(wrong).select("bundle_key", F.lit(M.HMAC_DIFFERS).alias("problem")))
    problems = problems.unionByName(checked.filter(F.size("problems") > 0).select("bundle_key", F.explode("problems").alias("problem")))
    return problems.unionByName(_segment_problems(known, segments))


def verify_bundles(bundles: Bundles, secret: str | None = None, listed: bool = False) -> DataFrame:
    """(bundle_key, valid, n_problems) of every bundle, and with `listed` all its
    problems in one array, which a forged bundle can make as long as its records."""
    n, columns = F.count(F.lit(1)).alias("n"), ["bundle_key", (F.coalesce("n", F.lit(0)) == 0).alias("valid"), F.coalesce("n", F.lit(0)).alias("n_problems")]
    sums = [n, F.array_sort(F.collect_list("problem")).alias("problems")] if listed else [n]
    joined = bundles.headers.select("bundle_key").join(bundle_problems(bundles, secret).groupBy("bundle_key").agg(*sums), "bundle_key", "left")
    return joined.select(*columns, *([F.coalesce("problems", F.array().cast("array<string>")).alias("problems")] if listed else []))


def _leaf_problems(at: Column) -> Column:
    now, salts = F.map_from_entries("_parsed.leaves"), H.string_map(F.col("leaf_salts_json"))

    def check(entry: Column) -> Column:
        leaf, salt = now[entry["key"]], salts[entry["key"]]
        return (
            F.when(F.array_contains("redacted_paths", entry["key"]), F.lit(None).cast("string"))
            .when(leaf.isNull() | salt.isNull(), F.concat(F.lit(M.BUNDLE_LEAF_UNKNOWN), entry["key"], at))
            .when(H.leaf_commitment(salt, leaf) != entry["value"], F.concat(F.lit(M.BUNDLE_LEAF), entry["key"], F.lit(M.BUNDLE_LEAF_MODIFIED), at))
        )

    return F.filter(F.transform(H.entries(F.col("leaf_commitments_json")), check), lambda p: p.isNotNull())


def _segment_problems(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Records that a segment lacks (the first ends its check) and links that
    don't hold within it.

    Only the ends of the records' runs, the segments' starts and the broken
    links are put in order, so a segment costs the same however long it claims
    to be. They lie in ranges, so a bundle with most of them is many tasks' work.
    """
    null = F.lit(None).cast("long")
    ends = runs(records).select("bundle_key", F.col("from_seq").alias("at"), F.lit(0).alias("rank"), F.col("to_seq").alias("run_to"), null.alias("seg_to"), F.lit(None).cast("string").alias("prior"))
    starts = segments.select("bundle_key", F.col("from_seq").alias("at"), F.lit(1).alias("rank"), null.alias("run_to"), F.col("to_seq").alias("seg_to"), F.col("prior_record_hash").alias("prior"))
    marked = with_running_max(ends.unionByName(starts), ["bundle_key"], ["at", "rank"], "run_to", "_reached")
    present = F.greatest(F.coalesce("_reached", F.col("at") - 1), F.col("at") - 1)  # up to here no record is missing
    marked = staged(marked.withColumn("_end", F.least(present, "seg_to")).filter("rank = 1"), "segmentstarts")
    gone = marked.filter("seg_to > _end").select("bundle_key", F.concat(F.lit(M.SEGMENT_RECORD_MISSING), (F.col("_end") + 1).cast("string")).alias("problem"))
    own = records.select("bundle_key", "seq", "prev_hash")
    before = records.select("bundle_key", (F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("_before"))
    first = marked.filter("_end >= at").select("bundle_key", F.col("at").alias("seq"), "prior").join(own, ["bundle_key", "seq"])
    first = first.filter(~F.equal_null("prior", "prev_hash")).select("bundle_key", "seq")
    inner = own.join(before, ["bundle_key", "seq"]).filter(~F.equal_null("_before", "prev_hash")).select("bundle_key", F.col("seq").alias("at"), F.lit(0).alias("rank"), null.alias("_end"))
    covered = with_running_max(inner.unionByName(marked.select("bundle_key", "at", "rank", "_end")), ["bundle_key"], ["at", "rank"], "_end", "_covered")
    covered = covered.filter((F.col("rank") == 0) & (F.col("_covered") >= F.col("at")))
    broken = first.unionByName(covered.select("bundle_key", F.col("at").alias("seq"))).distinct()
    return gone.unionByName(broken.select("bundle_key", F.concat(F.lit(M.SEGMENT_LINK_BROKEN), F.col("seq").cast("string")).alias("problem")))
