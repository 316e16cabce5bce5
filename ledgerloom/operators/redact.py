"""Bulk redaction of payload leaves, all or nothing for each request."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import messages as M
from ledgerloom.config import REDACTION_EVENT_TYPE, REDACTION_RESOURCE_TYPE, SENTINEL_PREFIX, LedgerConfig
from ledgerloom.functions import hashing as H
from ledgerloom.functions.json_text import json_string, replace_leaves
from ledgerloom.operators.tables import broadcast_if_small, event_keys, staged


@dataclass
class Redacted:
    """redactions: new rows of that table; events: the whole patched event table;
    patches: the payloads and salts that change, for a table that merges them;
    rejected: (request_id, reason); meta_events: new events to append, in order."""

    redactions: DataFrame
    events: DataFrame
    patches: DataFrame
    rejected: DataFrame
    meta_events: DataFrame


def redaction_id(run_id: str, chain: str | None = None) -> Column:
    """An id that a retried task draws again: from the run, the event and the path."""
    where = [F.col("seq").cast("string"), F.col("field_path")]
    digest = H.domain_hash(F.lit(run_id), *([] if chain is None else [F.col(chain)]), *where)
    cut = [F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def _conflict_losers(paths: DataFrame, chain: str | None = None) -> DataFrame:
    """(request_id) of requests that meet a leaf which an earlier request takes.

    Earlier means in order of request_id; a request that is itself turned away
    takes nothing. A request names one event, so only requests of one event can
    meet: events with a leaf that two requests want go, in order, through a fold
    that knows the leaves taken so far. One pass, however long a row of requests
    that hang on each other is; a task holds the leaves of one event.
    """
    keys = event_keys(chain)
    wanted = paths.groupBy(*keys, "field_path").agg(F.count_distinct("request_id").alias("n")).filter("n > 1").select(*keys).distinct()
    contested = paths.join(wanted, keys, "left_semi").select(F.concat_ws("\x1f", *keys).alias("event"), "request_id", "field_path")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        event, request, asked, taken = None, None, [], set()

        def turned_away() -> bool:
            if any(p in taken for p in asked):
                return True
            taken.update(asked)
            return False

        for frame in frames:
            out = []
            for e, r, path in zip(frame["event"], frame["request_id"], frame["field_path"]):
                if (e, r) != (event, request):
                    if asked and turned_away():
                        out.append(request)
                    taken = taken if e == event else set()
                    event, request, asked = e, r, []
                asked.append(path)
            yield pd.DataFrame({"request_id": out}, dtype=object)
        if asked and turned_away():
            yield pd.DataFrame({"request_id": [request]}, dtype=object)

    ordered = contested.repartition("event").sortWithinPartitions("event", "request_id")
    return ordered.mapInPandas(fold, "request_id string")


def redact(
    events: DataFrame,
    redactions: DataFrame,
    requests: DataFrame,
    run_id: str,
    redacted_at: Column | None = None,
    config: LedgerConfig = LedgerConfig(),
    chain: str | None = None,
) -> Redacted:
    """Apply redaction requests to the event table. No hash changes: the leaf's
    commitment stays and its value becomes a sentinel. Events of many chains
    name theirs in a column, which redactions and results have too."""
    keys = event_keys(chain)
    redacted_at = F.current_timestamp() if redacted_at is None else redacted_at
    wanted = broadcast_if_small(requests.select("event_id").distinct())  # then events aren't shuffled to be found
    columns = ["event_id", *keys, "archived_at", "recorded_at_c", "payload_json", "leaf_commitments_json", "leaf_salts_json"]
    targets = staged(events.select(*columns).join(wanted, "event_id", "left_semi"), "targets")
    found = requests.join(targets.select("event_id", *keys, "archived_at"), "event_id", "left")
    n_paths = F.coalesce(F.size("field_paths"), F.lit(0))
    reason = (
        F.when(F.col("seq").isNull(), F.concat(F.lit(M.NO_EVENT), F.coalesce("event_id", F.lit("null"))))
        .when(F.col("archived_at").isNotNull(), F.concat(F.lit(M.IS_ARCHIVED), F.col("seq").cast("string")))
        .when(n_paths <= 0, F.lit(M.NO_PATHS))
    )
    found = staged(found.withColumnRenamed("reason", "_why").withColumn("reason", reason), "requests")
    paths = found.filter("reason is null").select("*", F.posexplode("field_paths").alias("at", "field_path"))
    taken = redactions.withColumnRenamed("event_seq", "seq").select(*keys, "field_path", F.lit(True).alias("_taken")).distinct()
    paths = paths.join(taken, [*keys, "field_path"], "left").join(_leaves(targets, keys), [*keys, "field_path"], "left")
    repeated = F.array_position("field_paths", F.col("field_path")) != F.col("at") + 1
    fault = (
        F.when(F.col("commitment").isNull(), F.concat(F.lit(M.NO_LEAF), F.col("field_path")))
        .when(F.col("_taken").isNotNull() | repeated, F.concat(F.col("field_path"), F.lit(M.ALREADY_REDACTED), F.col("seq").cast("string")))
        .when(F.col("field_path") == "", F.lit("the payload itself cannot be redacted"))
    )
    paths = paths.withColumn("fault", fault)
    faults = paths.filter("fault is not null").groupBy("request_id").agg(F.min_by("fault", "at").alias("reason"))
    sound = staged(paths.join(faults.select("request_id"), "request_id", "left_anti").drop("reason", "fault", "_taken"), "paths")
    losers = staged(_conflict_losers(sound, chain), "losers")
    early = sound.join(losers, "request_id", "left_semi").groupBy("request_id").agg(F.min_by(F.struct("field_path", "seq"), "at").alias("p"))
    late = early.select("request_id", F.concat(F.lit("a leaf is redacted by an earlier request on seq "), F.col("p.seq").cast("string")).alias("reason"))
    rejected = found.filter("reason is not null").select("request_id", "reason").unionByName(faults).unionByName(late)
    won = sound.join(losers, "request_id", "left_anti")
    keep = F.coalesce("retain_salt", F.lit(config.retain_salt))
    own_id = redaction_id(run_id) if chain is None else redaction_id(run_id, chain)
    won = staged(won.select("*", keep.alias("keep"), own_id.alias("redaction_id")), "redactions")
    rows = won.select(
        "redaction_id", *keys[:-1], F.col("seq").alias("event_seq"), "field_path", F.col("commitment").alias("field_commitment"),
        F.when(F.col("keep"), F.col("salt")).alias("field_salt"), (F.col("keep") & F.col("salt").isNotNull()).alias("salt_retained"),
        F.col("_why").alias("reason"), "redacted_by", redacted_at.alias("redacted_at"),
    )
    patches = _patches(won, targets, keys)
    return Redacted(rows, patched(events, patches, chain), patches, rejected, _meta_events(requests, won))


def _leaves(targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field_path, commitment, salt) of all leaves of the events."""

    def listed(column: str, name: str) -> DataFrame:
        pairs = targets.select(*keys, F.explode(H.entries(F.col(column))).alias("e"))
        return pairs.select(*keys, F.col("e.key").alias("field_path"), F.col("e.value").alias(name))

    return listed("leaf_commitments_json", "commitment").join(listed("leaf_salts_json", "salt"), [*keys, "field_path"], "left")


def _patches(won: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, payload_json, leaf_salts_json, recorded_at_c) of the events that change, and of no others.
    Salts leave an event by one hashed set difference: an event may have very many leaves and lose half of them."""
    change = F.struct(F.col("field_path").alias("pointer"), F.concat(F.lit(SENTINEL_PREFIX), F.col("redaction_id")).alias("value"))
    sums = [F.array_sort(F.collect_list(change)).alias("_changes"), F.collect_list(_salt_text(F.col("field_path"), F.col("salt"))).alias("_gone")]
    changes = won.groupBy(*keys).agg(*sums).join(targets.select(*keys, "payload_json", "leaf_salts_json", "recorded_at_c"), keys)
    left = F.array_except(F.transform(H.entries(F.col("leaf_salts_json")), lambda e: _salt_text(e["key"], e["value"])), "_gone")
    salts = F.concat(F.lit("{"), F.array_join(left, ","), F.lit("}"))
    return changes.select(*keys, replace_leaves(F.col("payload_json"), F.col("_changes")).alias("payload_json"), salts.alias("leaf_salts_json"), "recorded_at_c")


def _salt_text(pointer: Column, salt: Column) -> Column:
    """A member of the JSON object of salts."""
    return F.concat(json_string(pointer), F.lit(":"), json_string(salt))


def patched(events: DataFrame, patches: DataFrame, chain: str | None = None) -> DataFrame:
    """events with the payloads and salts of patches (at most one a row) instead
    of their own. Where patches are few, events aren't shuffled."""
    keys = event_keys(chain)
    new = patches.select(*keys, F.col("payload_json").alias("_payload"), F.col("leaf_salts_json").alias("_salts"), F.lit(True).alias("_touched"))
    joined = events.join(broadcast_if_small(staged(new, "patches")), keys, "left")
    touched = F.coalesce("_touched", F.lit(False))
    return joined.withColumns(
        {"payload_json": F.when(touched, F.col("_payload")).otherwise(F.col("payload_json")), "leaf_salts_json": F.when(touched, F.col("_salts")).otherwise(F.col("leaf_salts_json"))}
    ).select(*events.columns)


def _meta_events(requests: DataFrame, won: DataFrame) -> DataFrame:
    done = won.groupBy("request_id").agg(F.first("seq").alias("seq"), F.first("keep").alias("keep"), F.array_sort(F.collect_list(F.struct("at", "field_path"))).alias("p"))
    rows = requests.join(done, "request_id")
    listed = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: json_string(x["field_path"])), ","), F.lit("]"))
    payload = H.object_text(
        [
            ("targetEventId", json_string(F.col("event_id"))),
            ("targetSeq", F.col("seq").cast("string")),
            ("reason", F.coalesce(json_string(F.col("reason")), F.lit("null"))),
            ("redactedBy", F.coalesce(json_string(F.col("redacted_by")), F.lit("null"))),
            ("saltRetained", F.col("keep").cast("string")),
            ("fieldPaths", listed),
        ]
    )
    return rows.select(
        "request_id", F.lit(REDACTION_EVENT_TYPE).alias("event_type"), F.col("redacted_by").alias("actor_id"),
        F.lit(REDACTION_RESOURCE_TYPE).alias("resource_type"), F.col("event_id").alias("resource_id"), payload.alias("payload"), F.lit(None).cast("string").alias("timestamp"),
    )


def check_disclosures(redactions: DataFrame, disclosed: DataFrame, chain: str | None = None) -> DataFrame:
    """Does a disclosed leaf (event_seq, field_path, leaf) match what was
    redacted: verdict proven, refuted, unprovable (salt not kept) or unknown."""
    by = [*event_keys(chain)[:-1], "event_seq", "field_path"]
    joined = disclosed.join(redactions.select(*by, "field_commitment", "field_salt", "salt_retained"), by, "left")
    verdict = (
        F.when(F.col("field_commitment").isNull(), F.lit("unknown"))
        .when(~F.col("salt_retained"), F.lit("unprovable"))
        .when(H.leaf_commitment(F.col("field_salt"), F.col("leaf")) == F.col("field_commitment"), F.lit("proven"))
        .otherwise(F.lit("refuted"))
    )
    return joined.select(*by, "leaf", verdict.alias("verdict"))
