"""Bulk append: validate, number, commit to payload leaves, hash and link."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import RECORD_PREFIX, SEPARATOR, LedgerConfig
from ledgerloom.functions import hashing as H
from ledgerloom.functions.json_text import parse_payload
from ledgerloom.operators.tables import broadcast_if_small, staged, unstaged, with_dense_seq
from ledgerloom.schemas import EVENT_COLUMNS

_NAMED = ("event_type", "actor_id", "resource_type", "resource_id")
MAX_LENGTH = 200


@dataclass
class Appended:
    """events: rows of the event table, made as they are read; rejected: input
    rows with a reason. parts: the tables that events are made of."""

    events: DataFrame
    rejected: DataFrame
    parts: tuple[DataFrame, ...] = ()

    def staged(self, name: str = "chain") -> DataFrame:
        """The events as a table; what they were made of is deleted, so events can't be read again."""
        out = staged(self.events, name)
        unstaged(*self.parts)
        return out


def _utf16_length(text: Column) -> Column:
    """Code units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def rejection(parsed: str = "parsed") -> Column:
    """The reason why an event isn't accepted, or null."""
    reason = F.when(F.col("payload").isNull(), F.lit("payload is missing")).when(~F.col(f"{parsed}.is_object"), F.lit("payload is not a JSON object"))
    for name in reversed(_NAMED):
        c = F.col(name)
        blank = c.isNull() | ~c.rlike(r"[^\x00-\x20]")
        reason = F.when(blank, F.lit(f"{name} is blank")).when(_utf16_length(c) > MAX_LENGTH, F.lit(f"{name} is too long")).otherwise(reason)
    return reason


def _draw_salts(leaves: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [os.urandom(16).hex() for _ in x] for x in leaves.to_pylist()], pa.list_(pa.string()))


def random_salts(leaves: Column) -> Column:
    """128 random bits, in hex, for each leaf."""
    return F.arrow_udf(_draw_salts, "array<string>")(leaves)


def seeded_salts(event_id: Column, leaves: Column) -> Column:
    """Repeatable salts, for tests: they would undo the erasure of a salt."""
    return F.transform(leaves, lambda x: F.substr(H.sha256_hex(F.concat(event_id, x["pointer"])), F.lit(1), F.lit(32)))


def committed(df: DataFrame, salts: Column) -> DataFrame:
    """df (with column parsed) with payload_json, leaf_salts_json and
    leaf_commitments_json, pointers in document order."""
    # Two arrays side by side: an array that a lambda looks into may be made again for each element.
    pairs = F.zip_with("parsed.leaves", salts, lambda x, s: F.struct(x["pointer"].alias("pointer"), x["leaf"].alias("leaf"), s.alias("salt")))
    salted = df.withColumn("_pairs", pairs)
    made = F.transform("_pairs", lambda p: F.struct(p["pointer"].alias("pointer"), H.leaf_commitment(p["salt"], p["leaf"]).alias("value")))
    kept = F.transform("_pairs", lambda p: F.struct(p["pointer"].alias("pointer"), p["salt"].alias("value")))
    return salted.withColumns(
        {"payload_json": F.col("parsed.canonical"), "leaf_salts_json": H.pairs_json(kept), "leaf_commitments_json": H.pairs_json(made)}
    ).drop("_pairs", "parsed")


def fold_links(prev: str, contents: list[str]) -> list[str]:
    out = []
    for content in contents:
        prev = hashlib.sha256(SEPARATOR.join((RECORD_PREFIX, prev, content)).encode()).hexdigest()
        out.append(prev)
    return out


def link(narrow: DataFrame, head_hash: str) -> DataFrame:
    """(seq, prev_hash, record_hash) for (seq, content_hash): a fold along seq.

    It can't be split within a chain; only these two columns go to its task.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev, last = head_hash, None
        for frame in frames:
            seqs = frame["seq"].tolist()
            for seq in seqs:
                if last is not None and seq <= last:
                    raise ValueError(f"seq {seq} follows {last}")
                last = seq
            records = fold_links(prev, frame["content_hash"].tolist())
            yield pd.DataFrame({"seq": seqs, "prev_hash": [prev, *records[:-1]], "record_hash": records})
            prev = records[-1] if records else prev

    ordered = narrow.select("seq", "content_hash").repartition(1).sortWithinPartitions("seq")
    return ordered.mapInPandas(fold, "seq long, prev_hash string, record_hash string")


def link_chains(narrow: DataFrame, chain: str, genesis: str) -> DataFrame:
    """The same for many chains at once, each from genesis or from the head_hash
    that its rows name: chains are spread over tasks and each task folds its own
    in order."""
    if "head_hash" not in narrow.columns:
        narrow = narrow.withColumn("head_hash", F.lit(genesis))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_chain, prev, last = None, genesis, None
        for frame in frames:
            before, records = [], []
            for key, seq, content, head in zip(frame[chain], frame["seq"], frame["content_hash"], frame["head_hash"]):
                if last is None or key != open_chain:
                    open_chain, prev, last = key, head, None
                if last is not None and seq <= last:
                    raise ValueError(f"seq {seq} follows {last} in {key}")
                before.append(prev)
                prev, last = fold_links(prev, [content])[0], seq
                records.append(prev)
            yield pd.DataFrame({chain: frame[chain], "seq": frame["seq"], "prev_hash": before, "record_hash": records})

    kind = dict(narrow.dtypes)[chain]
    ordered = narrow.select(chain, "seq", "content_hash", "head_hash").repartition(chain).sortWithinPartitions(chain, "seq")
    return ordered.mapInPandas(fold, f"{chain} {kind}, seq long, prev_hash string, record_hash string")


def chain_head(events: DataFrame, config: LedgerConfig = LedgerConfig()) -> tuple[int, str]:
    """(last seq, last record hash); (0, genesis) of an empty table."""
    row = events.agg(F.max("seq").alias("seq"), F.max_by("record_hash", "seq").alias("hash")).first()
    return (0, config.genesis) if row["seq"] is None else (row["seq"], row["hash"])


def append_events(
    incoming: DataFrame,
    head: tuple[int, str] | None = None,
    order: list[str] | None = None,
    recorded_at: Column | None = None,
    event_id: Column | None = None,
    salts: Column | None = None,
    config: LedgerConfig = LedgerConfig(),
) -> Appended:
    """The rows that a batch of new events adds to a chain with the given head.

    order names columns that give the order of arrival; by default rows keep
    the order of their partitions. Ids, salts and record times may be given for
    tests; by default ids and salts are random and staged before use. The event
    time is the record time where an event names none.
    """
    head = head or (0, config.genesis)
    accepted, rejected, order, incoming = _arrived(incoming, order, recorded_at, event_id)
    rows = with_dense_seq(accepted, order, head[0], made=_committing(salts))
    unstaged(incoming)
    links = staged(link(rows.withColumn("content_hash", H.content_hash()), head[1]), "links")
    return Appended(_linked(rows.join(links, "seq")).select(*EVENT_COLUMNS), rejected, (rows, links))


def append_chains(
    incoming: DataFrame,
    chain: str,
    heads: DataFrame | None = None,
    order: list[str] | None = None,
    recorded_at: Column | None = None,
    event_id: Column | None = None,
    salts: Column | None = None,
    config: LedgerConfig = LedgerConfig(),
) -> Appended:
    """append_events for many independent chains, named by a column of strings
    that the events keep: the fold of each runs beside the others. heads has
    (chain, last_seq, last_hash) of chains to go on from; others begin anew.
    """
    accepted, rejected, order, incoming = _arrived(incoming, order, recorded_at, event_id)
    numbered = with_dense_seq(accepted, [chain, *order], 0, "_n", _committing(salts))
    unstaged(incoming)
    starts = numbered.groupBy(chain).agg(F.min("_n").alias("_first"))
    if heads is None:
        starts = starts.withColumns({"_last": F.lit(0).cast("long"), "head_hash": F.lit(config.genesis)})
    else:
        starts = starts.join(heads.select(chain, F.col("last_seq").alias("_last"), F.col("last_hash").alias("head_hash")), chain, "left").fillna({"_last": 0, "head_hash": config.genesis})
    starts = staged(starts, "starts")
    rows = numbered.join(broadcast_if_small(starts), chain).withColumn("seq", F.col("_last") + F.col("_n") - F.col("_first") + 1).drop("_n", "_first", "_last")
    links = staged(link_chains(rows.withColumn("content_hash", H.content_hash()), chain, config.genesis), "links")
    return Appended(_linked(rows.drop("head_hash").join(links, [chain, "seq"])).select(chain, *EVENT_COLUMNS), rejected, (numbered, starts, links))


def _arrived(incoming: DataFrame, order: list[str] | None, recorded_at: Column | None, event_id: Column | None) -> tuple[DataFrame, DataFrame, list[str], DataFrame]:
    """(accepted, rejected, order columns, table of both): parsed events with ids and times, staged."""
    parsed = incoming.withColumn("parsed", parse_payload(F.col("payload"))).withColumn("reason", rejection())
    if order is None:
        parsed = parsed.withColumn("_arrival", F.monotonically_increasing_id())
        order = ["_arrival"]
    parsed = parsed.withColumns({"event_id": F.uuid() if event_id is None else event_id, "recorded_at_c": H.canonical_instant(F.current_timestamp()) if recorded_at is None else recorded_at})
    parsed = parsed.withColumn("event_ts_c", F.coalesce("timestamp", "recorded_at_c") if "timestamp" in incoming.columns else F.col("recorded_at_c"))
    parsed = staged(parsed, "incoming")
    rejected = staged(parsed.filter(F.col("reason").isNotNull()).select(*[c for c in incoming.columns if c != "reason"], "reason"), "rejected")
    return parsed.filter(F.col("reason").isNull()).drop("reason"), rejected, order, parsed


def _committing(salts: Column | None) -> Callable[[DataFrame], DataFrame]:
    """What adds commitments to rows (which are then staged, as salts are random) and keeps what an event needs of them."""

    def made(rows: DataFrame) -> DataFrame:
        own = committed(rows, random_salts(F.col("parsed.leaves")) if salts is None else salts)
        return own.drop(*[c for c in ("payload", "timestamp") if c in own.columns])

    return made


def _linked(rows: DataFrame) -> DataFrame:
    """Rows with their links and content hashes, which are made again rather than shuffled."""
    return rows.withColumns(
        {"content_hash": H.content_hash(), "event_ts": H.instant_to_timestamp(F.col("event_ts_c")), "recorded_at": H.instant_to_timestamp(F.col("recorded_at_c")), "archived_at": F.lit(None).cast("timestamp")}
    )
