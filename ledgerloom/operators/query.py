"""Filtered and paged reads of the event table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import instant_to_timestamp
from ledgerloom.operators.tables import with_redacted_paths

DEFAULT_PAGE, MAX_PAGE = 50, 200
VIEW = ["seq", "event_id", "event_type", "actor_id", "resource_type", "resource_id", "payload_json", "redacted_paths", "event_ts_c", "recorded_at_c", "content_hash", "prev_hash", "record_hash", "archived"]


@dataclass(frozen=True)
class EventFilter:
    """All criteria that are given hold; times are canonical instants and the
    range is [from_c, to_c)."""

    actor_id: str | None = None
    resource_type: str | None = None
    resource_id: str | None = None
    event_type: str | None = None
    from_c: str | None = None
    to_c: str | None = None

    def predicate(self) -> Column:
        """Text decides to the nanosecond; the timestamp, which the scan has
        statistics for, skips files and row groups."""
        terms = [F.col(c) == getattr(self, c) for c in ("actor_id", "resource_type", "resource_id", "event_type") if getattr(self, c) is not None]
        if self.from_c is not None:
            terms += [F.col("event_ts_c") >= self.from_c, F.col("event_ts") >= instant_to_timestamp(F.lit(self.from_c))]
        if self.to_c is not None:
            terms += [F.col("event_ts_c") < self.to_c, F.col("event_ts") <= instant_to_timestamp(F.lit(self.to_c))]
        return reduce(and_, terms, F.lit(True))


def find_events(events: DataFrame, where: EventFilter) -> DataFrame:
    return events.filter(where.predicate())


def by_event_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def by_event_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("event_id"), "event_id", "left_semi")


def seq_range(events: DataFrame, first: int, last: int) -> DataFrame:
    return events.filter(F.col("seq").between(first, last))


def by_seqs(events: DataFrame, seqs: DataFrame) -> DataFrame:
    return events.join(seqs.select("seq"), "seq", "left_semi")


def event_view(events: DataFrame, redactions: DataFrame | None = None) -> DataFrame:
    """What a reader of events sees: redacted paths, archived or not, no salts."""
    return with_redacted_paths(events, redactions).withColumn("archived", F.col("archived_at").isNotNull()).select(*VIEW)


def page(events: DataFrame, where: EventFilter, number: int = 0, size: int = DEFAULT_PAGE, redactions: DataFrame | None = None) -> DataFrame:
    """One page by seq. The page is cut first; only its rows meet the redactions."""
    number, size = max(number, 0), min(max(size, 1), MAX_PAGE)
    rows = find_events(events, where).orderBy("seq").offset(number * size).limit(size)
    return event_view(rows, redactions).orderBy("seq")


def page_after(events: DataFrame, where: EventFilter, last_seq: int, size: int = DEFAULT_PAGE, redactions: DataFrame | None = None) -> DataFrame:
    """The page that follows a seq: a deep page costs no more than the first."""
    rows = find_events(events, where).filter(F.col("seq") > last_seq).orderBy("seq").limit(min(max(size, 1), MAX_PAGE))
    return event_view(rows, redactions).orderBy("seq")


def page_info(events: DataFrame, where: EventFilter, number: int = 0, size: int = DEFAULT_PAGE) -> DataFrame:
    number, size = max(number, 0), min(max(size, 1), MAX_PAGE)
    total = find_events(events, where).agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / F.lit(size)).cast("long")
    return total.select(F.lit(number).alias("page"), F.lit(size).alias("size"), "total", pages.alias("total_pages"), (F.lit(number + 1) < pages).alias("has_next"))
