"""Access reports for many accounts and time windows at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import messages as M
from ledgerloom.config import REPORT_BUNDLE_FILTER, REPORT_EVENT_TYPE, LedgerConfig
from ledgerloom.functions import hashing as H
from ledgerloom.functions.json_text import json_string
from ledgerloom.operators.bundle import Bundles, export_bundles
from ledgerloom.operators.tables import with_redacted_paths
from ledgerloom.operators.verify import verify_chain

#: Requests that may be sent to every task.
BROADCAST_REQUESTS = 200_000
#: Widths of time bins.
BIN_DAYS = (1, 32, 1024)


@dataclass
class AccessReports:
    headers: DataFrame
    entries: DataFrame
    bundles: Bundles
    rejected: DataFrame
    meta_events: DataFrame


def _day(instant: Column) -> Column:
    return F.unix_date(F.to_date(F.substr(instant, F.lit(1), F.lit(10))))


def _bins(day: Column, days: int) -> Column:
    return F.floor(day / F.lit(days)).cast("long")


def _binned_requests(wanted: DataFrame) -> DataFrame:
    """wanted with (_level, _bin) of the days that each window touches: bins of
    the narrowest width of which it touches 33 at most. A window that is open on
    one side goes with the widest bins from there on, or with none if it has no end."""
    first, last = _day(F.col("from_c")), _day(F.col("to_c"))
    every = F.array(F.struct(F.lit(len(BIN_DAYS)).alias("level"), F.lit(0).cast("long").alias("bin")))
    chosen = every
    for level in reversed(range(len(BIN_DAYS))):
        days = BIN_DAYS[level]
        spread = F.transform(F.sequence(_bins(first, days), F.greatest(_bins(first, days), _bins(last, days))), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))
        chosen = F.when(F.col("from_c").isNotNull() & F.col("to_c").isNotNull() & (last - first <= 32 * days), spread).otherwise(chosen)
    return wanted.withColumn("_at", F.explode(chosen)).select("*", F.col("_at.level").alias("_level"), F.col("_at.bin").alias("_bin")).drop("_at")


def _binned_events(rows: DataFrame) -> DataFrame:
    """rows with the bin of each width that their day lies in."""
    day = _day(F.col("event_ts_c"))
    own = [F.struct(F.lit(level).alias("level"), _bins(day, days).alias("bin")) for level, days in enumerate(BIN_DAYS)]
    own.append(F.struct(F.lit(len(BIN_DAYS)).alias("level"), F.lit(0).cast("long").alias("bin")))
    return rows.withColumn("_at", F.explode(F.array(*own))).select("*", F.col("_at.level").alias("_level2"), F.col("_at.bin").alias("_bin2")).drop("_at")


def matched_events(
    events: DataFrame, requests: DataFrame, config: LedgerConfig = LedgerConfig(), scan_cap: int | None = None, broadcast_requests: int = BROADCAST_REQUESTS
) -> DataFrame:
    """(request_id, seq) of the access events of each request's resource within
    [from_c, to_c). scan_cap=n looks only at the n first rows of each, before
    types are filtered, as a single request of the service does.

    A moderate number of requests is broadcast. More are joined by resource and
    time bins, so that an account with very many rows and very many short windows
    meets a window's rows only, and its bins are spread over tasks.
    """
    wanted = requests.select("request_id", F.col("resource_type").alias("_type"), F.col("resource_id").alias("_id"), "from_c", "to_c")
    rows = events.select("seq", "event_type", "resource_type", "resource_id", "event_ts_c")
    if scan_cap is None:
        rows = rows.filter(F.col("event_type").isin(*config.access_event_types))
    within = (F.col("from_c").isNull() | (F.col("event_ts_c") >= F.col("from_c"))) & (F.col("to_c").isNull() | (F.col("event_ts_c") < F.col("to_c")))
    same = (F.col("resource_type") == F.col("_type")) & (F.col("resource_id") == F.col("_id"))
    if requests.count() <= broadcast_requests:
        found = rows.join(F.broadcast(wanted), same & within)
    else:
        found = _binned_events(rows).join(_binned_requests(wanted), same & (F.col("_level2") == F.col("_level")) & (F.col("_bin2") == F.col("_bin")) & within)
    if scan_cap is not None:
        place = F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))
        found = found.withColumn("_place", place).filter(F.col("_place") <= scan_cap).filter(F.col("event_type").isin(*config.access_event_types))
    return found.select("request_id", "seq")


def access_reports(
    events: DataFrame, requests: DataFrame, generated_at: str, redactions: DataFrame | None = None, config: LedgerConfig = LedgerConfig(), scan_cap: int | None = None
) -> AccessReports:
    """Reports with their bundles. The chain is verified once for all of them,
    before the meta events that record them are appended."""
    fits = F.coalesce(F.col("resource_type").isin(*config.client_data_resource_types), F.lit(False))
    allowed = ", ".join(config.client_data_resource_types)
    reason = F.concat(F.lit(M.RESOURCE_TYPE), F.coalesce("resource_type", F.lit("null")), F.lit(M.NOT_CLIENT_DATA.format(allowed)))
    rejected = requests.filter(~fits).select("request_id", reason.alias("reason"))
    accepted = requests.filter(fits)
    matched = matched_events(events, accepted, config, scan_cap)
    selection = matched.withColumnRenamed("request_id", "bundle_key")
    filters = accepted.select(F.col("request_id").alias("bundle_key"), F.lit(REPORT_BUNDLE_FILTER).alias("filter_type"), F.col("resource_id").alias("filter_value"))
    bundles = export_bundles(events, selection, filters, generated_at, redactions, config)
    counts = matched.groupBy("request_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n"))
    intact = verify_chain(events, redactions, config=config).select(F.col("intact").alias("chain_intact"))
    zero = F.lit(0).cast("long")
    headers = accepted.join(counts, "request_id", "left").select(
        "request_id", "resource_type", "resource_id", "from_c", "to_c", "requested_by",
        F.coalesce("lo", zero).alias("from_seq"), F.coalesce("hi", zero).alias("to_seq"), F.coalesce("n", zero).alias("matched_count"),
    )
    hashes = bundles.headers.select(F.col("bundle_key").alias("request_id"), "bundle_hash")
    headers = headers.join(hashes, "request_id").crossJoin(intact)
    parts = [F.col("resource_type"), F.col("resource_id"), H.short_instant(F.col("from_c")), H.short_instant(F.col("to_c")), F.col("bundle_hash"), F.col("matched_count").cast("string")]
    headers = headers.withColumn("report_hash", H.domain_hash(*parts)).withColumn("generated_at", F.lit(generated_at))
    shown = with_redacted_paths(events, redactions).select("seq", "event_id", "event_type", "actor_id", "event_ts_c", "recorded_at_c", "redacted_paths")
    return AccessReports(headers, matched.join(shown, "seq").select("request_id", *shown.columns), bundles, rejected, _meta_events(headers))


def _meta_events(headers: DataFrame) -> DataFrame:
    payload = H.object_text(
        [
            ("resourceType", json_string(F.col("resource_type"))),
            ("resourceId", json_string(F.col("resource_id"))),
            ("from", json_string(H.short_instant(F.col("from_c")))),
            ("to", json_string(H.short_instant(F.col("to_c")))),
            ("requestedBy", F.coalesce(json_string(F.col("requested_by")), F.lit("null"))),
            ("matchedCount", F.col("matched_count").cast("string")),
            ("reportHash", json_string(F.col("report_hash"))),
            ("bundleHash", json_string(F.col("bundle_hash"))),
        ]
    )
    return headers.select(
        "request_id", F.lit(REPORT_EVENT_TYPE).alias("event_type"), F.col("requested_by").alias("actor_id"), "resource_type", "resource_id",
        payload.alias("payload"), F.lit(None).cast("string").alias("timestamp"),
    )
