"""Retention: full copies go to the archive, tombstones stay in the chain."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import LedgerConfig


@dataclass
class Retained:
    """copies must be written before events, so a crash never loses a payload."""

    copies: DataFrame
    events: DataFrame
    result: DataFrame


def is_due(cutoff: datetime) -> Column:
    return F.col("archived_at").isNull() & (F.col("recorded_at") < F.lit(cutoff))


def run_retention(events: DataFrame, now: datetime, config: LedgerConfig = LedgerConfig()) -> Retained:
    """Archive what was recorded before now less the window. A tombstone keeps
    its hashes and commitments and loses payload and salts. Events of many chains
    keep their chain column; sources/month_tables.py writes only what changes."""
    if not config.retention_enabled:
        raise ValueError("retention is disabled")
    cutoff = now - config.retention_window
    due = is_due(cutoff)
    copies = events.filter(due).withColumn("archived_at", F.lit(now))
    kept = events.withColumn("_due", due).withColumns(
        {
            "payload_json": F.when(~F.col("_due"), F.col("payload_json")),
            "leaf_salts_json": F.when(~F.col("_due"), F.col("leaf_salts_json")),
            "archived_at": F.when(F.col("_due"), F.lit(now)).otherwise(F.col("archived_at")),
        }
    )
    result = copies.agg(F.count(F.lit(1)).alias("archived"), F.coalesce(F.max("seq"), F.lit(0)).alias("through_seq")).withColumn("cutoff", F.lit(cutoff))
    return Retained(copies, kept.select(*events.columns), result)
