"""Ledger tables as Parquet: event table versions, archive and redactions.

Parquet has no update, so a job that changes rows writes a new version of the
event table and then names it in a one-row `current` table; readers resolve
that name when they start, and a job that dies before it leaves the old version.
These are the plain tables of one chain or many; ledger.py has commits that claim
a version and write only what changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators.tables import event_keys, packed


def _named(schema: str, chain: str | None) -> str:
    return schema if chain is None else f"{chain} string, {schema}"


def write_events(events: DataFrame, path: str, mode: str = "errorifexists", chain: str | None = None) -> None:
    """Rows lie by (chain and) seq, so seq ranges and recent times touch few files."""
    keys = event_keys(chain)
    rows = events.select(*keys[:-1], *schemas.EVENT_COLUMNS)
    packed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).mode(mode).parquet(path)


def read_events(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    return spark.read.schema(_named(schemas.AUDIT_EVENT, chain)).parquet(path)


def write_archive(copies: DataFrame, path: str, chain: str | None = None) -> None:
    packed(copies.select(*event_keys(chain)[:-1], *schemas.EVENT_COLUMNS)).mode("append").parquet(path)


def read_archive(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    return spark.read.schema(_named(schemas.ARCHIVED_EVENT, chain)).parquet(path)


def write_redactions(rows: DataFrame, path: str) -> None:
    packed(rows).mode("append").parquet(path)


def read_redactions(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    return spark.read.schema(_named(schemas.REDACTION, chain)).parquet(path)


class EventTable:
    """An event table in versions below one folder, in any store Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame:
        return self.spark.read.schema("number long, name string").option("recursiveFileLookup", "true").parquet(f"{self.path}/current")

    def current(self) -> tuple[int, str]:
        row = self.versions().agg(F.max("number").alias("number"), F.max_by("name", "number").alias("name")).first()
        return row["number"], row["name"]

    def create(self, events: DataFrame) -> None:
        self._publish(events, 1)

    def read(self) -> DataFrame:
        return read_events(self.spark, f"{self.path}/{self.current()[1]}")

    def append(self, events: DataFrame) -> None:
        """Add rows to the current version; one writer at a time."""
        write_events(events, f"{self.path}/{self.current()[1]}", "append")

    def replace(self, events: DataFrame) -> None:
        """Write a whole new version, then make it the current one."""
        self._publish(events, self.current()[0] + 1)

    def _publish(self, events: DataFrame, number: int) -> None:
        """Each number's pointer has a folder of its own and is never overwritten:
        of two writers that replace the same version, the later one fails."""
        name = f"v{number}-{uuid.uuid4().hex[:8]}"
        write_events(events, f"{self.path}/{name}")
        pointer = self.spark.createDataFrame([(number, name)], "number long, name string").coalesce(1)
        pointer.write.mode("errorifexists").parquet(f"{self.path}/current/number={number}")
