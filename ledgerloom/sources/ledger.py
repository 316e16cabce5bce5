"""A whole ledger as Parquet parts that a manifest names.

Events lie in parts by the month of their record time and by key; redactions
don't rewrite them but add patches, which readers merge; archive copies,
redactions and heads of chains are parts too. A commit writes new parts and then
a manifest of all that count, so a job that touches several tables is seen whole
or not at all, and what doesn't change isn't written. A commit claims the number
after the version that it was made from: of two writers that start from one
version, the later one fails, so two appends never follow one head.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.config import LedgerConfig
from ledgerloom.operators import append, redact, retention
from ledgerloom.operators.tables import event_keys, packed, staged, unstaged

MANIFEST = "number long, kind string, month string, folder string, made long"
#: Columns that rows are looked up by, so row groups carry Bloom filters of them.
LOOKED_UP = ("event_id", "actor_id", "resource_id")
#: Bytes of a row group, as Parquet has them by default, and the least that a row takes in the writer's memory.
ROW_GROUP, ROW_BYTES = 128 << 20, 256


def month_of(recorded_at: str = "recorded_at_c") -> Column:
    return F.substr(recorded_at, F.lit(1), F.lit(7))


class Conflict(ValueError):
    """Another writer has made the next version."""


class Ledger:
    """chain names the column of a ledger with many chains; None: it has one."""

    def __init__(self, spark: SparkSession, path: str, chain: str | None = None, row_group_bytes: int | None = None):
        self.spark, self.path, self.chain, self.row_group_bytes = spark, path.rstrip("/"), chain, row_group_bytes
        self.keys = event_keys(chain)

    # --- versions

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """0: nothing is there yet."""
        at, store = self._file(f"{self.path}/manifest")
        if not store.exists(at):
            return 0
        return max((int(f.getPath().getName().partition("=")[2]) for f in store.listStatus(at) if f.getPath().getName().startswith("number=")), default=0)

    def parts(self, *kinds: str) -> list[Row]:
        """The parts that count now: one row for each kind, month and commit."""
        now = self.version()
        if not now:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/number={now}").collect()
        return [r for r in rows if not kinds or r["kind"] in kinds]

    def _commit(self, at: int, added: list[tuple], dropped: tuple | list = ()) -> int:
        """Make version at + 1 of what version `at` has, less `dropped` folders,
        and the added (kind, month, folder). The claim is a file that can be made
        once; one whose writer died before its manifest is given up by release()."""
        claim, store = self._file(f"{self.path}/claims/{at + 1}")
        if self.version() != at or not store.createNewFile(claim):
            raise Conflict(f"version {at + 1} is another writer's; start again from what it has made")
        kept = [(at + 1, r["kind"], r["month"], r["folder"], r["made"]) for r in self.parts() if r["folder"] not in set(dropped)]
        rows = kept + [(at + 1, *part, at + 1) for part in added]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/number={at + 1}")
        return at + 1

    def release(self, number: int) -> None:
        at, store = self._file(f"{self.path}/claims/{number}")
        if self.version() < number:
            store.delete(at, False)

    # --- writing

    def _write(self, kind: str, rows: DataFrame, by_month: bool = True) -> list[tuple]:
        """Write rows as new parts, each month's in order of their keys."""
        folder = f"{self.path}/data/{kind}-{uuid.uuid4().hex}"
        if not by_month:
            packed(rows).parquet(folder)
            return [(kind, None, folder)]
        order = ["month", *self.keys]
        writer = packed(rows.withColumn("month", month_of()).repartitionByRange(*order).sortWithinPartitions(*order)).partitionBy("month")
        # A filter for the rows that a group can have: by default each takes 1 MB, which a file's writer holds to its end.
        values = max((self.row_group_bytes or ROW_GROUP) // ROW_BYTES, 100)
        for column in LOOKED_UP if kind == "events" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
        if self.row_group_bytes:
            writer = writer.option("parquet.block.size", str(self.row_group_bytes))
        writer.parquet(folder)
        at, store = self._file(folder)
        months = sorted(f.getPath().getName().partition("=")[2] for f in store.listStatus(at) if f.getPath().getName().startswith("month="))
        return [(kind, m, f"{folder}/month={m}") for m in months]

    def add(self, events: DataFrame, at: int | None = None) -> int:
        """Append linked rows, made from the heads of version `at`."""
        at = self.version() if at is None else at
        return self._add(staged(events.select(*self.keys[:-1], *schemas.EVENT_COLUMNS), "added"), at)[0]

    def _add(self, rows: DataFrame, at: int) -> tuple[int, list[str]]:
        """(version, folders) of staged rows, which are deleted once they are parts."""
        heads = rows.groupBy(*self.keys[:-1]).agg(F.max("seq").alias("last_seq"), F.max_by("record_hash", "seq").alias("last_hash")).filter("last_seq is not null")
        events = self._write("events", rows)
        number = self._commit(at, [*events, *self._write("heads", heads, by_month=False)])
        unstaged(rows)
        return number, [folder for _, _, folder in events]

    def append(self, incoming: DataFrame, config: LedgerConfig = LedgerConfig(), **options) -> append.Appended:
        """Number, hash and link new events after the current heads, and commit
        them; Conflict if another append came first. options are those of
        append_events or append_chains."""
        at = self.version()
        if self.chain is None:
            head = self.heads().first()
            made = append.append_events(incoming, (head["last_seq"], head["last_hash"]) if head else None, config=config, **options)
        else:
            made = append.append_chains(incoming, self.chain, self.heads() if at else None, config=config, **options)
        _, folders = self._add(made.staged("added"), at)
        return append.Appended(self._load("events", folders), made.rejected)

    def redact(self, requests: DataFrame, run_id: str, redacted_at: Column | None = None, config: LedgerConfig = LedgerConfig()) -> redact.Redacted:
        """Redact leaves: patches of the rows that change and the redactions are
        one commit, whose bytes follow the requests and not the table."""
        at = self.version()
        done = redact.redact(self.read(), self.redactions(), requests, run_id, redacted_at, config, self.chain)
        self._commit(at, [*self._write("patches", done.patches), *self._write("redactions", done.redactions, by_month=False)])
        return done

    def retain(self, now: datetime, config: LedgerConfig = LedgerConfig()) -> list[str]:
        """Archive what is due, and give the months that were written anew: those
        with a row that is due. Copies and tombstones are one commit."""
        at, cutoff = self.version(), now - config.retention_window
        if not config.retention_enabled:
            raise ValueError("retention is disabled")
        known = sorted({r["month"] for r in self.parts("events") if r["month"] <= cutoff.strftime("%Y-%m")})
        due = self.read(known).filter(retention.is_due(cutoff)).select(month_of().alias("month")).distinct() if known else None
        months = sorted(r["month"] for r in due.collect()) if known else []
        if months:
            done = retention.run_retention(self.read(months), now, config)
            self._commit(at, [*self._write("archive", done.copies), *self._write("events", done.events)], self._folders(months, "events", "patches"))
        return months

    def compact(self, months: list[str] | None = None) -> list[str]:
        """Write the months that have patches, or several parts, as one part each."""
        at, n = self.version(), {}
        for r in self.parts("events", "patches"):
            n[r["month"]] = n.get(r["month"], 0) + 1
        months = sorted(m for m in (n if months is None else months) if n.get(m, 0) > 1)
        if months:
            self._commit(at, self._write("events", self.read(months)), self._folders(months, "events", "patches"))
        return months

    # --- reading

    def _folders(self, months: list[str], *kinds: str) -> list[str]:
        return [r["folder"] for r in self.parts(*kinds) if r["month"] in months]

    def _schema(self, kind: str) -> str:
        key = "" if self.chain is None else f"{self.chain} string, "
        patch = f"{key}seq long, payload_json string, leaf_salts_json string, recorded_at_c string"
        shapes = {"events": key + schemas.AUDIT_EVENT, "archive": key + schemas.ARCHIVED_EVENT, "redactions": key + schemas.REDACTION, "heads": f"{key}last_seq long, last_hash string", "patches": patch}
        return shapes[kind]

    def _load(self, kind: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema(kind)).parquet(*folders) if folders else self.spark.createDataFrame([], self._schema(kind))

    def read(self, months: list[str] | None = None) -> DataFrame:
        """Events, those of some months alone if named. Only months that have
        patches are merged with them; the last patch of a row counts."""
        parts = [r for r in self.parts("events", "patches") if months is None or r["month"] in months]
        touched = {r["month"] for r in parts if r["kind"] == "patches"}
        base = {flag: [r["folder"] for r in parts if r["kind"] == "events" and (r["month"] in touched) == flag] for flag in (False, True)}
        rows = self._load("events", base[False])
        if not touched:
            return rows
        last = None
        for r in parts:
            if r["kind"] == "patches":
                some = self._load("patches", [r["folder"]]).withColumn("made", F.lit(r["made"]))
                last = some if last is None else last.unionByName(some)
        last = last.groupBy(*self.keys).agg(F.max_by(F.struct("payload_json", "leaf_salts_json"), "made").alias("p")).select(*self.keys, "p.*")
        merged = redact.patched(self._load("events", base[True]), last, self.chain)
        return merged.unionByName(rows) if base[False] else merged

    def archive(self) -> DataFrame:
        return self._load("archive", [r["folder"] for r in self.parts("archive")])

    def redactions(self) -> DataFrame:
        return self._load("redactions", [r["folder"] for r in self.parts("redactions")])

    def heads(self) -> DataFrame:
        """(chain, last_seq, last_hash): each append adds those of its chains."""
        rows = self._load("heads", [r["folder"] for r in self.parts("heads")])
        last = rows.groupBy(*self.keys[:-1]).agg(F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash"))
        return last.filter("last_seq is not null")
