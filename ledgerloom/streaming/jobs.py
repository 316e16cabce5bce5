"""The two ledger jobs that are streams: appending, and checking what is new."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom import messages as M
from ledgerloom.config import DUPLICATE_KEY, LedgerConfig
from ledgerloom.operators.append import append_events, chain_head
from ledgerloom.operators.verify import verify_chain
from ledgerloom.sources.ledger_tables import read_events, write_events

BATCHES = "batch_id long, last_seq long, last_hash string"
CHECKS = "batch_id long, from_seq long, to_seq long, intact boolean, violation_seq long, violation_type string"


def _state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows below a folder of parts; an empty first part makes the folder."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/part=none")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _note(row: DataFrame, path: str, number: int) -> None:
    """Write the row of a number; a repeat replaces it."""
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={number}")


def continuous_append(stream: DataFrame, events_path: str, checkpoint: str, order: list[str] | None = None, config: LedgerConfig = LedgerConfig(), **append_options):
    """Append each micro-batch to the event table, one at a time.

    A batch is written below its number, and so is its head. A batch that runs
    again after a failure replaces both, though ids and salts are drawn anew;
    the head it goes on from is that of the batches before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            known = _state(spark, f"{events_path}/batches", BATCHES).filter(F.col("batch_id") < batch_id)
            before = known.agg(F.max_by(F.struct("last_seq", "last_hash"), "batch_id").alias("head")).first()["head"]
        head = (before["last_seq"], before["last_hash"]) if before else (0, config.genesis)
        made = append_events(batch, head, order, config=config, **append_options)
        write_events(made.events, f"{events_path}/events/batch={batch_id}", "overwrite")
        last = chain_head(read_events(spark, f"{events_path}/events/batch={batch_id}"), config)
        last = last if last[0] else head
        _note(spark.createDataFrame([(batch_id, *last)], BATCHES), f"{events_path}/batches", batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def incremental_verify(events: DataFrame, state_path: str, config: LedgerConfig = LedgerConfig()) -> DataFrame:
    """Check what lies past the last seq that a run found intact, anchored at
    the record before it, and note the result in the state table."""
    spark = events.sparkSession
    done = _state(spark, state_path, CHECKS)
    last = done.filter("intact").agg(F.coalesce(F.max("to_seq"), F.lit(0))).first()[0]
    number = done.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0] + 1
    report = verify_chain(events, from_seq=last + 1, config=config) if last else verify_chain(events, config=config)
    row = report.select(
        F.lit(number).cast("long").alias("batch_id"), "from_seq", "to_seq", "intact",
        F.col("first_inconsistency.seq").alias("violation_seq"), F.col("first_inconsistency.violation_type").alias("violation_type"),
    )
    result = row.first()
    if result["to_seq"] >= result["from_seq"]:
        _note(spark.createDataFrame([tuple(result)], CHECKS), state_path, result["batch_id"])
    return spark.createDataFrame([tuple(result)], CHECKS)


def continuous_verify(stream: DataFrame, events_path: str, state_path: str, checkpoint: str, config: LedgerConfig = LedgerConfig()):
    """Run incremental_verify whenever the event stream brings rows."""

    def check(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            incremental_verify(read_events(batch.sparkSession, events_path), state_path, config)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)


FOUND = "chain string, seq long, event_id string, violation_type string, detail string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChainLinks(StatefulProcessor):
    """Follows the links of each chain: its state is the last seq and record hash."""

    def __init__(self, genesis: str):
        self.genesis = genesis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, record_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chain, out = key[0], []
        seq, before = self.last.get() if self.last.exists() else (0, self.genesis)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")  # narrow rows of one chain and one batch
        for at, event_id, prev, record in zip(batch["seq"], batch["event_id"], batch["prev_hash"], batch["record_hash"]):
            if at <= seq:
                out.append((chain, at, event_id, DUPLICATE_KEY, f"seq {at} comes after seq {seq}"))
                continue
            if at > seq + 1:
                out.append((chain, seq + 1, None, "SEQUENCE_GAP", M.GAP.format(seq + 1, at)))
            elif at == 1 and prev != before:
                out.append((chain, at, event_id, "GENESIS_MISMATCH", M.GENESIS_DIFFERS))
            elif prev != before:
                out.append((chain, at, event_id, "PREV_HASH_MISMATCH", M.LINK_DIFFERS))
            seq, before = int(at), record
        self.last.update((seq, before))
        yield pd.DataFrame(out, columns=["chain", "seq", "event_id", "violation_type", "detail"]).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def follow_chains(stream: DataFrame, chain: str, config: LedgerConfig = LedgerConfig()) -> DataFrame:
    """A stream of (chain, seq, event_id, violation_type, detail): gaps, broken
    links and seqs that come again, as rows of many chains arrive. Chains are
    followed beside each other; what is kept of each survives a restart with the
    checkpoint. Rows of a chain come in the order of its seqs, batch by batch."""
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)  # the only store for such states
    rows = stream.select(F.col(chain).alias("chain"), "seq", "event_id", "prev_hash", "record_hash")
    return rows.groupBy("chain").transformWithStateInPandas(ChainLinks(config.genesis), FOUND, "Append", "None")
