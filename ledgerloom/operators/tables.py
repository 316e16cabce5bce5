"""Small plan pieces that several jobs use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, Window
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session names none, a session on one machine gets a temporary one;
    on a cluster that is an error, as executors couldn't read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return context.getCheckpointDir().rstrip("/")


#: Shuffle files go when the action that made them ends, not when the driver happens to collect its garbage.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def packed(df: DataFrame) -> DataFrameWriter:
    """A writer of Parquet for rows that are mostly hex digits, which zstd halves and snappy doesn't."""
    df.sparkSession.conf.set(SHORT_SHUFFLES, "true")
    return df.write.option("compression", "zstd")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. What was drawn at random or
    numbered by place is settled there, so a retried task can't change it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    packed(df).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(*tables: DataFrame) -> None:
    """Delete the staged tables that these read, which nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_dense_seq(df: DataFrame, order: list[str], start: int | Column, name: str = "seq", made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Number all rows from start + 1 without gaps, in the order of columns.

    Range partitions are sorted and stored with each row's place; the counts of
    the partitions before are added. No task sees more than its partition. What
    `made` adds to each row is settled by the same write.
    """
    placed = made(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    placed = staged(placed.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    start = F.lit(start) if isinstance(start, int) else start
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, start + F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def with_running_max(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the largest `value` so far within its key, in the order of columns.

    Rows are dealt in ranges of key and order, so a key with most of the rows is
    spread over tasks; what a key had in earlier ranges is added. Only the first
    and last key of a range can go on elsewhere: two rows of each range decide.
    """
    placed = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = staged(placed.withColumn("_part", F.spark_partition_id()), "ranges")
    so_far = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.max(value).over(so_far))
    names = F.struct(*key)
    edges = placed.groupBy("_part").agg(F.min(names).alias("lo"), F.max(names).alias("hi"))
    edges = edges.select("_part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k")).select("_part", "k.*")
    totals = placed.join(F.broadcast(edges), ["_part", *key], "left_semi").groupBy("_part", *key).agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_part", *key, F.max("_top").over(earlier).alias("_carried"))
    joined = own.join(F.broadcast(carried), ["_part", *key], "left")
    return joined.withColumn(name, F.greatest("_own", "_carried")).drop("_part", "_own", "_carried")


def contiguous_runs(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, from_seq, to_seq) of the runs of seqs of each key. A run's first and
    last row have no neighbour; the i-th first belongs to the i-th last, numbered
    over all keys in range partitions, so no key's runs are one task's."""
    rows = rows.select(*key, "seq").distinct()
    by = [*key, "seq"]
    firsts = rows.join(rows.select(*key, (F.col("seq") + 1).alias("seq")), by, "left_anti").withColumnRenamed("seq", "from_seq")
    lasts = rows.join(rows.select(*key, (F.col("seq") - 1).alias("seq")), by, "left_anti").select(F.col("seq").alias("to_seq"), *[F.col(k).alias(f"_{k}") for k in key])
    firsts = with_dense_seq(firsts, [*key, "from_seq"], 0, "_n")
    lasts = with_dense_seq(lasts, [*[f"_{k}" for k in key], "to_seq"], 0, "_n")
    return firsts.join(lasts, "_n").select(*key, "from_seq", "to_seq")


def event_keys(chain: str | None) -> list[str]:
    """What tells a row of an event table: its seq, and its chain where there are many."""
    return ["seq"] if chain is None else [chain, "seq"]


def redacted_paths(redactions: DataFrame, chain: str | None = None) -> DataFrame:
    """(keys, redacted_paths) of the events that have any, paths in order."""
    keys = event_keys(chain)
    return redactions.withColumnRenamed("event_seq", "seq").groupBy(*keys).agg(F.array_sort(F.collect_list("field_path")).alias("redacted_paths"))


#: Rows of some hundred bytes that may be sent to every task.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more rows than these."""
    return F.broadcast(df) if df.count() <= rows else df


def with_redacted_paths(events: DataFrame, redactions: DataFrame | None, chain: str | None = None) -> DataFrame:
    if redactions is None:
        return events.withColumn("redacted_paths", F.array().cast("array<string>"))
    joined = events.join(redacted_paths(redactions, chain), event_keys(chain), "left")
    return joined.withColumn("redacted_paths", F.coalesce("redacted_paths", F.array().cast("array<string>")))
