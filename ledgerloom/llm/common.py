"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.tables import shared_dir

MASK32 = 0xFFFFFFFF


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A folder for what `stored` writes within the block; it goes at the end of
    the block, so what is wanted beyond it is stored as lasting."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage
    ends there, so a lost executor costs one read, not a recomputation."""
    spark = df.sparkSession
    folder = None if lasting else _scratch.get()
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; lower() would also change other alphabets."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
