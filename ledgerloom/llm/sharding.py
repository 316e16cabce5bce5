"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions.

The shard of a row depends on its key and on the number of shards alone; there
is no ring table. Going from n to n + 1 shards moves 1 / (n + 1) of the keys,
all of them to the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import MASK32

#: Multiplier of the published generator: key = key * 2862933555777941757 + 1 mod 2^64.
_FACTOR = 2862933555777941757
SLOTS_AT_ONCE = 1 << 16
ROWS_A_BUCKET = 250_000
_FACTOR_HI, _FACTOR_LO = _FACTOR >> 32, _FACTOR & MASK32


def _times(a: Column, b: int) -> Column:
    """a * b for 32-bit a and b, as (low 48 bits' part, part to shift by 16)."""
    return F.shiftright(a, 16) * F.lit(b), a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)


def _low32(a: Column, b: int) -> Column:
    """a * b mod 2^32 without a product over 63 bits (SQL arithmetic may not wrap)."""
    upper, lower = _times(a, b)
    return (lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))


def _step(state: Column, shards: int) -> Column:
    """One jump. state: the 64-bit key in halves, the last bucket, the next one."""
    upper, lower = _times(state["lo"], _FACTOR_LO)
    low_sum = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    lo = low_sum.bitwiseAND(F.lit(MASK32))
    carry = F.shiftright(low_sum, 32) + F.shiftright(upper, 16)
    hi = (carry + _low32(state["hi"], _FACTOR_LO) + _low32(state["lo"], _FACTOR_HI)).bitwiseAND(F.lit(MASK32))
    jump = (state["j"] + F.lit(1)) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))
    moved = F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), jump.cast("long").alias("j"))
    return F.when(state["j"] < F.lit(shards), moved).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a long key; a null key counts as 0.

    The number of jumps is about ln(shards); a first loop is long enough for
    nearly all keys, and the few that need more go on in a loop of `shards`
    steps, which always suffices.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK32)).alias("lo"), zero.alias("b"), zero.alias("j")
    )
    usual = min(shards, 8 + 2 * math.ceil(math.log(shards + 1)))

    def loop(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda acc, _: _step(acc, shards))

    first = loop(start, usual)
    if usual == shards:
        return first["b"].cast("int")
    return F.transform(
        F.array(first), lambda s: F.when(s["j"] < F.lit(shards), loop(s, shards)["b"]).otherwise(s["b"]).cast("int")
    )[0]


def key_of(column: Column, kind: str) -> Column:
    """A long key: whole numbers as they are, anything else by its XXH64."""
    return column.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(column)


def with_shards(df: DataFrame, key_col: str, shards: int, out_col: str = "shard") -> DataFrame:
    """df with the shard of each row; every other column stays, rows included
    that repeat. A column named out_col must not exist yet."""
    if out_col in df.columns:
        raise ValueError(f"column {out_col} exists already")
    kind = dict(df.dtypes)[key_col]
    return df.withColumn(out_col, jump_shard(key_of(F.col(f"`{key_col}`"), kind), shards))


def with_slots(df: DataFrame, shard_col: str, order_cols: list[str], buckets: int) -> DataFrame:
    """Number the rows of every shard from 0 without gaps, column `slot`.

    df must hold shard_col and order_cols alone or columns they decide. Rows
    that are equal are first counted (so a row that makes up a third of the
    table is one group), the counts are summed within `buckets` hash parts of
    each shard, and the parts start where the ones before them end. No task
    holds a shard. Rows lie by part, which is the first 32 bits of the MD5 of
    order_cols (joined by commas) modulo buckets, then by order_cols.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    digest = F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in order_cols]).cast("binary"))
    counted = counted.withColumn("_bucket", F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(buckets)))
    part = Window.partitionBy(shard_col, "_bucket")
    before = part.orderBy(*order_cols, *[c for c in columns if c not in order_cols]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = counted.groupBy(shard_col, "_bucket").agg(F.sum("_n").alias("_n"))
    base = base.select(
        F.col(shard_col).alias("_shard"),
        F.col("_bucket").alias("_part"),
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(shard_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_base"),
    )
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = placed.join(base, (F.col(shard_col) == F.col("_shard")) & (F.col("_bucket") == F.col("_part")))
    first = F.col("_base") + F.col("_before")
    # in two steps, so that a row with very many repeats needs no array as long as they are
    placed = placed.select(*columns, (first + F.col("_n") - 1).alias("_last"), F.explode(F.sequence(first, first + F.col("_n") - 1, F.lit(SLOTS_AT_ONCE))).alias("_first"))
    slots = F.sequence("_first", F.least(F.col("_first") + (SLOTS_AT_ONCE - 1), F.col("_last")))
    return placed.select(*columns, F.explode(slots).alias("slot"))


def shard_documents(
    docs: DataFrame, shards: int, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """Where every document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The text leaves the scan as its length and CRC-32 only. Null text has size
    `overhead` and the CRC of no bytes; null ids share a shard; repeated rows
    keep a slot each; an empty table gives no row; other columns are ignored.
    Unless given, the number of hash parts follows that of the rows.
    """
    if buckets is None:
        buckets = max(16, -(-docs.count() // ROWS_A_BUCKET))
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    kind = dict(docs.dtypes)[id_col]
    key = key_of(F.col(id_col), kind)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    numbered = with_slots(narrow, "shard", ["doc_id", "size", "text_crc32"], buckets)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
