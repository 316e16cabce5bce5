import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import sharding


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_the_published_loop(spark):
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63), *range(1000, 1200), *[k * 0x9E3779B97F4A7C15 % 2**63 for k in range(200)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 7, 40, 1000):
        got = df.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()
        assert all(r["s"] == jump(r["k"], shards) for r in got)


def test_growth_moves_rows_only_into_the_new_shard(small):
    rows = sharding.shard_documents(small("documents"), 40, 16).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)


def test_documents(small):
    docs = {r["doc_id"]: r["text"] for r in small("documents").collect()}
    slots = defaultdict(list)
    for r in sharding.shard_documents(small("documents"), 40, 16).collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 3, 4).collect()
    assert len(rows) == 10 and sharding.shard_documents(no_docs, 3, 4).count() == 0
    null = next(r for r in rows if r["doc_id"] == 3)
    assert (null["size"], null["text_crc32"]) == (16, 0)
    assert len({r["slot"] for r in rows if r["doc_id"] == 1}) == 2
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_repeated_row_is_one_group(spark):
    rows = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_documents(rows, 4, 8)
    assert [r["slot"] for r in got.orderBy("slot").collect()] == list(range(5000))


def test_keys_of_any_type(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert {0 <= r["shard"] < 5 for r in sharding.with_shards(df, "k", 5).collect()} == {True}
