"""The driver's `events` table as new events of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import canonical_instant, sha256_hex

N_ACCOUNTS = 40


def event_id_of(number: Column) -> Column:
    digest = sha256_hex(F.concat(F.lit("event-"), number.cast("string")))
    return F.concat_ws("-", *[F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event requests with their number `n` and given id, in order of n.

    clicks and views are account accesses; the account is the user's modulo
    N_ACCOUNTS, every fourth one not client data.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.upper("event_type")
    types = F.when(kind == "VIEW", "ACCOUNT_VIEWED").when(kind == "CLICK", "ACCOUNT_SEARCHED").otherwise(kind)
    account = F.pmod("user_id", F.lit(N_ACCOUNTS))
    value = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    payload = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"value":'), value, F.lit("}"))
    return rows.select(
        F.col("event_id").alias("n"),
        event_id_of(F.col("event_id")).alias("given_id"),
        types.alias("event_type"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_id"),
        F.when(F.pmod("user_id", F.lit(4)) == 3, "SERVER_CONFIG").otherwise("CLIENT_ACCOUNT").alias("resource_type"),
        F.concat(F.lit("acct-"), account.cast("string")).alias("resource_id"),
        payload.alias("payload"),
        canonical_instant(F.col("ts")).alias("timestamp"),
    )
