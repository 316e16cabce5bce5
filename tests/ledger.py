"""Small ledgers for tests."""

from pyspark.sql import functions as F

from ledgerloom.operators import append
from ledgerloom.operators.tables import staged

AT = "2026-01-01T00:00:00.000000000Z"
SEED = [
    ("USER_LOGIN", "alice", "acct-1", '{"ip":"10.0.0.1"}'),
    ("ACCOUNT_VIEWED", "alice", "acct-1", '{"ssn":"111-22-3333"}'),
    ("RECORD_UPDATED", "bob", "acct-2", '{"field":"email","to":"x@y.z"}'),
]
INCOMING = "n int, event_type string, actor_id string, resource_type string, resource_id string, payload string, timestamp string"


def incoming(spark, rows):
    return spark.createDataFrame([(i, t, a, "CLIENT_ACCOUNT", r, p, AT) for i, (t, a, r, p) in enumerate(rows, 1)], INCOMING).coalesce(1)


def event_id():
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("n").cast("string"), 12, "0"))


def chain(spark, rows=SEED, head=None):
    made = append.append_events(incoming(spark, rows), head, ["n"], F.lit(AT), event_id())
    return staged(made.events, "chain")


def golden_chain(spark):
    salts = F.expr("transform(parsed.leaves, (x, i) -> concat(repeat('0', 30), if(n = 3, concat('3', i), concat(n, '0'))))")
    made = append.append_events(incoming(spark, SEED), None, ["n"], F.lit(AT), event_id(), salts)
    return staged(made.events, "chain")


def changed(events, seq, **columns):
    return events.withColumns({c: F.when(F.col("seq") == seq, F.lit(v)).otherwise(F.col(c)) for c, v in columns.items()})


def report(df):
    return df.first().asDict(recursive=True)
