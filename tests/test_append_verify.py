import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import GENESIS
from ledgerloom.functions import hashing as H
from ledgerloom.operators import append, verify
from ledgerloom.operators.tables import staged, with_dense_seq
from tests.ledger import SEED, chain, changed, event_id, incoming, report


def check(events, **options):
    return report(verify.verify_chain(events, **options))


def test_rejections(spark):
    rows = [("A", "a", "r", "{}"), (" \t", "a", "r", "{}"), ("A", None, "r", "{}"), ("A", "a" * 201, "r", "{}"), ("A", "a" * 200, "r", "{}"), ("A", "a", "r", '"nope"'), ("A", "a", "r", "{"), ("A", "a", "r", None), ("A", "😀" * 101, "r", "{}")]
    made = append.append_events(incoming(spark, rows), order=["n"])
    assert [r["actor_id"] for r in made.events.orderBy("seq").collect()] == ["a", "a" * 200]
    assert [(r["n"], r["reason"]) for r in made.rejected.orderBy("n").collect()] == [
        (2, "event_type is blank"), (3, "actor_id is blank"), (4, "actor_id is too long"), (6, "payload is not a JSON object"),
        (7, "payload is not a JSON object"), (8, "payload is missing"), (9, "actor_id is too long"),
    ]


def test_dense_seq(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = with_dense_seq(rows, ["k"], 10).orderBy("k").collect()
    assert [r["seq"] for r in got] == list(range(11, 1011))
    plan = with_dense_seq(rows, ["k"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan or "BroadcastExchange" in plan


def test_append_in_two_batches_is_one_chain(spark):
    whole = chain(spark).orderBy("seq").collect()
    first = append.append_events(incoming(spark, SEED[:2]), None, ["n"], F.lit("2026-01-01T00:00:00.000000000Z"), event_id()).events
    head = append.chain_head(first)
    second = append.append_events(incoming(spark, SEED[2:]), head, ["n"]).events
    assert [r["seq"] for r in second.collect()] == [3] and whole[0]["prev_hash"] == GENESIS
    assert check(chain(spark)) | {"archived_segments": []} == check(first.unionByName(second))
    assert append.chain_head(first.limit(0)) == (0, GENESIS)


def test_random_salts_differ_and_event_time_defaults(spark):
    rows = incoming(spark, SEED).withColumn("timestamp", F.lit(None).cast("string"))
    events = append.append_events(rows, order=["n"]).events
    got = events.collect()
    assert len({r["leaf_salts_json"] for r in got}) == 3 and all(r["event_ts_c"] == r["recorded_at_c"] for r in got)
    assert len({r["event_id"] for r in got}) == 3


def test_actor_chains(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "chain string, seq long, content_hash string")
    got = {(r["chain"], r["seq"]): r for r in append.link_chains(rows, "chain", GENESIS).collect()}
    assert got["a", 3]["prev_hash"] == got["a", 1]["record_hash"] and got["b", 2]["prev_hash"] == GENESIS
    assert got["a", 1]["record_hash"] == append.fold_links(GENESIS, ["x"])[0]


def test_intact_empty_and_bounds(spark):
    events = chain(spark)
    assert check(events)["records_checked"] == 3 and check(events)["intact"]
    empty = check(events.limit(0))
    assert empty["intact"] and (empty["records_checked"], empty["from_seq"], empty["to_seq"]) == (0, 0, 0)
    part = check(events, from_seq=2, to_seq=99)
    assert (part["records_checked"], part["from_seq"], part["to_seq"]) == (2, 2, 3)
    none = check(events, from_seq=5)
    assert none["intact"] and (none["records_checked"], none["from_seq"], none["to_seq"]) == (0, 5, 0)
    with pytest.raises(ValueError):
        check(events.filter("seq > 1"))


@pytest.mark.parametrize(
    "change, seq, kind",
    [
        (dict(actor_id="mallory"), 2, "CONTENT_HASH_MISMATCH"),
        (dict(payload_json='{"ssn":"999-99-9999"}'), 2, "LEAF_COMMITMENT_MISMATCH"),
        (dict(payload_json="{}"), 2, "LEAF_COMMITMENT_MISMATCH"),
        (dict(payload_json='{"ssn":"111-22-3333","more":1}'), 2, "LEAF_COMMITMENT_MISMATCH"),
        (dict(leaf_salts_json="{}"), 2, "MISSING_SALT"),
        (dict(record_hash="0" * 64), 2, "RECORD_HASH_MISMATCH"),
        (dict(prev_hash="0" * 64), 2, "PREV_HASH_MISMATCH"),
        (dict(prev_hash="0" * 64), 1, "GENESIS_MISMATCH"),
    ],
)
def test_tampering(spark, change, seq, kind):
    got = check(changed(chain(spark), seq, **change))
    assert not got["intact"] and got["to_seq"] == seq and got["records_checked"] == seq
    assert (got["first_inconsistency"]["seq"], got["first_inconsistency"]["violation_type"]) == (seq, kind)


def test_deletion_and_cut_tail(spark):
    events = chain(spark)
    gap = check(events.filter("seq != 2"))
    assert gap["first_inconsistency"] == {"seq": 2, "event_id": None, "violation_type": "SEQUENCE_GAP", "detail": "expected seq 2 but next present record is 3"}
    last = events.filter("seq = 3").first()
    assert check(events.filter("seq < 3"))["intact"]
    cut = check(events.filter("seq < 3"), expected_head=(3, last["record_hash"]))
    assert cut["first_inconsistency"]["detail"] == "records end at seq 2 but chain head is 3"
    assert check(events, expected_head=(3, last["record_hash"]))["intact"]
    assert check(events.filter("seq > 1"), from_seq=1)["first_inconsistency"]["seq"] == 1


def test_redacted_leaves_are_skipped(spark):
    events = changed(chain(spark), 3, payload_json='{"to":"x@y.z"}')
    redactions = spark.createDataFrame([(3, "/field")], "event_seq long, field_path string")
    assert check(events, redactions=redactions)["intact"]
    assert check(changed(events, 3, payload_json="{}"), redactions=redactions)["first_inconsistency"]["detail"] == "payload leaf /to is missing (structure changed)"


def test_duplicate_keys(spark):
    events = chain(spark)
    twice = events.unionByName(events.filter("seq = 2"))
    assert sorted((r["key"], r["n"]) for r in verify.duplicate_keys(twice).collect()) == [("event_id", 2), ("seq", 2)]
    assert verify.duplicate_keys(events).isEmpty()


def walk(rows, first, last, bad):
    """The walk that the report stands for, record by record."""
    expected, checked, runs, open_run, before = first, 0, [], None, None
    for seq, archived in rows:
        if not first <= seq <= last:
            continue
        checked += 1
        if seq != expected:
            if open_run:
                runs.append((open_run, before))
            return (False, checked, seq, runs, expected)
        if seq in bad:
            return (False, checked, seq, runs, seq)
        if archived:
            open_run = open_run or seq
        elif open_run:
            runs.append((open_run, before))
            open_run = None
        before, expected = seq, seq + 1
    if open_run:
        runs.append((open_run, before))
    if expected <= last:
        return (False, checked, expected - 1, runs, expected)
    return (True, checked, last, runs, None)


def test_report_against_a_walk(spark):
    base = chain(spark, [("A", "a", "r", f'{{"k":{i}}}') for i in range(12)])
    base.cache().count()
    rng = random.Random(5)
    for _ in range(8):
        gone = {s for s in range(2, 13) if rng.random() < 0.12}
        bad = {s for s in range(1, 13) if rng.random() < 0.1} - gone
        archived = {s for s in range(1, 13) if rng.random() < 0.5}
        events = base.filter(~F.col("seq").isin(gone or {0})).withColumns(
            {
                "archived_at": F.when(F.col("seq").isin(archived or {0}), F.timestamp_seconds(F.lit(1))),
                "content_hash": F.when(F.col("seq").isin(bad or {0}), F.lit("f" * 64)).otherwise(F.col("content_hash")),
            }
        )
        got = check(events)
        rows = [(s, s in archived) for s in range(1, 13) if s not in gone]
        intact, checked, to_seq, runs, violation = walk(rows, 1, max(s for s, _ in rows), bad)
        found = got["first_inconsistency"]
        assert (got["intact"], got["records_checked"], got["to_seq"], found and found["seq"]) == (intact, checked, to_seq, violation)
        assert [(r["from_seq"], r["to_seq"]) for r in got["archived_segments"]] == runs


def test_no_full_rows_in_one_partition(spark):
    plan = verify.row_violations(chain(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_duplicate_keys_are_told(spark):
    """An exact copy of a row, and a second row whose hashes are sound."""
    events = chain(spark, [("A", "a", "r", f'{{"k":{i}}}') for i in range(5)])
    twice = staged(events.unionByName(events.filter("seq = 3")), "twice")
    got = report(verify.verify_chain(twice))
    assert not got["intact"] and got["first_inconsistency"]["violation_type"] == "DUPLICATE_KEY"
    assert (got["first_inconsistency"]["seq"], got["first_inconsistency"]["detail"]) == (3, f"2 rows have event_id {events.filter('seq = 3').first()['event_id']}")
    forged = events.filter("seq = 5").withColumns({"actor_id": F.lit("mallory"), "event_id": F.lit("other")}).withColumn("content_hash", H.content_hash())
    forged = forged.withColumn("record_hash", H.record_hash(F.col("prev_hash"), F.col("content_hash")))
    got = report(verify.verify_chain(staged(events.unionByName(forged), "forged")))
    assert not got["intact"] and got["first_inconsistency"]["detail"] == "2 rows have seq 5"
    assert report(verify.verify_chain(twice, from_seq=4))["intact"]


def test_many_archived_runs(spark):
    rows = spark.range(1, 201).select(F.col("id").alias("seq"), F.when(F.col("id") % 4 < 2, F.lit("2024-01-01").cast("timestamp")).alias("archived_at"))
    got = sorted(tuple(r) for r in verify.archived_runs(rows, 2, 199).collect())
    want, run = [], []
    for i in range(2, 200):
        if i % 4 < 2:
            run.append(i)
        elif run:
            want.append((run[0], run[-1]))
            run = []
    assert got == want + ([(run[0], run[-1])] if run else [])
