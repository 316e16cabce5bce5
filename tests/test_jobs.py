import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import LedgerConfig
from ledgerloom.functions import hashing as H
from ledgerloom.operators import append, bundle, compliance, query, redact, retention, verify
from ledgerloom.operators.tables import staged
from ledgerloom.schemas import ACCESS_REQUEST, AUDIT_EVENT, REDACTION_REQUEST
from ledgerloom.sources import json_io
from ledgerloom.sources.ledger_tables import EventTable, read_archive, read_redactions, write_archive, write_redactions
from ledgerloom.streaming import jobs
from tests.ledger import AT, chain, changed, event_id, incoming, report

NO_REDACTIONS = "event_seq long, field_path string"
NOW = datetime(2030, 1, 1)
TEST = LedgerConfig(hmac_secret="test-hmac-secret", access_event_types=("ACCOUNT_VIEWED", "ACCOUNT_STATEMENT_DOWNLOADED", "ACCOUNT_SEARCHED"), retention_window=timedelta(0))


def eid(n):
    return f"00000000-0000-0000-0000-{n:012d}"


CLERK = [("ACCOUNT_VIEWED", "clerk-9", "acct-1", '{"accountNumber":"4444333322221111","note":"routine check"}'), ("B", "b", "acct-2", '{"x":{"y":[1,2]}}'), ("C", "c", "acct-3", "{}")]


def run_redaction(spark, events, requests, taken=()):
    known = spark.createDataFrame(list(taken), NO_REDACTIONS)
    done = redact.redact(events, known, spark.createDataFrame(requests, REDACTION_REQUEST), "run", F.lit(NOW), TEST)
    return done, {r["request_id"]: r["reason"] for r in done.rejected.collect()}


def test_redaction(spark):
    events = chain(spark, CLERK)
    done, rejected = run_redaction(spark, events, [("r1", eid(1), ["/accountNumber"], "gdpr", "dpo", None)])
    assert rejected == {}
    row = done.redactions.first()
    assert row["salt_retained"] and row["field_salt"] and row["reason"] == "gdpr" and row["event_seq"] == 1
    after = staged(done.events, "after")
    payload = json.loads(after.filter("seq = 1").first()["payload_json"])
    assert payload == {"accountNumber": f"__REDACTED__:{row['redaction_id']}", "note": "routine check"}
    assert "accountNumber" not in after.filter("seq = 1").first()["leaf_salts_json"]
    redactions = staged(done.redactions, "redactions")
    assert report(verify.verify_chain(after, redactions))["intact"]
    sibling = changed(after, 1, payload_json=json.dumps(payload | {"note": "tampered"}))
    assert report(verify.verify_chain(sibling, redactions))["first_inconsistency"]["violation_type"] == "LEAF_COMMITMENT_MISMATCH"
    meta = done.meta_events.first()
    assert (meta["event_type"], meta["resource_type"], meta["resource_id"], meta["actor_id"]) == ("AUDIT_RECORD_REDACTED", "AUDIT_EVENT", eid(1), "dpo")
    assert json.loads(meta["payload"]) == {"targetEventId": eid(1), "targetSeq": 1, "reason": "gdpr", "redactedBy": "dpo", "saltRetained": True, "fieldPaths": ["/accountNumber"]}
    grown = after.unionByName(append.append_events(done.meta_events, append.chain_head(after)).events)
    assert report(verify.verify_chain(grown, redactions))["records_checked"] == 4
    proofs = spark.createDataFrame([(1, "/accountNumber", "S4444333322221111"), (1, "/accountNumber", "S1"), (1, "/note", "Sx")], "event_seq long, field_path string, leaf string")
    assert {r["leaf"]: r["verdict"] for r in redact.check_disclosures(redactions, proofs).collect()} == {"S4444333322221111": "proven", "S1": "refuted", "Sx": "unknown"}


def test_redaction_rejects(spark):
    events = changed(chain(spark, CLERK), 2, actor_id="b").withColumn("archived_at", F.when(F.col("seq") == 2, F.lit(NOW)))
    one = ["/note"]
    requests = [
        ("a1", "nobody", one, "", "d", None), ("a2", eid(2), ["/x/y/0"], "", "d", None), ("a3", eid(1), [], "", "d", None), ("a4", eid(1), None, "", "d", None),
        ("a5", eid(1), ["/note", "/doesNotExist"], "", "d", None), ("a6", eid(1), ["/note", "/note"], "", "d", None), ("a7", eid(3), [""], "", "d", None), ("a8", None, one, "", "d", None),
        ("b1", eid(1), ["/accountNumber"], "", "d", None), ("b2", eid(1), one, "", "d", False), ("b3", eid(1), one, "", "d", None),
    ]
    done, rejected = run_redaction(spark, events, requests, [(1, "/accountNumber")])
    assert rejected == {
        "a1": "no audit event nobody", "a2": "cannot redact archived record seq=2", "a3": "fieldPaths must not be empty", "a4": "fieldPaths must not be empty",
        "a5": "payload has no leaf at /doesNotExist", "a6": "/note is already redacted on seq 1", "a7": "the payload itself cannot be redacted", "a8": "no audit event null",
        "b1": "/accountNumber is already redacted on seq 1", "b3": "a leaf is redacted by an earlier request on seq 1",
    }
    row = done.redactions.collect()
    assert [(r["field_path"], r["salt_retained"], r["field_salt"]) for r in row] == [("/note", False, None)]


def test_redaction_conflicts_as_in_turn(spark):
    """A request that is turned away takes no leaf from a later one."""
    events = chain(spark, [("A", "a", "r", '{"a":1,"b":2,"c":3}')])
    requests = [("r1", eid(1), ["/a"], "", "d", None), ("r2", eid(1), ["/a", "/b"], "", "d", None), ("r3", eid(1), ["/b"], "", "d", None), ("r4", eid(1), ["/c", "/b"], "", "d", None)]
    done, rejected = run_redaction(spark, events, requests)
    assert set(rejected) == {"r2", "r4"} and sorted(r["field_path"] for r in done.redactions.collect()) == ["/a", "/b"]


def test_retention(spark):
    events = chain(spark, [("A", "a", "r", f'{{"k":{i}}}') for i in (1, 2, 3)])
    done = retention.run_retention(events, NOW, TEST)
    assert (report(done.result)["archived"], report(done.result)["through_seq"]) == (3, 3)
    kept, copies = staged(done.events, "kept"), staged(done.copies, "copies")
    assert kept.filter("payload_json is null and leaf_salts_json is null").count() == 3
    for deep in (False, True):
        got = report(verify.verify_chain(kept, archive=copies, deep=deep))
        assert got["intact"] and got["archived_segments"] == [{"from_seq": 1, "to_seq": 3}] and got["deep"] == deep
    forged = changed(copies, 2, payload_json='{"k":999}')
    assert report(verify.verify_chain(kept, archive=forged))["intact"]
    assert report(verify.verify_chain(kept, archive=forged, deep=True))["first_inconsistency"]["seq"] == 2
    assert report(verify.verify_chain(kept, archive=changed(copies, 2, actor_id="x"), deep=True))["intact"]  # live fields are what is hashed
    assert report(verify.verify_chain(kept, archive=copies.filter("seq != 3"), deep=True))["first_inconsistency"]["detail"] == "archived row has no archive copy"
    none = retention.run_retention(kept, NOW, TEST)
    assert (report(none.result)["archived"], report(none.result)["through_seq"]) == (0, 0)
    with pytest.raises(ValueError):
        retention.run_retention(events, NOW, LedgerConfig(retention_enabled=False))


def test_redact_then_archive(spark):
    done, _ = run_redaction(spark, chain(spark, [("A", "a", "r", '{"ssn":"111-22-3333","ok":1}')]), [("r", eid(1), ["/ssn"], "", "d", None)])
    redactions = staged(done.redactions, "redactions")
    kept = retention.run_retention(staged(done.events, "after"), NOW, TEST)
    for deep in (False, True):
        assert report(verify.verify_chain(kept.events, redactions, kept.copies, deep=deep))["intact"]


THREE = [("A", "u1", "acct-1", '{"k":1.50,"s":"é\\u0001\\"","e":{}}'), ("B", "u2", "acct-2", '{"k":2}'), ("C", "u1", "acct-1", '{"k":3}')]


def exported(spark, events=None):
    events = chain(spark, THREE) if events is None else events
    return bundle.export_bundles(events, *bundle.select_by(events, "resource_id", "resourceId"), AT, config=TEST)


def verdicts(found):
    return {r["bundle_key"]: (r["valid"], r["problems"]) for r in found.collect()}


def test_bundles(spark, tmp_path):
    made = exported(spark)
    assert sorted((r["from_seq"], r["to_seq"]) for r in made.segments.filter("bundle_key = 'resourceId=acct-1'").collect()) == [(1, 1), (3, 3)]
    assert verdicts(bundle.verify_bundles(made, "test-hmac-secret", listed=True)) == {"resourceId=acct-1": (True, []), "resourceId=acct-2": (True, [])}
    wrong = verdicts(bundle.verify_bundles(made, "other", listed=True))
    assert wrong["resourceId=acct-2"] == (False, ["hmac mismatch"])
    forged = bundle.Bundles(made.headers, changed(made.records, 1, payload_json='{"k":999,"s":"x","e":{}}'), made.segments)
    valid, problems = verdicts(bundle.verify_bundles(forged, listed=True))["resourceId=acct-1"]
    assert not valid and problems == ["bundle hash mismatch", "leaf /k modified at seq 1", "leaf /s modified at seq 1"]
    headers = made.headers.withColumn("bundle_hash", F.lit("0" * 64))
    assert verdicts(bundle.verify_bundles(bundle.Bundles(headers, made.records, made.segments), listed=True))["resourceId=acct-2"][1] == ["bundle hash mismatch"]
    twice = bundle.Bundles(made.headers, made.records.unionByName(made.records.filter("seq = 3")), made.segments)
    assert verdicts(bundle.verify_bundles(twice, listed=True))["resourceId=acct-1"] == (False, ["bundle hash mismatch"])
    gone = bundle.Bundles(made.headers, made.records.filter("seq != 3"), made.segments)
    assert "segment record missing: seq 3" in verdicts(bundle.verify_bundles(gone, listed=True))["resourceId=acct-1"][1]
    json_io.write_bundle_rows(made, f"{tmp_path}/bundles")
    back = json_io.read_bundles(spark, f"{tmp_path}/bundles")
    assert verdicts(bundle.verify_bundles(back, "test-hmac-secret", listed=True)) == {"resourceId=acct-1": (True, []), "resourceId=acct-2": (True, [])}
    text = json.loads(json_io.bundle_text(made).filter("bundle_key = 'resourceId=acct-1'").first()["value"])
    assert set(text) == {"bundleVersion", "exportedAt", "filter", "genesisHash", "records", "segments", "bundleHash", "hmac"} and len(text["records"][0]) == 16


def test_segments_by_walking_them(spark):
    """Forged segments and records against a walk over each segment."""
    rng = random.Random(6)
    records, segments = [], []
    for b in range(30):
        have = sorted(rng.sample(range(1, 40), rng.randint(0, 30)))
        hashes = {s: f"h{b}-{s}" for s in have}
        for s in have:
            records.append((f"b{b}", s, hashes.get(s - 1, "x") if rng.random() < 0.8 else "broken", hashes[s]))
        for _ in range(rng.randint(0, 5)):
            first = rng.randint(1, 40)
            segments.append((f"b{b}", first, first + rng.choice([-1, 0, 3, 10, 2**40]), rng.choice(["x", f"h{b}-{first - 1}", None])))
    by_key, expected = {(r[0], r[1]): r for r in records}, set()
    for key, first, last, prior in segments:
        for s in range(first, min(last, first + 60) + 1):
            if (key, s) not in by_key:
                expected.add((key, f"segment record missing: seq {s}"))
                break
            if by_key[key, s][2] != (prior if s == first else by_key[key, s - 1][3]):
                expected.add((key, f"broken chain link at seq {s}"))
    records = spark.createDataFrame(records, "bundle_key string, seq long, prev_hash string, record_hash string")
    segments = spark.createDataFrame(segments, "bundle_key string, from_seq long, to_seq long, prior_record_hash string")
    got = {tuple(r) for r in bundle._segment_problems(records, segments).collect()}
    assert got == expected and len(expected) > 50


def test_bundle_without_anchor_fails(spark):
    events = chain(spark, THREE)
    with pytest.raises(Exception, match="predecessor of seq 3 missing"):
        exported(spark, events.filter("seq != 2")).segments.collect()
    with pytest.raises(ValueError):
        bundle.selector("a", "b")
    assert bundle.selector(" ", "b") == ("actor_id", "b")


ACCESS = [("ACCOUNT_VIEWED", "clerk-1", "acct-1", "{}"), ("ACCOUNT_STATEMENT_DOWNLOADED", "clerk-2", "acct-1", "{}"), ("USER_LOGIN", "clerk-1", "acct-1", "{}"), ("ACCOUNT_VIEWED", "clerk-3", "acct-2", "{}")]


def test_compliance(spark):
    events = chain(spark, ACCESS)
    window = ("2025-01-01T00:00:00.000000000Z", "2027-01-01T00:00:00.000000000Z")
    requests = [("q1", "CLIENT_ACCOUNT", "acct-1", *window, "dpo"), ("q2", "SERVER_CONFIG", "s", None, None, "dpo"), ("q3", "CLIENT_ACCOUNT", "none", None, None, "dpo")]
    made = compliance.access_reports(events, spark.createDataFrame(requests, ACCESS_REQUEST), AT, config=TEST)
    headers = {r["request_id"]: r for r in made.headers.collect()}
    assert set(headers) == {"q1", "q3"} and headers["q1"]["matched_count"] == 2 and headers["q1"]["chain_intact"]
    assert (headers["q3"]["from_seq"], headers["q3"]["to_seq"], headers["q3"]["matched_count"]) == (0, 0, 0)
    assert [(r["seq"], r["actor_id"]) for r in made.entries.orderBy("seq").collect()] == [(1, "clerk-1"), (2, "clerk-2")]
    assert all(ok for ok, _ in verdicts(bundle.verify_bundles(made.bundles, TEST.hmac_secret, listed=True)).values())
    assert made.rejected.first()["reason"] == "resourceType 'SERVER_CONFIG' is not classified as client account data; allowed: [CLIENT_ACCOUNT, CLIENT_ACCOUNT_STATEMENT]"
    meta = {r["request_id"]: json.loads(r["payload"]) for r in made.meta_events.collect()}["q1"]
    assert list(meta) == ["resourceType", "resourceId", "from", "to", "requestedBy", "matchedCount", "reportHash", "bundleHash"]
    assert meta["from"] == "2025-01-01T00:00:00Z" and meta["reportHash"] == headers["q1"]["report_hash"]
    capped = compliance.matched_events(events, spark.createDataFrame(requests[:1], ACCESS_REQUEST), TEST, scan_cap=1)
    assert [r["seq"] for r in capped.collect()] == [1]


def test_query_and_paging(spark):
    events = chain(spark, [("A", "alice", "acct-1", "{}"), ("A", "bob", "acct-2", "{}"), ("B", "alice", "acct-1", "{}")])
    where = query.EventFilter
    seqs = lambda df: [r["seq"] for r in df.orderBy("seq").collect()]
    assert seqs(query.find_events(events, where(actor_id="bob"))) == [2] and seqs(query.find_events(events, where())) == [1, 2, 3]
    assert seqs(query.find_events(events, where(from_c=AT))) == [1, 2, 3] and seqs(query.find_events(events, where(to_c=AT))) == []
    assert seqs(query.page(events, where(), -1, 2)) == [1, 2] and seqs(query.page(events, where(), 1, 2)) == [3]
    assert seqs(query.page(events, where(), 0, 0)) == [1]
    info = report(query.page_info(events, where(), 0, 2))
    assert (info["total"], info["total_pages"], info["has_next"]) == (3, 2, True)
    assert seqs(query.page_after(events, where(actor_id="alice"), 1)) == [3]
    assert seqs(query.by_event_id(events, eid(2))) == [2] and seqs(query.seq_range(events, 2, 3)) == [2, 3]
    assert seqs(query.by_seqs(events, spark.createDataFrame([(3,)], "seq long"))) == [3]
    assert seqs(query.by_event_ids(events, spark.createDataFrame([(eid(1),)], "event_id string"))) == [1]
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = query.find_events(events, where(actor_id="bob", from_c=AT))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(actor_id,bob)" in plan and "GreaterThanOrEqual(event_ts," in plan


def test_event_table_versions(spark, tmp_path):
    table = EventTable(spark, f"{tmp_path}/events")
    table.create(chain(spark))
    table.append(append.append_events(incoming(spark, ACCESS[:1]), append.chain_head(table.read()), ["n"]).events)
    done = retention.run_retention(table.read(), NOW, TEST)
    write_archive(done.copies, f"{tmp_path}/archive")
    table.replace(done.events)
    assert table.current()[0] == 2 and table.read().filter("archived_at is not null").count() == 4
    assert report(verify.verify_chain(table.read(), archive=read_archive(spark, f"{tmp_path}/archive"), deep=True))["intact"]
    rows, _ = run_redaction(spark, chain(spark, CLERK), [("r", eid(1), ["/note"], "", "d", None)])
    write_redactions(rows.redactions, f"{tmp_path}/redactions")
    assert read_redactions(spark, f"{tmp_path}/redactions").first()["field_path"] == "/note"


def test_streams(spark, tmp_path):
    spark.range(0)
    lines = [json.dumps({"eventType": t, "actorId": a, "resourceType": "X", "resourceId": r, "payload": json.loads(p)}) for t, a, r, p in THREE * 2]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(lines[:4]))
    assert json_io.read_new_events(spark, f"{tmp_path}/in").first()["payload"].startswith('{"k": 1.5')  # text as it came

    def drain():
        stream = json_io.stream_new_events(spark, f"{tmp_path}/in")
        jobs.continuous_append(stream, f"{tmp_path}/ledger", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    drain()
    (tmp_path / "in/2.json").write_text("\n".join(lines[4:]))
    drain()
    events = spark.read.parquet(f"{tmp_path}/ledger/events").drop("batch")
    assert report(verify.verify_chain(events))["records_checked"] == 6 and report(verify.verify_chain(events))["intact"]
    first = report(jobs.incremental_verify(events.filter("seq <= 4"), f"{tmp_path}/checks"))
    assert (first["from_seq"], first["to_seq"], first["intact"]) == (1, 4, True)
    later = report(jobs.incremental_verify(changed(events, 6, actor_id="x"), f"{tmp_path}/checks"))
    assert (later["from_seq"], later["violation_seq"], later["violation_type"]) == (5, 6, "CONTENT_HASH_MISMATCH")


def test_payload_text_hash_functions_agree(spark):
    row = chain(spark, THREE).filter("seq = 1").first()
    assert json.loads(row["payload_json"])["k"] == 1.5 and set(json.loads(row["leaf_commitments_json"])) == {"/k", "/s", "/e"}
    assert spark.createDataFrame([row], AUDIT_EVENT).select(H.content_hash()).first()[0] == row["content_hash"] and event_id is not None


def test_a_stream_batch_that_runs_again(spark, tmp_path):
    """It replaces its rows and its head, so the next batch goes on from what is there."""
    rows = incoming(spark, THREE)

    class Source:
        """The writer that continuous_append sets up, called by hand."""

        def __getattr__(self, name):
            return lambda *a: (setattr(self, "write", a[0]) if name == "foreachBatch" else None) or self

    class Stream:
        writeStream = Source()

    jobs.continuous_append(Stream, f"{tmp_path}/ledger", f"{tmp_path}/cp", ["n"])
    write = Stream.writeStream.write
    for batch_id in (0, 1, 1, 2):
        write(rows, batch_id)
    events = spark.read.parquet(f"{tmp_path}/ledger/events").drop("batch")
    got = report(verify.verify_chain(events))
    assert got["intact"] and got["records_checked"] == 9


def test_two_writers_of_one_version(spark, tmp_path):
    table = EventTable(spark, f"{tmp_path}/events")
    table.create(chain(spark))
    table.replace(table.read())
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        table._publish(table.read(), 2)
    assert table.current()[0] == 2
