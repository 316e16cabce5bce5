"""Many chains, the stored ledger and what works on parts of it."""

import json
import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import LedgerConfig
from ledgerloom.operators import append, bundle, checkpoints, compliance, query, redact, verify
from ledgerloom.operators.tables import contiguous_runs, staged, with_running_max
from ledgerloom.schemas import ACCESS_REQUEST, REDACTION_REQUEST
from ledgerloom.sources import json_io
from ledgerloom.sources.ledger import Conflict, Ledger
from ledgerloom.streaming import jobs
from tests.ledger import AT, chain, changed, event_id, incoming, report

NOW = datetime(2030, 1, 1)
TEST = LedgerConfig(hmac_secret="test-hmac-secret", retention_window=timedelta(0))


def rows_of(n, owner="a"):
    return [("ACCOUNT_VIEWED", owner, f"acct-{i % 3}", f'{{"k":{i},"v":"x{i}"}}') for i in range(n)]


def many(spark, sizes=(("a", 5), ("b", 3), ("c", 1))):
    rows = [(name, r) for name, n in sizes for r in rows_of(n, name)]
    random.Random(1).shuffle(rows)
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(rows, 1)], "n int, chain string")
    return incoming(spark, [r for _, r in rows]).join(names, "n")


def ledger_of(spark, path, sizes=(("a", 5), ("b", 3), ("c", 1))):
    ledger = Ledger(spark, f"file://{path}", "chain")
    ledger.append(many(spark, sizes), TEST, order=["n"], recorded_at=F.lit(AT), event_id=event_id())
    return ledger


def verdicts(df):
    return {r["chain"]: (r["intact"], r["records_checked"], r["violation_seq"], r["violation_type"]) for r in df.collect()}


def files(path):
    return {str(f): f.stat().st_size for f in Path(path).rglob("*.parquet")}


def test_chains_are_checked_by_ranges_and_heads(spark, tmp_path):
    ledger = ledger_of(spark, tmp_path)
    events, heads = staged(ledger.read(), "events"), staged(ledger.heads(), "heads")
    assert verdicts(verify.verify_chains(events, "chain", heads=heads)) == {"a": (True, 5, None, None), "b": (True, 3, None, None), "c": (True, 1, None, None)}
    cut = events.filter("not (chain = 'a' and seq = 3) and not (chain = 'b' and seq = 3) and chain != 'c'")
    assert verdicts(verify.verify_chains(cut, "chain")) == {"a": (False, 3, 3, "SEQUENCE_GAP"), "b": (True, 2, None, None)}
    got = verify.verify_chains(cut, "chain", heads=heads)
    assert verdicts(got) == {"a": (False, 3, 3, "SEQUENCE_GAP"), "b": (False, 2, 3, "SEQUENCE_GAP"), "c": (False, 0, 1, "SEQUENCE_GAP")}
    assert {r["chain"]: r["detail"] for r in got.collect()}["c"] == "records end at seq 0 but chain head is 1"
    other = heads.withColumn("last_hash", F.when(F.col("chain") == "b", F.lit("0" * 64)).otherwise(F.col("last_hash")))
    assert verdicts(verify.verify_chains(events, "chain", heads=other))["b"] == (False, 3, 3, "RECORD_HASH_MISMATCH")
    ranges = spark.createDataFrame([("a", 4, None), ("b", 1, 2), ("c", 5, 9)], "chain string, from_seq long, to_seq long")
    got = {r["chain"]: (r["intact"], r["records_checked"], r["from_seq"], r["to_seq"], r["detail"]) for r in verify.verify_chains(cut.unionByName(events.filter("chain = 'c'")), "chain", ranges=ranges).collect()}
    assert got["a"][0] is None and got["a"][4] == "predecessor of seq 4 is missing; the range can't be anchored"
    assert got["b"][:4] == (True, 2, 1, 2) and got["c"][:4] == (True, 0, 5, 0)


def test_chains_keep_their_redactions_and_copies_apart(spark, tmp_path):
    """Equal seqs of other chains neither excuse a leaf nor lend a copy."""
    ledger = ledger_of(spark, tmp_path)
    ids = {(r["chain"], r["seq"]): r["event_id"] for r in ledger.read().collect()}
    requests = [("r1", ids["a", 2], ["/v"], "gdpr", "dpo", None), ("r2", ids["b", 3], ["/k"], "gdpr", "dpo", False), ("r3", ids["b", 3], ["/k"], "late", "dpo", None)]
    done = ledger.redact(spark.createDataFrame(requests, REDACTION_REQUEST), "run", F.lit(NOW), TEST)
    assert [r["request_id"] for r in done.rejected.collect()] == ["r3"] and {r["chain"] for r in ledger.redactions().collect()} == {"a", "b"}
    events = staged(ledger.read(), "events")
    assert all(v[0] for v in verdicts(verify.verify_chains(events, "chain", ledger.redactions(), config=TEST)).values())
    wrong = ledger.redactions().withColumn("chain", F.lit("c"))
    assert verdicts(verify.verify_chains(events, "chain", wrong, config=TEST)) == {"a": (False, 2, 2, "MISSING_SALT"), "b": (False, 3, 3, "MISSING_SALT"), "c": (True, 1, None, None)}
    assert ledger.retain(NOW, TEST) == ["2026-01"]
    events, copies = staged(ledger.read(), "events"), staged(ledger.archive(), "copies")
    deep = verify.verify_chains(events, "chain", ledger.redactions(), copies, deep=True, config=TEST)
    assert all(r["intact"] and r["archived_runs"] == 1 for r in deep.collect())
    lent = copies.filter("not (chain = 'b' and seq = 1)")
    found = verify.verify_chains(events, "chain", ledger.redactions(), lent, deep=True, config=TEST)
    assert {r["chain"]: r["detail"] for r in found.collect()} == {"a": None, "b": "archived row has no archive copy", "c": None}
    proof = spark.createDataFrame([("a", 2, "/v", "Sx1"), ("c", 2, "/v", "Sx1")], "chain string, event_seq long, field_path string, leaf string")
    assert {r["verdict"] for r in redact.check_disclosures(ledger.redactions(), proof, "chain").filter("chain = 'c'").collect()} == {"unknown"}


def test_two_appends_never_follow_one_head(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}")
    options = {"order": ["n"], "recorded_at": F.lit(AT), "event_id": event_id()}
    ledger.append(incoming(spark, rows_of(3)), TEST, **options)
    at, head = ledger.version(), ledger.heads().first()
    late = append.append_events(incoming(spark, rows_of(2)), (head["last_seq"], head["last_hash"]), ["n"]).events
    ledger.append(incoming(spark, rows_of(2)), TEST, order=["n"])
    with pytest.raises(Conflict):
        ledger.add(late, at)
    assert report(verify.verify_chain(ledger.read()))["records_checked"] == 5
    claim, store = ledger._file(f"{ledger.path}/claims/{ledger.version() + 1}")
    store.createNewFile(claim)  # a writer that died
    with pytest.raises(Conflict):
        ledger.append(incoming(spark, rows_of(1)), TEST, order=["n"])
    ledger.release(ledger.version() + 1)
    ledger.append(incoming(spark, rows_of(1)), TEST, order=["n"])
    assert report(verify.verify_chain(ledger.read()))["records_checked"] == 6


def months_ledger(spark, path):
    ledger = Ledger(spark, f"file://{path}")
    at = F.concat(F.lit("2024-0"), F.ceil(F.col("n") / 50).cast("string"), F.lit("-10T00:00:00.000000000Z"))
    ledger.append(incoming(spark, rows_of(200)), TEST, order=["n"], recorded_at=at, event_id=event_id())
    return ledger


def test_bytes_written_follow_the_change(spark, tmp_path):
    """A redaction writes patches alone, retention the months that have due rows,
    compaction the months that have patches."""
    ledger = months_ledger(spark, tmp_path)
    first = files(tmp_path / "data")
    ledger.redact(spark.createDataFrame([("r", f"00000000-0000-0000-0000-{60:012d}", ["/v"], "", "d", None)], REDACTION_REQUEST), "run", F.lit(NOW), TEST)
    second = files(tmp_path / "data")
    assert all(second[f] == n for f, n in first.items()) and not any("/events-" in f for f in set(second) - set(first))
    assert json.loads(ledger.read().filter("seq = 60").first()["payload_json"])["v"].startswith("__REDACTED__")
    assert report(verify.verify_chain(ledger.read(), ledger.redactions(), config=TEST))["intact"]
    ledger.redact(spark.createDataFrame([("r", f"00000000-0000-0000-0000-{60:012d}", ["/k"], "", "d", None)], REDACTION_REQUEST), "run2", F.lit(NOW), TEST)
    again = json.loads(ledger.read().filter("seq = 60").first()["payload_json"])
    assert again["v"].startswith("__REDACTED__") and again["k"].startswith("__REDACTED__")
    before = files(tmp_path / "data")
    assert ledger.compact() == ["2024-02"] and {f.split("month=")[1][:7] for f in set(files(tmp_path / "data")) - set(before)} == {"2024-02"}
    assert not ledger.parts("patches") and json.loads(ledger.read().filter("seq = 60").first()["payload_json"]) == again
    before = files(tmp_path / "data")
    assert ledger.retain(datetime(2024, 2, 11), TEST) == ["2024-01", "2024-02"]
    assert {f.split("month=")[1][:7] for f in set(files(tmp_path / "data")) - set(before)} == {"2024-01", "2024-02"}
    assert ledger.retain(datetime(2024, 2, 11), TEST) == []
    got = report(verify.verify_chain(ledger.read(), ledger.redactions(), ledger.archive(), deep=True, config=TEST))
    assert got["intact"] and got["archived_segments"] == [{"from_seq": 1, "to_seq": 100}]
    one = ledger.read(["2024-03"])
    assert one.count() == 50 and all("month=2024-03" in f for f in one.inputFiles())


def test_lookups_skip_row_groups(spark, tmp_path):
    """A point read by id gets rows of few row groups from the scan."""
    from pyspark.sql import Row

    ledger = Ledger(spark, f"file://{tmp_path}", row_group_bytes=1 << 14)
    ledger.add(chain(spark, [("A", f"actor-{i}", f"acct-{i}", f'{{"k":{i}}}') for i in range(3000)]))

    def scanned(df) -> int:
        rows = df.collect()
        assert len(rows) == 1 and isinstance(rows[0], Row)
        nodes, found = [df._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            if node.nodeName().startswith("Scan parquet"):
                found.append(node.metrics().apply("numOutputRows").value())
            if node.nodeName() == "AdaptiveSparkPlan":
                nodes.append(node.executedPlan())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        return sum(found)

    events = ledger.read()
    last = f"00000000-0000-0000-0000-{1777:012d}"
    assert scanned(query.by_event_id(events, last)) <= 1500
    assert scanned(query.find_events(events, query.EventFilter(actor_id="actor-77"))) <= 1500
    assert scanned(query.find_events(events, query.EventFilter(resource_id="acct-2500"))) <= 1500


def exchanged(df) -> list[str]:
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\n(?:Input[^\n]*)", text)


def test_no_exchange_carries_a_payload(spark):
    events = chain(spark)
    redactions = spark.createDataFrame([(3, "/field")], "event_seq long, field_path string")
    for found in (verify.row_violations(events, redactions), verify.row_violations(events, redactions, events, deep=True), verify.neighbours(events)):
        inputs = exchanged(found)
        assert inputs and not any("payload_json" in x or "leaf_salts_json" in x for x in inputs)


def test_buckets_meet_at_their_borders(spark, monkeypatch):
    """The smallest buckets give what one large one gives."""
    events = changed(chain(spark, rows_of(40)).filter("seq not in (7, 8, 20)"), 30, record_hash="0" * 64)
    events = staged(events.withColumn("archived_at", F.when(F.col("seq") % 5 < 3, F.lit(NOW))), "events")
    whole = sorted(map(tuple, verify.row_violations(events).collect()))
    reports = [report(verify.verify_chain(events, from_seq=a)) for a in (1, 10, 22)]
    for size in (1, 2, 7):
        monkeypatch.setattr(verify, "BUCKET", size)
        assert sorted(map(tuple, verify.row_violations(events).collect())) == whole
        assert [report(verify.verify_chain(events, from_seq=a)) for a in (1, 10, 22)] == reports
    assert [r["first_inconsistency"]["seq"] for r in reports] == [7, 20, 30]


def test_runs_and_running_maxima_of_hot_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaab"), rng.randrange(400), rng.choice([None, rng.randrange(1000)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, seq long, v long").repartition(7)
    expected = set()
    for k in "ab":
        seqs = sorted({s for x, s, _ in rows if x == k})
        start = 0
        for i in range(1, len(seqs) + 1):
            if i == len(seqs) or seqs[i] != seqs[i - 1] + 1:
                expected.add((k, seqs[start], seqs[i - 1]))
                start = i
    assert set(map(tuple, contiguous_runs(df, ["k"]).collect())) == expected
    first = {}
    for k, s, v in rows:
        first.setdefault((k, s), v)
    one = spark.createDataFrame([(k, s, v) for (k, s), v in first.items()], "k string, seq long, v long")
    got = {(r["k"], r["seq"]): r["top"] for r in with_running_max(one.repartition(5), ["k"], ["seq"], "v", "top").collect()}
    top, want = {}, {}
    for (k, s), v in sorted(first.items()):
        top[k] = max(top.get(k, -1), -1 if v is None else v)
        want[k, s] = None if top[k] < 0 else top[k]
    assert got == want


def test_conflicts_are_those_of_a_walk(spark):
    rng = random.Random(9)
    paths, taken, lost = [], {}, set()
    for i in range(400):
        seq, asked = rng.randrange(6), rng.sample("abcdefgh", rng.randint(1, 3))
        paths += [(f"r{i:04d}", seq, p) for p in asked]
        own = taken.setdefault(seq, set())
        if own & set(asked):
            lost.add(f"r{i:04d}")
        else:
            own |= set(asked)
    df = spark.createDataFrame(paths, "request_id string, seq long, field_path string").repartition(5)
    assert {r["request_id"] for r in redact._conflict_losers(df).collect()} == lost
    assert redact._conflict_losers(df.limit(0)).isEmpty()


def test_range_digests(spark):
    events = chain(spark, rows_of(60))
    before = staged(checkpoints.range_digests(events, 8), "digests")
    assert checkpoints.changed_ranges(before, checkpoints.range_digests(events.repartition(5), 8)).isEmpty()
    tree = checkpoints.tree(before)
    assert tree.agg(F.max("level")).first()[0] == 1 and tree.filter("level = 1").first()["n"] == 60
    assert verify.row_violations(checkpoints.rows_of_ranges(events, before.limit(0), 8)).isEmpty()
    bad = staged(changed(events, 23, record_hash="0" * 64), "bad")
    found = checkpoints.check_changed(bad, before, size=8)
    assert sorted((r["seq"], r["violation_type"]) for r in found.collect()) == [(23, "RECORD_HASH_MISMATCH"), (24, "PREV_HASH_MISMATCH")]
    some = checkpoints.changed_ranges(before, checkpoints.range_digests(bad, 8))
    assert [(r["node"], r["change"]) for r in some.collect()] == [(2, "changed")]
    assert checkpoints.rows_of_ranges(bad, some, 8).count() == 8
    plan = checkpoints.rows_of_ranges(bad, some, 8)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq,16)" in plan  # the scan skips the other ranges' row groups
    twice = bad.unionByName(bad.filter("seq = 40")).filter("seq != 3")
    changes = checkpoints.changed_ranges(before, checkpoints.range_digests(twice, 8))
    assert sorted(r["node"] for r in changes.collect()) == [0, 2, 5]
    keyed = events.withColumn("chain", F.lit("x"))
    own = staged(checkpoints.range_digests(keyed, 8, "chain"), "digests")
    assert checkpoints.check_changed(changed(keyed, 23, actor_id="m"), own, size=8, chain="chain").first()["seq"] == 23


def test_a_stream_follows_chains(spark, tmp_path):
    """Gaps, wrong links, seqs that come again; the state survives a restart."""
    ledger = ledger_of(spark, tmp_path / "ledger", (("a", 6), ("b", 4)))
    rows = ledger.read().withColumn("prev_hash", F.when((F.col("chain") == "b") & (F.col("seq") == 3), F.lit("0" * 64)).otherwise(F.col("prev_hash")))
    rows = staged(rows.filter("not (chain = 'a' and seq = 4)"), "rows")
    for part in ("seq <= 2", "seq > 2", "chain = 'a' and seq = 6"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = jobs.follow_chains(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "chain", TEST)
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/found").awaitTermination()
    got = {(r["chain"], r["seq"], r["violation_type"]) for r in spark.read.schema(jobs.FOUND).parquet(f"{tmp_path}/found").collect()}
    assert got == {("a", 4, "SEQUENCE_GAP"), ("b", 3, "PREV_HASH_MISMATCH"), ("a", 6, "DUPLICATE_KEY")}


def test_bundles_are_written_in_parts(spark, tmp_path):
    """Files in the order of their names are one JSON text; the records come back."""
    events = chain(spark, rows_of(90))
    made = bundle.export_bundles(events, *bundle.select_by(events, "resource_id", "resourceId"), AT, config=TEST)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges this small are put together
    json_io.write_bundles(made, f"{tmp_path}/b")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folder in Path(f"{tmp_path}/b/texts").glob("bundle_key=*"):
        names = sorted(folder.glob("*.txt"))
        whole = json.loads("".join(f.read_text() for f in names))
        assert len(whole["records"]) == 30 and [r["seq"] for r in whole["records"]] == sorted(r["seq"] for r in whole["records"])
        assert list(whole) == ["bundleVersion", "exportedAt", "filter", "genesisHash", "records", "segments", "bundleHash", "hmac"]
    assert max(len(list(f.glob("*.txt"))) for f in Path(f"{tmp_path}/b/texts").glob("bundle_key=*")) > 1
    back = json_io.read_bundle_lines(spark, f"{tmp_path}/b")
    shown = ["bundle_key", *bundle.RECORD_COLUMNS]
    stored = spark.read.parquet(f"{tmp_path}/b/records")
    assert sorted(map(str, back.records.select(*shown).collect())) == sorted(map(str, stored.select(*shown).collect()))
    assert all(r["valid"] for r in bundle.verify_bundles(back, "test-hmac-secret").collect())
    text = next(f for f in Path(f"{tmp_path}/b/texts").rglob("*.txt") if '"seq":' in f.read_text())
    text.write_text(re.sub(r'"seq":\d+}', '"seq":"?"}', text.read_text(), count=1))
    for crc in text.parent.glob(".*.crc"):
        crc.unlink()
    assert not all(r["valid"] for r in bundle.verify_bundles(json_io.read_bundle_lines(spark, f"{tmp_path}/b")).collect())


def test_windows_by_time_bins(spark):
    """Windows of all lengths against comparison of all pairs; days before 1970 too."""
    rng = random.Random(2)
    instant = lambda: (datetime(1969, 11, 1) + timedelta(seconds=rng.randrange(2 * 10**8))).strftime("%Y-%m-%dT%H:%M:%S.000000000Z")
    rows = [(i, "ACCOUNT_VIEWED", "CLIENT_ACCOUNT", rng.choice(["hot", "hot", "cold"]), instant()) for i in range(300)]
    events = spark.createDataFrame(rows, "seq long, event_type string, resource_type string, resource_id string, event_ts_c string")
    asked = []
    for i in range(120):
        a, b = sorted([instant(), instant()])
        if i % 3 == 0:
            b = a[:8] + "28" + a[10:]
        asked.append((f"r{i}", "CLIENT_ACCOUNT", "hot", a if i % 11 else None, b if i % 7 else None, "x"))
    requests = spark.createDataFrame(asked, ACCESS_REQUEST)
    got = {tuple(r) for r in compliance.matched_events(events, requests, TEST, broadcast_requests=0).collect()}
    want = {(q[0], s) for q in asked for s, _, _, who, t in rows if who == "hot" and (q[3] is None or t >= q[3]) and (q[4] is None or t < q[4])}
    assert got == want == {tuple(r) for r in compliance.matched_events(events, requests, TEST).collect()}
