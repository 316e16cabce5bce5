"""Registered queries over the driver's events, and the SQL that gives the same."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import GENESIS, LedgerConfig
from ledgerloom.functions import hashing as H
from ledgerloom.functions.json_text import json_string, parse_payload
from ledgerloom.operators import append, bundle, checkpoints, compliance, query, redact, retention, verify
from ledgerloom.operators.tables import broadcast_if_small, packed, shared_dir, staged
from ledgerloom.sources import json_io
from ledgerloom.sources.driver_events import new_events
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.ledger_tables import EventTable, read_archive, read_redactions, write_archive, write_redactions
from ledgerloom.streaming import jobs

CONFIG = LedgerConfig(hmac_secret="test-hmac-secret")
NOW = datetime(2024, 2, 1)
EXPORTED_AT = "2026-01-01T00:00:00.000000000Z"


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_events(spark, sf_dir)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with commitments and content hashes, not linked: seq is n + 1."""
    rows = _incoming(spark, sf_dir).withColumn("parsed", parse_payload(F.col("payload")))
    rows = rows.select((F.col("n") + 1).alias("seq"), F.col("given_id").alias("event_id"), "event_type", "actor_id", "resource_type", "resource_id", F.col("timestamp").alias("event_ts_c"), F.col("timestamp").alias("recorded_at_c"), "parsed")
    rows = append.committed(rows, append.seeded_salts(F.col("event_id"), F.col("parsed.leaves")))
    return rows.withColumn("content_hash", H.content_hash())


def _chain(spark: SparkSession, sf_dir: str, chain: DataFrame | None = None) -> DataFrame:
    """The events as one appended chain, staged once for what reads it; a caller
    that has it already (a benchmark) hands it in."""
    return _appended(_incoming(spark, sf_dir)).staged("chain") if chain is None else chain


def _appended(incoming: DataFrame, head: tuple[int, str] | None = None) -> append.Appended:
    """New events with their given ids, times and repeatable salts, on a chain."""
    return append.append_events(incoming, head, ["n"], F.col("timestamp"), F.col("given_id"), append.seeded_salts(F.col("event_id"), F.col("parsed.leaves")), CONFIG)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tampered(events: DataFrame) -> DataFrame:
    """Every kind of change that a check must tell, on rows spread over the chain."""
    at = F.pmod("seq", F.lit(1009))
    return events.filter(at != 700).withColumns(
        {
            "actor_id": F.when(at == 100, "mallory").otherwise(F.col("actor_id")),
            "payload_json": F.when(at == 200, '{"k":-1,"value":0}').when(at == 250, '{"k":1}').otherwise(F.col("payload_json")),
            "leaf_salts_json": F.when(at == 300, "{}").otherwise(F.col("leaf_salts_json")),
            "record_hash": F.when(at == 400, F.lit("0" * 64)).otherwise(F.col("record_hash")),
            "prev_hash": F.when((F.col("seq") == 1) | (at == 500), F.lit("0" * 64)).otherwise(F.col("prev_hash")),
        }
    )


def leaf_commitments(spark, sf_dir):
    rows = _hashed(spark, sf_dir).select("seq", F.explode(H.entries(F.col("leaf_commitments_json"))).alias("e"))
    return rows.select("seq", F.col("e.key").alias("pointer"), F.col("e.value").alias("commitment"))


def content_hashes(spark, sf_dir):
    return _hashed(spark, sf_dir).select("seq", "event_id", "content_hash")


_LINKED = ["seq", "event_id", "event_ts_c", "content_hash", "prev_hash", "record_hash"]


def append_chain_rows(spark, sf_dir):
    return _appended(_incoming(spark, sf_dir)).events


def append_chain(spark, sf_dir):
    return append_chain_rows(spark, sf_dir).select(*_LINKED)


def append_in_batches(spark, sf_dir):
    """Two appends to one event table, the second from the first one's head."""
    rows, table = _incoming(spark, sf_dir), EventTable(spark, _folder(spark, "table"))
    half = rows.agg(F.floor(F.count(F.lit(1)) / 2)).first()[0]
    table.create(_appended(rows.filter(F.col("n") < half)).events)
    table.append(_appended(rows.filter(F.col("n") >= half), append.chain_head(table.read(), CONFIG)).events)
    return table.read().select(*_LINKED)


def append_default_time(spark, sf_dir):
    """Every third event names no time of its own."""
    rows = _incoming(spark, sf_dir).withColumn("timestamp", F.when(F.pmod("n", F.lit(3)) != 0, F.col("timestamp")))
    made = append.append_events(rows, None, ["n"], F.lit(EXPORTED_AT), F.col("given_id"), append.seeded_salts(F.col("event_id"), F.col("parsed.leaves")), CONFIG)
    return made.events.select("seq", "event_ts_c", "recorded_at_c", "content_hash")


def append_stream(spark, sf_dir):
    """Micro-batches of one file each, appended one after the other."""
    rows, folder = _incoming(spark, sf_dir), _folder(spark, "stream")
    half = rows.agg(F.floor(F.count(F.lit(1)) / 2)).first()[0]
    for part in (F.col("n") < half, F.col("n") >= half):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    options = {"recorded_at": F.col("timestamp"), "event_id": F.col("given_id"), "salts": append.seeded_salts(F.col("event_id"), F.col("parsed.leaves"))}
    jobs.continuous_append(stream, f"{folder}/ledger", f"{folder}/checkpoint", ["n"], CONFIG, **options).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/ledger/events").select(*_LINKED)


def json_ingest(spark, sf_dir):
    """New events as JSON lines, read with their payloads as text."""
    rows, folder = _incoming(spark, sf_dir), _folder(spark, "json")
    names = [("eventType", "event_type"), ("actorId", "actor_id"), ("resourceType", "resource_type"), ("resourceId", "resource_id"), ("timestamp", "timestamp")]
    rows.select(H.object_text([*[(k, json_string(F.col(c))) for k, c in names], ("payload", F.col("payload"))]).alias("value")).write.text(folder)
    return json_io.read_new_events(spark, folder)


def escaped_pointers(spark, sf_dir):
    """Leaves of payloads whose keys hold what pointers escape."""
    old = F.from_json("payload", "k string, value string")
    payload = F.concat(F.lit('{"c~d":{"x/~y":'), old["value"], F.lit(',"list":[true,null,"é"]},"a/b":'), old["k"], F.lit("}"))
    rows = _incoming(spark, sf_dir).select("n", parse_payload(payload).alias("p"))
    return rows.select("n", "p.canonical", F.explode("p.leaves").alias("x")).select("n", "canonical", "x.pointer", "x.leaf")


def append_actor_chains(spark, sf_dir):
    rows = _hashed(spark, sf_dir).select(F.col("actor_id").alias("chain_id"), "seq", "content_hash")
    return append.link_chains(rows, "chain_id", GENESIS)


def _actor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each actor, appended in two batches."""
    rows = _incoming(spark, sf_dir).withColumn("chain", F.col("actor_id"))
    half = rows.agg(F.floor(F.count(F.lit(1)) / 2)).first()[0]
    options = {"order": ["n"], "recorded_at": F.col("timestamp"), "event_id": F.col("given_id"), "salts": append.seeded_salts(F.col("event_id"), F.col("parsed.leaves")), "config": CONFIG}
    made = append.append_chains(rows.filter(F.col("n") < half), "chain", **options).staged("chains")
    heads = made.groupBy("chain").agg(F.max("seq").alias("last_seq"), F.max_by("record_hash", "seq").alias("last_hash"))
    return made.unionByName(append.append_chains(rows.filter(F.col("n") >= half), "chain", heads, **options).events)


def append_many_chains(spark, sf_dir):
    return _actor_chains(spark, sf_dir).select("chain", "seq", "event_id", "content_hash", "prev_hash", "record_hash")


def verify_many_chains(spark, sf_dir):
    """Chains of all actors, one row in 101 gone and another one changed."""
    number = F.pmod(F.conv(F.substr("event_id", F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(101))
    events = _actor_chains(spark, sf_dir).filter(number != 7).withColumn("event_type", F.when(number == 8, "OTHER").otherwise(F.col("event_type")))
    found = verify.verify_chains(staged(events, "chains"), "chain", config=CONFIG)
    return found.select("chain", "intact", "records_checked", "last_seq", "violation_seq", "violation_type", "detail")


def _chains_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """A stored ledger with a chain for each actor, appended twice from its heads."""
    ledger, rows = Ledger(spark, _folder(spark, "ledger"), "chain"), _incoming(spark, sf_dir).withColumn("chain", F.col("actor_id"))
    half = rows.agg(F.floor(F.count(F.lit(1)) / 2)).first()[0]
    for part in (F.col("n") < half, F.col("n") >= half):
        ledger.append(rows.filter(part), CONFIG, order=["n"], recorded_at=F.col("timestamp"), event_id=F.col("given_id"), salts=append.seeded_salts(F.col("event_id"), F.col("parsed.leaves")))
    return ledger


def _value_requests(events: DataFrame) -> DataFrame:
    """Requests for the value of every fifth row of each chain."""
    rows = events.filter("seq % 5 = 1").select(F.concat_ws("/", "chain", "seq").alias("request_id"), "event_id", F.array(F.lit("/value")).alias("field_paths"))
    return rows.withColumns({"reason": F.lit("erasure"), "redacted_by": F.lit("dpo"), "retain_salt": F.lit(True)})


def chains_ledger(spark, sf_dir):
    """Links of all chains of a stored ledger, and the head that it keeps of each."""
    ledger = _chains_ledger(spark, sf_dir)
    return ledger.read().select("chain", "seq", "prev_hash", "record_hash").join(ledger.heads(), "chain")


def chains_redacted(spark, sf_dir):
    """Redaction over many chains, merged on read."""
    ledger = _chains_ledger(spark, sf_dir)
    ledger.redact(staged(_value_requests(ledger.read()), "requests"), "run-1", F.lit(NOW), CONFIG)
    return ledger.read().select("chain", "seq", "payload_json", "leaf_salts_json", "record_hash")


def chains_verified(spark, sf_dir):
    """A deep check of all chains after redaction and retention, by their heads;
    one archive copy in 101 is changed."""
    ledger = _chains_ledger(spark, sf_dir)
    ledger.redact(staged(_value_requests(ledger.read()), "requests"), "run-1", F.lit(NOW), CONFIG)
    ledger.retain(NOW, LedgerConfig(retention_window=timedelta(days=15)))
    number = F.pmod(F.conv(F.substr("event_id", F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(101))
    copies = ledger.archive().withColumn("payload_json", F.when(number == 5, '{"k":-1,"value":0}').otherwise(F.col("payload_json")))
    return verify.verify_chains(ledger.read(), "chain", ledger.redactions(), copies, heads=ledger.heads(), deep=True, config=CONFIG).drop("event_id")


def chains_bundles(spark, sf_dir):
    """A bundle of the account views of every chain, from the stored ledger."""
    events = _chains_ledger(spark, sf_dir).read()
    selection, filters = bundle.select_by(events.filter("event_type = 'ACCOUNT_VIEWED'"), "event_type", "eventType", "chain")
    return bundle.export_bundles(events, selection, filters, EXPORTED_AT, config=CONFIG, chain="chain").headers.select("bundle_key", "bundle_hash")


def _months_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """One chain whose record times lie in six months."""
    rows = _incoming(spark, sf_dir)
    total = rows.count()
    month = F.lpad((1 + F.floor(F.col("n") * 6 / total)).cast("string"), 2, "0")
    ledger = Ledger(spark, _folder(spark, "ledger"))
    options = {"order": ["n"], "recorded_at": F.concat(F.lit("2024-"), month, F.substr("timestamp", F.lit(8))), "event_id": F.col("given_id")}
    ledger.append(rows, CONFIG, salts=append.seeded_salts(F.col("event_id"), F.col("parsed.leaves")), **options)
    return ledger


def retention_months(spark, sf_dir):
    """Retention writes only months with a row that is due: the version that made
    each month's part, and the rows that are archived in it."""
    ledger = _months_ledger(spark, sf_dir)
    ledger.retain(datetime(2024, 4, 1), LedgerConfig(retention_window=timedelta(days=16)))
    made = spark.createDataFrame([(r["month"], r["made"]) for r in ledger.parts("events")], "month string, made long")
    rows = ledger.read().groupBy(F.substr("recorded_at_c", F.lit(1), F.lit(7)).alias("month"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("archived_at").alias("archived"), F.count("payload_json").alias("payloads")).join(made, "month")


def redaction_overlay(spark, sf_dir):
    """Redaction of one row in a thousand: patches are written, events aren't;
    compaction then writes the months that have patches."""
    ledger = _months_ledger(spark, sf_dir)
    wanted = ledger.read().filter("seq % 1000 = 7 and recorded_at_c < '2024-03'").select(F.concat(F.lit("r"), F.col("seq").cast("string")).alias("request_id"), "event_id", F.array(F.lit("/value")).alias("field_paths"))
    requests = staged(wanted.withColumns({"reason": F.lit("erasure"), "redacted_by": F.lit("dpo"), "retain_salt": F.lit(True)}), "requests")
    ledger.redact(requests, "run-1", F.lit(NOW), CONFIG)
    before = ledger.parts("events", "patches")
    told = [("merged", r["kind"], r["month"], r["made"]) for r in before] + [("compacted", m, None, None) for m in ledger.compact()]
    told += [("compact", r["kind"], r["month"], r["made"]) for r in ledger.parts("events", "patches")]
    rows = ledger.read().filter("seq % 1000 = 7").select(F.lit("row").alias("what"), "payload_json", F.col("leaf_salts_json").alias("month"), F.col("seq").alias("made"))
    return rows.unionByName(spark.createDataFrame(told, "what string, payload_json string, month string, made long"))


def redact_chained_requests(spark, sf_dir):
    """Requests that hang on each other in one row: each wants two neighbouring
    leaves of one event, so every second one is turned away."""
    rows = _incoming(spark, sf_dir)
    leaves = rows.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"p'), F.lpad(F.col("n").cast("string"), 9, "0"), F.lit('":'), F.get_json_object("payload", "$.k")))), ",").alias("l"))
    single = leaves.select(F.lit(0).alias("n"), F.lit("A").alias("event_type"), F.lit("a").alias("actor_id"), F.lit("CLIENT_ACCOUNT").alias("resource_type"), F.lit("r").alias("resource_id"), F.concat(F.lit("{"), "l", F.lit("}")).alias("payload"), F.lit("the-event").alias("given_id"), F.lit(EXPORTED_AT).alias("timestamp"))
    event = _appended(single).staged("single")
    name = lambda n: F.concat(F.lit("/p"), F.lpad(n.cast("string"), 9, "0"))
    last = rows.agg(F.max("n")).first()[0]
    requests = rows.filter(F.col("n") < last).select(F.format_string("r%09d", "n").alias("request_id"), F.lit("the-event").alias("event_id"), F.array(name(F.col("n")), name(F.col("n") + 1)).alias("field_paths"))
    requests = staged(requests.withColumns({"reason": F.lit("erasure"), "redacted_by": F.lit("dpo"), "retain_salt": F.lit(True)}), "requests")
    return redact.redact(event, spark.createDataFrame([], "event_seq long, field_path string"), requests, "run-1", F.lit(NOW), CONFIG).rejected


def append_head(spark, sf_dir, chain=None):
    return _chain(spark, sf_dir, chain).agg(F.max("seq").alias("last_seq"), F.max_by("record_hash", "seq").alias("last_record_hash"))


def append_validation(spark, sf_dir):
    n = F.col("n")
    rows = _incoming(spark, sf_dir).withColumns(
        {
            "actor_id": F.when(n % 11 == 1, " \t").otherwise(F.col("actor_id")),
            "resource_id": F.when(n % 11 == 2, F.repeat(F.lit("x"), 201)).otherwise(F.col("resource_id")),
            "payload": F.when(n % 11 == 3, '"nope"').when(n % 11 == 4, None).otherwise(F.col("payload")),
        }
    )
    return rows.withColumn("parsed", parse_payload(F.col("payload"))).select("n", append.rejection().alias("reason"))


def verify_report(spark, sf_dir, chain=None):
    report = verify.verify_chain(_chain(spark, sf_dir, chain), config=CONFIG)
    return report.select("intact", "records_checked", "from_seq", "to_seq", F.size("archived_segments").alias("n_segments"), F.col("first_inconsistency.seq").alias("violation_seq"))


def verify_tampered_report(spark, sf_dir, chain=None):
    events = _chain(spark, sf_dir, chain).filter("seq % 1009 != 700")
    report = verify.verify_chain(events, config=CONFIG)
    found = F.col("first_inconsistency")
    return report.select("intact", "records_checked", "from_seq", "to_seq", found["seq"].alias("violation_seq"), found["violation_type"].alias("violation_type"), found["detail"].alias("detail"))


def verify_violations(spark, sf_dir, chain=None):
    return verify.row_violations(_tampered(_chain(spark, sf_dir, chain)), config=CONFIG)


def verify_ranges(spark, sf_dir, chain=None):
    """Parts of a chain with missing rows: before, around and after the first."""
    events = _chain(spark, sf_dir, chain).filter("seq % 1009 != 700")
    found, columns = None, ["intact", "records_checked", "from_seq", "to_seq"]
    for first, last in ((101, 600), (301, 900), (702, 1500)):
        got = verify.verify_chain(events, from_seq=first, to_seq=last, config=CONFIG)
        got = got.select(F.lit(first).alias("asked_from"), *columns, F.col("first_inconsistency.seq").alias("violation_seq"))
        found = got if found is None else found.unionByName(got)
    return found


def verify_duplicates(spark, sf_dir, chain=None):
    """Rows that are there twice, which no link or hash shows."""
    events = _chain(spark, sf_dir, chain)
    report = verify.verify_chain(staged(events.unionByName(events.filter("seq % 1009 = 105")), "twice"), config=CONFIG)
    found = F.col("first_inconsistency")
    return report.select("intact", "records_checked", found["seq"].alias("violation_seq"), found["violation_type"].alias("violation_type"), found["detail"].alias("detail"))


def verify_increments(spark, sf_dir, chain=None):
    """Two incremental checks; a row is changed between them."""
    events, folder = _chain(spark, sf_dir, chain), _folder(spark, "checks")
    jobs.incremental_verify(events.filter("seq <= 500"), folder, CONFIG)
    jobs.incremental_verify(events.withColumn("actor_id", F.when(F.col("seq") == 700, "mallory").otherwise(F.col("actor_id"))), folder, CONFIG)
    return spark.read.schema(jobs.CHECKS).option("recursiveFileLookup", "true").parquet(folder)


def verify_chain_stream(spark, sf_dir):
    """A stream over the chains of all actors, stopped and started again between
    two files; one row in 101 is missing and another one has a wrong link."""
    number = F.pmod(F.conv(F.substr("event_id", F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(101))
    rows = _actor_chains(spark, sf_dir).filter(number != 7).withColumn("prev_hash", F.when(number == 8, F.lit("0" * 64)).otherwise(F.col("prev_hash")))
    rows, folder = staged(rows.select("chain", "seq", "event_id", "event_ts_c", "event_ts", "prev_hash", "record_hash"), "chains"), _folder(spark, "chainstream")
    half = rows.agg(F.expr("percentile_approx(event_ts_c::timestamp, 0.5)")).first()[0]
    for part in (F.col("event_ts") <= F.lit(half), F.col("event_ts") > F.lit(half)):
        packed(rows.filter(part).coalesce(1)).mode("append").parquet(f"{folder}/in")
        found = jobs.follow_chains(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "chain", CONFIG)
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/found").awaitTermination()
    return spark.read.schema(jobs.FOUND).parquet(f"{folder}/found")


def verify_changed_ranges(spark, sf_dir, chain=None):
    """A second check by the digests of a first one: only changed ranges are looked at."""
    events = _chain(spark, sf_dir, chain)
    before = staged(checkpoints.range_digests(events, 128), "digests")
    changed = events.withColumns({"actor_id": F.when(F.col("seq") % 2503 == 100, "mallory").otherwise(F.col("actor_id")), "record_hash": F.when(F.col("seq") % 2503 == 255, F.lit("0" * 64)).otherwise(F.col("record_hash"))})
    return checkpoints.check_changed(changed, before, size=128, config=CONFIG)


def verify_gaps(spark, sf_dir):
    events = _hashed(spark, sf_dir).select("seq").filter("seq % 1009 != 700")
    last = events.agg(F.max("seq")).first()[0] or 0
    return verify.missing_after(events, 1, last)


def verify_deep(spark, sf_dir, chain=None):
    kept = retention.run_retention(_chain(spark, sf_dir, chain), NOW, LedgerConfig(retention_window=timedelta(days=15)))
    copies = kept.copies.withColumn("payload_json", F.when(F.col("seq") % 97 == 5, '{"k":-1,"value":0}').otherwise(F.col("payload_json"))).filter("seq % 97 != 6")
    return verify.row_violations(kept.events, archive=copies, deep=True, config=CONFIG)


def archived_runs(spark, sf_dir, chain=None):
    events = _chain(spark, sf_dir, chain).withColumn("archived_at", F.when(F.pmod(F.floor(F.col("seq") / 7), F.lit(3)) == 1, F.lit(NOW)))
    last = events.agg(F.max("seq")).first()[0] or 0
    return verify.archived_runs(events, 1, last)


def query_filter(spark, sf_dir, chain=None):
    where = query.EventFilter(resource_type="CLIENT_ACCOUNT", event_type="ACCOUNT_VIEWED", from_c="2024-01-05T00:00:00.000000000Z", to_c="2024-01-20T12:00:00.000000000Z")
    return query.find_events(_chain(spark, sf_dir, chain), where).select("seq", "event_id", "actor_id", "resource_id", "event_ts_c")


def query_by_event_id(spark, sf_dir):
    events = _hashed(spark, sf_dir)
    return query.by_event_id(events, events.filter("seq = 42").first()["event_id"]).select("seq", "event_id", "content_hash")


def query_by_event_ids(spark, sf_dir):
    wanted = _incoming(spark, sf_dir).filter("n % 97 = 1").select(F.col("given_id").alias("event_id"))
    return query.by_event_ids(_hashed(spark, sf_dir), wanted).select("seq", "event_id", "content_hash")


def query_stored_lookup(spark, sf_dir, chain=None):
    """Point reads of a stored table, whose row groups carry Bloom filters."""
    ledger = Ledger(spark, _folder(spark, "ledger"), row_group_bytes=1 << 16)
    ledger.add(_chain(spark, sf_dir, chain))
    events = ledger.read()
    one = query.by_event_id(events, _incoming(spark, sf_dir).filter("n = 41").first()["given_id"]).select("seq", "event_id", "record_hash")
    return one.unionByName(query.find_events(events, query.EventFilter(actor_id="user-5")).select("seq", "event_id", "record_hash"))


def query_seq_range(spark, sf_dir):
    return query.seq_range(_hashed(spark, sf_dir), 101, 250).select("seq", "event_id", "content_hash")


def query_by_seqs(spark, sf_dir):
    wanted = _incoming(spark, sf_dir).filter("n % 89 = 2").select((F.col("n") * 2).alias("seq"))
    return query.by_seqs(_hashed(spark, sf_dir), wanted).select("seq", "event_id", "content_hash")


def query_page(spark, sf_dir, chain=None):
    where = query.EventFilter(resource_id="acct-2")
    return query.page(_chain(spark, sf_dir, chain), where, 1, 20, _redactions(spark, sf_dir)).select("seq", "event_id", "payload_json", F.array_join("redacted_paths", ",").alias("redacted_paths"), "archived")


def query_page_after(spark, sf_dir, chain=None):
    return query.page_after(_chain(spark, sf_dir, chain), query.EventFilter(event_type="PURCHASE"), 100, 30).select("seq", "event_id", "record_hash")


def query_page_info(spark, sf_dir, chain=None):
    return query.page_info(_chain(spark, sf_dir, chain), query.EventFilter(resource_id="acct-2"), 1, 20)


def _redactions(spark, sf_dir) -> DataFrame:
    """Redaction rows for every eighth event's value, and its k if a sixteenth."""
    rows = _hashed(spark, sf_dir).filter("seq % 8 = 3")
    paths = F.explode(F.when(F.col("seq") % 16 == 3, F.array(F.lit("/value"), F.lit("/k"))).otherwise(F.array(F.lit("/value")))).alias("field_path")
    rows = rows.select("*", paths)
    return rows.select(
        F.lit("r").alias("redaction_id"), F.col("seq").alias("event_seq"), "field_path", H.string_map(F.col("leaf_commitments_json"))[F.col("field_path")].alias("field_commitment"),
        H.string_map(F.col("leaf_salts_json"))[F.col("field_path")].alias("field_salt"), F.lit(True).alias("salt_retained"), F.lit("test").alias("reason"),
        F.lit("dpo").alias("redacted_by"), F.lit(NOW).alias("redacted_at"),
    )


def redacted_paths(spark, sf_dir, chain=None):
    shown = query.event_view(_chain(spark, sf_dir, chain), _redactions(spark, sf_dir))
    return shown.select("seq", F.array_join("redacted_paths", ",").alias("redacted_paths"))


def _requests(chain: DataFrame) -> DataFrame:
    n = F.col("seq")
    paths = (
        F.when(n % 50 == 1, F.array(F.lit("/value"), F.lit("/none")))
        .when(n % 50 == 2, F.array(F.lit("/k"), F.lit("/k")))
        .when(n % 50 == 3, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("/value")))
    )
    first = chain.filter("seq % 10 in (1, 2, 3, 4)").select(
        F.format_string("a%012d", n).alias("request_id"), F.when(n % 50 == 4, F.lit("nobody")).otherwise(F.col("event_id")).alias("event_id"),
        paths.alias("field_paths"), F.lit("erasure").alias("reason"), F.lit("dpo").alias("redacted_by"), (n % 20 < 10).alias("retain_salt"),
    )
    again = first.filter("request_id like '%4'").withColumn("request_id", F.concat(F.lit("b"), F.substr("request_id", F.lit(2))))
    return first.unionByName(again)


def _redacted(spark, sf_dir, chain=None):
    chain = _chain(spark, sf_dir, chain)
    none = spark.createDataFrame([], "event_seq long, field_path string")
    return redact.redact(chain, none, staged(_requests(chain), "requests"), "run-1", F.lit(NOW), CONFIG)


def redact_rejects(spark, sf_dir, chain=None):
    return _redacted(spark, sf_dir, chain).rejected


def redact_rows(spark, sf_dir, chain=None):
    return _redacted(spark, sf_dir, chain).redactions.select("event_seq", "field_path", "redaction_id", "field_commitment", "field_salt", "salt_retained")


def redact_events(spark, sf_dir, chain=None):
    return _redacted(spark, sf_dir, chain).events.select("seq", "payload_json", "leaf_salts_json", "record_hash")


def redact_then_verify(spark, sf_dir, chain=None):
    done = _redacted(spark, sf_dir, chain)
    report = verify.verify_chain(staged(done.events, "redacted"), staged(done.redactions, "redactions"), config=CONFIG)
    return report.select("intact", "records_checked")


def redact_again(spark, sf_dir, chain=None):
    """The same requests where some leaves were redacted by earlier runs."""
    chain = _chain(spark, sf_dir, chain)
    done = redact.redact(chain, _redactions(spark, sf_dir), staged(_requests(chain), "requests"), "run-1", F.lit(NOW), CONFIG)
    return done.rejected


def redact_meta_events(spark, sf_dir, chain=None):
    return _redacted(spark, sf_dir, chain).meta_events.select("request_id", "event_type", "actor_id", "resource_type", "resource_id", "payload")


def redaction_table(spark, sf_dir, chain=None):
    """Redactions written to their table and read from it."""
    folder = _folder(spark, "redactions")
    write_redactions(_redacted(spark, sf_dir, chain).redactions, folder)
    return read_redactions(spark, folder).select("event_seq", "field_path", "redaction_id", "field_commitment", "field_salt", "salt_retained", "reason", "redacted_by")


def disclosure_proof(spark, sf_dir):
    disclosed = _hashed(spark, sf_dir).withColumn("parsed", parse_payload(F.col("payload_json"))).filter("seq % 8 in (3, 4)")
    leaf = F.when(F.col("seq") % 5 == 0, F.lit("N0")).otherwise(F.element_at(F.map_from_entries("parsed.leaves"), F.lit("/value")))
    return redact.check_disclosures(_redactions(spark, sf_dir), disclosed.select(F.col("seq").alias("event_seq"), F.lit("/value").alias("field_path"), leaf.alias("leaf")))


def retention_result(spark, sf_dir, chain=None):
    done = retention.run_retention(_chain(spark, sf_dir, chain), NOW, LedgerConfig(retention_window=timedelta(days=15)))
    return done.result.select("archived", "through_seq")


def retention_split(spark, sf_dir, chain=None):
    done = retention.run_retention(_chain(spark, sf_dir, chain), NOW, LedgerConfig(retention_window=timedelta(days=15)))
    kept = done.events.select("seq", F.col("archived_at").isNotNull().alias("archived"), F.col("payload_json").isNull().alias("gone"), "record_hash")
    return kept.join(done.copies.select("seq", F.col("payload_json").alias("copy")), "seq", "left")


def retention_tables(spark, sf_dir, chain=None):
    """Retention on stored tables: copies go to the archive, then a new version
    of the event table replaces the old one."""
    folder = _folder(spark, "retention")
    table = EventTable(spark, f"{folder}/events")
    table.create(_chain(spark, sf_dir, chain))
    done = retention.run_retention(table.read(), NOW, LedgerConfig(retention_window=timedelta(days=15)))
    write_archive(done.copies, f"{folder}/archive")
    table.replace(done.events)
    copies = read_archive(spark, f"{folder}/archive").select("seq", F.col("payload_json").alias("copy"))
    kept = table.read().select("seq", F.col("archived_at").isNotNull().alias("archived"), F.col("payload_json").isNull().alias("gone"), "record_hash")
    return kept.join(copies, "seq", "left").withColumn("version", F.lit(table.current()[0]).cast("long"))


def _bundles(spark, sf_dir, chain=None) -> tuple[DataFrame, bundle.Bundles]:
    chain = _chain(spark, sf_dir, chain)
    selection, filters = bundle.select_by(chain, "resource_id", "resourceId")
    return chain, bundle.export_bundles(chain, selection, filters, EXPORTED_AT, config=CONFIG)


def bundle_segments(spark, sf_dir, chain=None):
    return _bundles(spark, sf_dir, chain)[1].segments


def bundle_headers(spark, sf_dir, chain=None):
    return _bundles(spark, sf_dir, chain)[1].headers.select("bundle_key", "filter_type", "filter_value", "bundle_hash", "hmac")


def bundle_check(spark, sf_dir, chain=None):
    _, made = _bundles(spark, sf_dir, chain)
    at = F.pmod("seq", F.lit(503))
    forged = made.records.filter(at != 400).withColumns(
        {
            "payload_json": F.when(at == 100, '{"k":-1,"value":0}').otherwise(F.col("payload_json")),
            "actor_id": F.when(at == 200, "mallory").otherwise(F.col("actor_id")),
            "record_hash": F.when(at == 300, F.lit("0" * 64)).otherwise(F.col("record_hash")),
        }
    )
    found = bundle.verify_bundles(bundle.Bundles(made.headers, forged, made.segments), CONFIG.hmac_secret, listed=True)
    return found.select("bundle_key", "valid", F.array_join("problems", ";").alias("problems"))


def bundle_of_one(spark, sf_dir, chain=None):
    """The export that exactly one of resource and actor selects."""
    column, value = bundle.selector(resource_id="acct-7", actor_id=" ")
    chain = _chain(spark, sf_dir, chain)
    selection, filters = bundle.select_by(chain.filter(F.col(column) == value), column, "resourceId")
    return bundle.export_bundles(chain, selection, filters, EXPORTED_AT, config=CONFIG).headers.select("bundle_key", "filter_type", "filter_value", "bundle_hash")


def bundle_json(spark, sf_dir, chain=None):
    """Bundles written as ordered parts of JSON texts, read again and checked:
    the records that came back, and whether their bundle is valid."""
    _, made = _bundles(spark, sf_dir, chain)
    folder = _folder(spark, "bundles")
    json_io.write_bundles(made, folder, compression="gzip")
    back = json_io.read_bundle_lines(spark, folder)
    checked = broadcast_if_small(staged(bundle.verify_bundles(back, CONFIG.hmac_secret).select("bundle_key", "valid"), "checked"))
    return back.records.select("bundle_key", "seq", "event_id", "actor_id", "payload_json", "leaf_salts_json", "content_hash", "prev_hash", "record_hash").join(checked, "bundle_key")


def _windows_of(events: DataFrame) -> DataFrame:
    """Two requests for every account: a window in time, and all of it."""
    spark = events.sparkSession
    accounts = events.select("resource_type", "resource_id").distinct()
    windows = accounts.crossJoin(F.broadcast(spark.createDataFrame([("w1", "2024-01-03T00:00:00.000000000Z", "2024-01-09T06:30:00.500000000Z"), ("w2", None, None)], "w string, from_c string, to_c string")))
    return windows.select(F.concat_ws("/", "resource_type", "resource_id", "w").alias("request_id"), "resource_type", "resource_id", "from_c", "to_c", F.lit("auditor").alias("requested_by"))


def _access(spark, sf_dir, chain=None) -> compliance.AccessReports:
    chain = _chain(spark, sf_dir, chain)
    return compliance.access_reports(chain, staged(_windows_of(chain), "requests"), EXPORTED_AT, config=CONFIG)


def compliance_headers(spark, sf_dir, chain=None):
    return _access(spark, sf_dir, chain).headers.select("request_id", "from_seq", "to_seq", "matched_count", "chain_intact", "bundle_hash", "report_hash")


def compliance_entries(spark, sf_dir, chain=None):
    return _access(spark, sf_dir, chain).entries.select("request_id", "seq", "event_id", "event_type", "actor_id", "event_ts_c")


def compliance_meta_events(spark, sf_dir, chain=None):
    return _access(spark, sf_dir, chain).meta_events.select("request_id", "event_type", "actor_id", "resource_type", "resource_id", "payload")


def compliance_capped(spark, sf_dir):
    """Each request looks at its first five rows only, before types are filtered."""
    events = _hashed(spark, sf_dir)
    requests = _windows_of(events).filter(F.col("resource_type") == "CLIENT_ACCOUNT")
    return compliance.matched_events(events, requests, CONFIG, scan_cap=5)


def compliance_many_windows(spark, sf_dir):
    """More requests than are broadcast: a window for every account and day, two
    long ones and one without an end, joined by time bins."""
    events = _hashed(spark, sf_dir)
    accounts = events.filter("resource_type = 'CLIENT_ACCOUNT'").select("resource_type", "resource_id").distinct()
    day = F.format_string("2024-01-%02dT%02d:30:00.000000000Z", F.col("d"), F.col("d") % 24)
    days = accounts.select("*", F.explode(F.sequence(F.lit(1), F.lit(28))).alias("d"))
    short = days.select(F.concat_ws("/", "resource_id", "d").alias("request_id"), "resource_type", "resource_id", day.alias("from_c"), F.concat(F.substr(day, F.lit(1), F.lit(8)), F.format_string("%02d", F.col("d") + 2), F.substr(day, F.lit(11))).alias("to_c"))
    requests = short
    for name, first, last in (("long", "2023-06-01T00:00:00.000000000Z", "2024-01-16T12:00:00.000000000Z"), ("longer", "2001-01-01T00:00:00.000000000Z", "2101-01-01T00:00:00.000000000Z"), ("open", "2024-01-20T00:00:00.000000000Z", None)):
        requests = requests.unionByName(accounts.select(F.concat_ws("/", "resource_id", F.lit(name)).alias("request_id"), "resource_type", "resource_id", F.lit(first).alias("from_c"), F.lit(last).cast("string").alias("to_c")))
    return compliance.matched_events(events, requests.withColumn("requested_by", F.lit("auditor")), CONFIG, broadcast_requests=0)


def compliance_rejects(spark, sf_dir, chain=None):
    return _access(spark, sf_dir, chain).rejected


def canonical_strings(spark, sf_dir):
    """JSON strings of the documents' texts, as a hash of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", H.sha256_hex(json_string(F.col("text"))).alias("json_sha256"))


def hmacs(spark, sf_dir):
    return _incoming(spark, sf_dir).select("n", H.hmac_sha256_hex("test-hmac-secret", F.col("payload")).alias("hmac"))


QUERIES = {
    f.__name__: f
    for f in (
        leaf_commitments, content_hashes, append_chain, append_in_batches, append_default_time, append_stream, append_actor_chains, append_many_chains, append_head, append_validation,
        json_ingest, escaped_pointers, verify_report, verify_tampered_report, verify_violations, verify_many_chains, verify_ranges, verify_duplicates, verify_increments, verify_gaps,
        verify_deep, archived_runs, query_filter, query_by_event_id, query_by_event_ids, query_seq_range, query_by_seqs, query_page, query_page_after, query_page_info,
        redacted_paths, redact_rejects, redact_rows, redact_events, redact_then_verify, redact_again, redact_meta_events, redaction_table, disclosure_proof,
        retention_result, retention_split, retention_tables, bundle_segments, bundle_headers, bundle_of_one, bundle_json, bundle_check, compliance_headers,
        verify_chain_stream, verify_changed_ranges, query_stored_lookup, compliance_many_windows,
        chains_ledger, chains_redacted, chains_verified, chains_bundles, retention_months, redaction_overlay, redact_chained_requests,
        compliance_entries, compliance_rejects, compliance_meta_events, compliance_capped, canonical_strings, hmacs,
    )
}

from ledgerloom.plans.oracles import ORACLE_SQL  # noqa: E402
