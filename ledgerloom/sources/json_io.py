"""Events and bundles as JSON. Payloads stay text on the way in, so that their
numbers and order aren't touched before canonical JSON sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import hashing as H
from ledgerloom.functions.json_text import json_string
from ledgerloom.operators.bundle import Bundles, record_text
from ledgerloom.operators.tables import broadcast_if_small, packed, staged

_REQUEST = "eventType string, actorId string, resourceType string, resourceId string, payload string, timestamp string"


def _as_new_event(df: DataFrame) -> DataFrame:
    names = {"eventType": "event_type", "actorId": "actor_id", "resourceType": "resource_type", "resourceId": "resource_id"}
    return df.withColumnsRenamed(names)


def read_new_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, with the members of an event request."""
    return _as_new_event(spark.read.schema(_REQUEST).json(path))


def stream_new_events(spark: SparkSession, path: str) -> DataFrame:
    return _as_new_event(spark.readStream.schema(_REQUEST).json(path))


def bundle_text(bundles: Bundles) -> DataFrame:
    """(bundle_key, value): each bundle as one JSON text. For bundles that fit a
    row; larger ones stay in their three tables."""
    segment = H.object_text([("fromSeq", F.col("from_seq").cast("string")), ("toSeq", F.col("to_seq").cast("string")), ("priorRecordHash", json_string(F.col("prior_record_hash")))])

    def listed(rows: DataFrame, order: str, text: Column, name: str) -> DataFrame:
        each = rows.select("bundle_key", F.struct(F.col(order).alias("n"), text.alias("text")).alias("x"))
        return each.groupBy("bundle_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), ",").alias(name))

    whole = bundles.headers.join(listed(bundles.records, "seq", record_text(), "records"), "bundle_key", "left")
    whole = whole.join(listed(bundles.segments, "from_seq", segment, "segments"), "bundle_key", "left")
    null = F.lit("null")
    value = H.object_text(
        [
            ("bundleVersion", json_string(F.col("bundle_version"))),
            ("exportedAt", json_string(F.col("exported_at"))),
            ("filter", H.object_text([("type", json_string(F.col("filter_type"))), ("value", json_string(F.col("filter_value")))])),
            ("genesisHash", json_string(F.col("genesis_hash"))),
            ("records", F.concat(F.lit("["), F.coalesce("records", F.lit("")), F.lit("]"))),
            ("segments", F.concat(F.lit("["), F.coalesce("segments", F.lit("")), F.lit("]"))),
            ("bundleHash", F.coalesce(json_string(F.col("bundle_hash")), null)),
            ("hmac", F.coalesce(json_string(F.col("hmac")), null)),
        ]
    )
    return whole.select("bundle_key", value.alias("value"))


def bundle_lines(bundles: Bundles) -> DataFrame:
    """(bundle_key, place, value): the same text as ordered lines, one for each
    record and segment. JSON lets lines end between its tokens."""
    headers, null = bundles.headers, F.lit("null")
    lead = H.object_text([
        ("bundleVersion", json_string(F.col("bundle_version"))),
        ("exportedAt", json_string(F.col("exported_at"))),
        ("filter", H.object_text([("type", json_string(F.col("filter_type"))), ("value", json_string(F.col("filter_value")))])),
        ("genesisHash", json_string(F.col("genesis_hash"))),
    ])
    opening = F.concat(F.substr(lead, F.lit(1), F.length(lead) - 1), F.lit(',"records":['))
    closing = F.concat(F.lit('],"bundleHash":'), F.coalesce(json_string(F.col("bundle_hash")), null), F.lit(',"hmac":'), F.coalesce(json_string(F.col("hmac")), null), F.lit("}"))
    segment = H.object_text([("fromSeq", F.col("from_seq").cast("string")), ("toSeq", F.col("to_seq").cast("string")), ("priorRecordHash", json_string(F.col("prior_record_hash")))])

    def fixed(kind: int, text: Column) -> DataFrame:
        return headers.select("bundle_key", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("at"), text.alias("value"))

    def listed(rows: DataFrame, kind: int, at: str, text: Column) -> DataFrame:
        least = broadcast_if_small(staged(rows.groupBy("bundle_key").agg(F.min(at).alias("_first")), "firsts"))
        comma = F.when(F.col(at) == F.col("_first"), F.lit("")).otherwise(F.lit(","))
        return rows.join(least, "bundle_key").select("bundle_key", F.lit(kind).alias("kind"), F.col(at).alias("at"), F.concat(comma, text).alias("value"))

    lines = fixed(0, opening).unionByName(listed(bundles.records, 1, "seq", record_text())).unionByName(fixed(2, F.lit('],"segments":[')))
    return lines.unionByName(listed(bundles.segments, 3, "from_seq", segment)).unionByName(fixed(4, closing))


def write_bundles(bundles: Bundles, path: str, compression: str = "none") -> None:
    """A folder for each bundle key below `texts`: its files, one after the other
    in the order of their names, are its JSON text (so are files that gzip has
    packed, unpacked). A bundle of any size is cut into ranges of lines, so no task
    holds one. `records` has the records as Parquet; the texts are made of those."""
    by, order = ["bundle_key", "seq"], ["bundle_key", "kind", "at"]
    packed(bundles.records.repartitionByRange(*by).sortWithinPartitions(*by)).parquet(f"{path}/records")
    records = bundles.records.sparkSession.read.schema(bundles.records.schema).parquet(f"{path}/records")
    lines = bundle_lines(Bundles(staged(bundles.headers, "headers"), records, bundles.segments)).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("bundle_key", "value").write.option("compression", compression).partitionBy("bundle_key").text(f"{path}/texts")


def read_bundle_lines(spark: SparkSession, path: str) -> Bundles:
    """Bundles from the texts that write_bundles made: every line says what it
    is, and is parsed by itself. A line that fits nowhere makes a null record,
    which no check passes."""
    lines = spark.read.text(f"{path}/texts").withColumn("bundle_key", F.col("bundle_key").cast("string"))
    own = F.regexp_replace("value", "^,", "")
    opening, closing, divider = F.col("value").startswith('{"bundleVersion"'), F.col("value").startswith('],"bundleHash"'), F.col("value") == '],"segments":['
    is_segment = own.startswith('{"fromSeq"')
    first = lines.filter(opening).select("bundle_key", F.from_json(F.concat("value", F.lit("]}")), schemas.BUNDLE).alias("b"))
    last = lines.filter(closing).select("bundle_key", F.from_json(F.regexp_replace("value", r"^\],", "{"), "bundleHash string, hmac string").alias("e"))
    headers = first.join(last, "bundle_key", "left").select("bundle_key", *_header_columns("b"), F.col("e.bundleHash").alias("bundle_hash"), F.col("e.hmac").alias("hmac"))
    records = lines.filter(~opening & ~closing & ~divider & ~is_segment).select("bundle_key", F.from_json(own, schemas.BUNDLE_RECORD).alias("r"))
    segments = lines.filter(is_segment).select("bundle_key", F.from_json(own, "fromSeq long, toSeq long, priorRecordHash string").alias("s"))
    return Bundles(headers, _records(records), _segments(segments))


def _header_columns(b: str) -> list[Column]:
    names = {"bundleVersion": "bundle_version", "exportedAt": "exported_at", "filter.type": "filter_type", "filter.value": "filter_value", "genesisHash": "genesis_hash"}
    return [F.col(f"{b}.{member}").alias(name) for member, name in names.items()]


def _records(r: DataFrame) -> DataFrame:
    def pairs(name: str) -> Column:
        return H.pairs_json(F.map_entries(F.coalesce(F.col(f"r.{name}"), F.create_map().cast(H.MAP))), "key", "value")

    return r.select(
        "bundle_key", "r.seq", F.col("r.eventId").alias("event_id"), F.col("r.eventType").alias("event_type"), F.col("r.actorId").alias("actor_id"),
        F.col("r.resourceType").alias("resource_type"), F.col("r.resourceId").alias("resource_id"), F.col("r.payload").alias("payload_json"), F.col("r.payload").alias("payload_canonical"),
        pairs("leafSalts").alias("leaf_salts_json"), pairs("leafCommitments").alias("leaf_commitments_json"), F.coalesce("r.redactedPaths", F.array().cast("array<string>")).alias("redacted_paths"),
        F.col("r.eventTimestamp").alias("event_ts_c"), F.col("r.recordedAt").alias("recorded_at_c"), F.col("r.contentHash").alias("content_hash"),
        F.col("r.prevHash").alias("prev_hash"), F.col("r.recordHash").alias("record_hash"), "r.archived",
    )


def _segments(s: DataFrame) -> DataFrame:
    return s.select("bundle_key", F.col("s.fromSeq").alias("from_seq"), F.col("s.toSeq").alias("to_seq"), F.col("s.priorRecordHash").alias("prior_record_hash"))


def write_bundle_rows(bundles: Bundles, path: str) -> None:
    """A folder for each bundle key, the whole text in one line: for small bundles."""
    bundle_text(bundles).write.partitionBy("bundle_key").text(path)


def read_bundles(spark: SparkSession, path: str) -> Bundles:
    """Bundles from JSON texts, one a line; a key column from the folders' names
    is used if there is one, else a hash of the line. For bundles that fit a row."""
    lines = spark.read.text(path, wholetext=False)
    key = F.col("bundle_key").cast("string") if "bundle_key" in lines.columns else F.sha2(F.col("value").cast("binary"), 256)
    parsed = lines.select(key.alias("bundle_key"), F.from_json("value", schemas.BUNDLE).alias("b"))
    headers = parsed.select("bundle_key", *_header_columns("b"), F.col("b.bundleHash").alias("bundle_hash"), F.col("b.hmac").alias("hmac"))
    records = _records(parsed.select("bundle_key", F.explode("b.records").alias("r")))
    return Bundles(headers, records, _segments(parsed.select("bundle_key", F.explode("b.segments").alias("s"))))
