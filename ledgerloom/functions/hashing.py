"""Hashes and canonical texts as column functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import LEAF_PREFIX, RECORD_PREFIX, SEPARATOR
from ledgerloom.functions.json_text import json_string

MAP = "map<string,string>"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def domain_hash(*parts: Column) -> Column:
    """SHA-256 of the parts with 0x1F between them; null if any part is (the
    join alone would skip a null and shift the rest)."""
    text = F.concat(*[p if i == 0 else F.concat(F.lit(SEPARATOR), p) for i, p in enumerate(parts)])
    return sha256_hex(text)


def leaf_commitment(salt: Column, leaf: Column) -> Column:
    return domain_hash(F.lit(LEAF_PREFIX), salt, leaf)


def record_hash(prev: Column, content: Column) -> Column:
    return domain_hash(F.lit(RECORD_PREFIX), prev, content)


def hmac_sha256_hex(secret: str, text: Column) -> Column:
    """HMAC of a text under a secret that is known when the job is planned."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def pairs_json(pairs: Column, key: str = "pointer", value: str = "value") -> Column:
    """A JSON object of an array of pairs, in the array's order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(json_string(p[key]), F.lit(":"), json_string(p[value]))), ","), F.lit("}"))


def string_map(text: Column) -> Column:
    """Map of JSON text; null text is the empty map."""
    return F.coalesce(F.from_json(text, MAP), F.create_map().cast(MAP))


def entries(text: Column) -> Column:
    """The pairs of a JSON object of strings, in document order."""
    return F.map_entries(string_map(text))


def sorted_map_json(text: Column) -> Column:
    """Canonical text of a JSON object of strings: keys in code-point order."""
    return pairs_json(F.array_sort(entries(text)), "key", "value")


def content_text(seq="seq", event_id="event_id", commitments: Column | None = None) -> Column:
    """The canonical JSON whose hash is the content hash; its members are fixed,
    so it is a template."""
    commitments = sorted_map_json(F.col("leaf_commitments_json")) if commitments is None else commitments
    members = [
        ("actorId", json_string(F.col("actor_id"))),
        ("eventId", json_string(F.col(event_id))),
        ("eventTimestamp", json_string(F.col("event_ts_c"))),
        ("eventType", json_string(F.col("event_type"))),
        ("payloadLeafHashes", commitments),
        ("recordedAt", json_string(F.col("recorded_at_c"))),
        ("resourceId", json_string(F.col("resource_id"))),
        ("resourceType", json_string(F.col("resource_type"))),
        ("seq", F.col(seq).cast("string")),
        ("v", F.lit("1")),
    ]
    return object_text(members)


def object_text(members: list[tuple[str, Column]]) -> Column:
    """A JSON object of members whose values are JSON texts already."""
    parts = []
    for i, (name, value) in enumerate(members):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def content_hash() -> Column:
    return sha256_hex(content_text())


def canonical_instant(ts: Column) -> Column:
    """30 characters, UTC, of a timestamp in microseconds (session zone: UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")


def instant_to_timestamp(text: Column) -> Column:
    """Microseconds of a canonical instant; nanoseconds stay in the text only."""
    return F.to_timestamp(F.concat(F.substr(text, F.lit(1), F.lit(26)), F.lit("Z")))


def short_instant(text: Column) -> Column:
    """An instant with 0, 3, 6 or 9 digits of fraction; null is the text null."""
    for digits, zeros in ((0, 9), (3, 6), (6, 3)):
        text = F.regexp_replace(text, rf"\.(\d{{{digits}}})0{{{zeros}}}Z$", ".$1Z")
    return F.coalesce(F.replace(text, F.lit(".Z"), F.lit("Z")), F.lit("null"))
