"""Table schemas."""

from __future__ import annotations

_EVENT = (
    "seq long, event_id string, event_type string, actor_id string, resource_type string, resource_id string, "
    "payload_json string, leaf_salts_json string, leaf_commitments_json string, event_ts_c string, recorded_at_c string, "
    "event_ts timestamp, recorded_at timestamp, content_hash string, prev_hash string, record_hash string, archived_at timestamp"
)
AUDIT_EVENT = _EVENT
ARCHIVED_EVENT = _EVENT
EVENT_COLUMNS = [c.split()[0] for c in _EVENT.split(", ")]
REDACTION = (
    "redaction_id string, event_seq long, field_path string, field_commitment string, field_salt string, "
    "salt_retained boolean, reason string, redacted_by string, redacted_at timestamp"
)
#: What comes in: the payload stays JSON text.
NEW_EVENT = "event_type string, actor_id string, resource_type string, resource_id string, payload string, timestamp string"
REDACTION_REQUEST = "request_id string, event_id string, field_paths array<string>, reason string, redacted_by string, retain_salt boolean"
ACCESS_REQUEST = "request_id string, resource_type string, resource_id string, from_c string, to_c string, requested_by string"
LEAVES = "array<struct<pointer:string,leaf:string>>"
PARSED_PAYLOAD = f"struct<is_object:boolean,canonical:string,leaves:{LEAVES}>"
PAIRS = "array<struct<pointer:string,value:string>>"
BUNDLE_RECORD = (
    "struct<seq:bigint,eventId:string,eventType:string,actorId:string,resourceType:string,resourceId:string,payload:string,"
    "leafSalts:map<string,string>,leafCommitments:map<string,string>,redactedPaths:array<string>,eventTimestamp:string,"
    "recordedAt:string,contentHash:string,prevHash:string,recordHash:string,archived:boolean>"
)
BUNDLE = (
    "bundleVersion string, exportedAt string, filter struct<type:string,value:string>, genesisHash string, "
    f"records array<{BUNDLE_RECORD}>, segments array<struct<fromSeq:bigint,toSeq:bigint,priorRecordHash:string>>, bundleHash string, hmac string"
)
