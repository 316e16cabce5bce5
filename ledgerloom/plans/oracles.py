"""DuckDB SQL that must give the same rows as the registered queries."""

from __future__ import annotations

from ledgerloom.config import GENESIS

_UUID = "substr({0},1,8)||'-'||substr({0},9,4)||'-'||substr({0},13,4)||'-'||substr({0},17,4)||'-'||substr({0},21,12)"
_KEY = b"test-hmac-secret".ljust(64, b"\0")


def _blob(pad: int) -> str:
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in _KEY) + "'::BLOB"


def _hmac(text: str) -> str:
    return f"sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode({text}))))"



def _hashed(event_ts: str = "ts_c", recorded_at: str = "ts_c", seq: str = "event_id + 1") -> str:
    return f"""
WITH raw AS (
  SELECT event_id AS n, {seq} AS seq, sha256('event-' || event_id) AS d, user_id, upper(event_type) AS kind,
    json_extract_string(props, '$.k') AS k, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS v,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS ts_c, ts
  FROM events),
base AS (
  SELECT n, seq, {_UUID.format('d')} AS event_id, ts, ts_c, k, v,
    CASE kind WHEN 'VIEW' THEN 'ACCOUNT_VIEWED' WHEN 'CLICK' THEN 'ACCOUNT_SEARCHED' ELSE kind END AS event_type,
    'user-' || user_id AS actor_id, CASE WHEN user_id % 4 = 3 THEN 'SERVER_CONFIG' ELSE 'CLIENT_ACCOUNT' END AS resource_type,
    'acct-' || (user_id % 40) AS resource_id, '{{"k":' || k || ',"value":' || v || '}}' AS payload
  FROM raw),
salted AS (SELECT *, substr(sha256(event_id || '/k'), 1, 32) AS sk, substr(sha256(event_id || '/value'), 1, 32) AS sv FROM base),
committed AS (
  SELECT *, sha256('LEAF1' || chr(31) || sk || chr(31) || 'N' || k) AS ck, sha256('LEAF1' || chr(31) || sv || chr(31) || 'N' || v) AS cv
  FROM salted),
hashed AS (
  SELECT *, '{{"/k":"' || sk || '","/value":"' || sv || '"}}' AS salts_json, '{{"/k":"' || ck || '","/value":"' || cv || '"}}' AS commitments_json,
    sha256('{{"actorId":"' || actor_id || '","eventId":"' || event_id || '","eventTimestamp":"' || {event_ts} || '","eventType":"' || event_type
      || '","payloadLeafHashes":{{"/k":"' || ck || '","/value":"' || cv || '"}},"recordedAt":"' || {recorded_at} || '","resourceId":"' || resource_id
      || '","resourceType":"' || resource_type || '","seq":' || seq || ',"v":1}}') AS content_hash
  FROM committed)"""


HASHED = _hashed()

# The fold keeps all hashes so far in one text, the last one first.
_FOLD = "list_reduce({0}, lambda acc, x: sha256('REC1' || chr(31) || substr(acc, 1, 64) || chr(31) || x) || acc, '" + GENESIS + "')"

CHAIN = (
    HASHED
    + f""",
folded AS (SELECT {_FOLD.format('list(content_hash ORDER BY seq)')} AS acc, count(*) AS total FROM hashed),
chain AS (
  SELECT h.*, substr(acc, 64 * (total - seq) + 1, 64) AS record_hash, substr(acc, 64 * (total - seq + 1) + 1, 64) AS prev_hash
  FROM hashed h, folded)"""
)

# A chain for each actor: the same fold within each.
CHAINS = (
    _hashed(seq="row_number() OVER (PARTITION BY user_id ORDER BY event_id)")
    + f""",
folded AS (SELECT actor_id, {_FOLD.format('list(content_hash ORDER BY seq)')} AS acc, count(*) AS total FROM hashed GROUP BY actor_id),
chain AS (
  SELECT h.*, h.actor_id AS chain, ('0x' || substr(event_id, 1, 8))::BIGINT % 101 AS x, total AS last_seq, substr(acc, 1, 64) AS last_hash,
    substr(acc, 64 * (total - seq) + 1, 64) AS record_hash, substr(acc, 64 * (total - seq + 1) + 1, 64) AS prev_hash
  FROM hashed h JOIN folded USING (actor_id))"""
)

_REDACTION_ID = "sha256('run-1' || chr(31) || seq || chr(31) || '/value')"
_CHAIN_REDACTION = "sha256('run-1' || chr(31) || chain || chr(31) || seq || chr(31) || '/value')"
_MONTHS = f"""{HASHED},
placed AS (SELECT *, '2024-0' || (1 + n * 6 // (SELECT count(*) FROM events)) AS month FROM hashed),
dated AS (SELECT *, month || substr(ts_c, 8) < '2024-03-16T00:00:00' AS due FROM placed)"""
_REQUESTED = "seq % 10 IN (1, 2, 3, 4)"
_WON = f"({_REQUESTED} AND seq % 50 NOT IN (1, 2, 3, 4))"

_RECORD = """'{"actorId":"' || actor_id || '","archived":false,"contentHash":"' || content_hash || '","eventId":"' || event_id || '","eventTimestamp":"' || ts_c
  || '","eventType":"' || event_type || '","leafCommitments":' || commitments_json || ',"leafSalts":' || salts_json || ',"payload":' || payload || ',"prevHash":"' || prev_hash
  || '","recordHash":"' || record_hash || '","recordedAt":"' || ts_c || '","redactedPaths":[],"resourceId":"' || resource_id || '","resourceType":"' || resource_type || '","seq":' || seq || '}'"""


def _bundles(selected: str, chain: str = CHAIN, keys: str = "seq") -> str:
    """CTEs over selected(bundle_key, filter_type, filter_value, keys or null)."""
    return f"""{chain},
selected AS ({selected}),
picked AS (SELECT s.bundle_key, c.* FROM selected s JOIN chain c USING ({keys})),
numbered AS (SELECT *, seq - row_number() OVER (PARTITION BY bundle_key ORDER BY seq) AS island FROM picked),
segments AS (
  SELECT bundle_key, min(seq) AS from_seq, max(seq) AS to_seq, min_by(prev_hash, seq) AS prior_record_hash FROM numbered GROUP BY bundle_key, island),
record_texts AS (SELECT bundle_key, string_agg({_RECORD}, ',' ORDER BY seq) AS records FROM picked GROUP BY bundle_key),
segment_texts AS (
  SELECT bundle_key, string_agg('{{"fromSeq":' || from_seq || ',"priorRecordHash":"' || prior_record_hash || '","toSeq":' || to_seq || '}}', ',' ORDER BY from_seq) AS segs
  FROM segments GROUP BY bundle_key),
headers AS (
  SELECT f.*, sha256('{{"bundleVersion":"1","exportedAt":"2026-01-01T00:00:00.000000000Z","filter":{{"type":"' || filter_type || '","value":"' || filter_value
    || '"}},"genesisHash":"{GENESIS}","records":[' || coalesce(records, '') || '],"segments":[' || coalesce(segs, '') || ']}}') AS bundle_hash
  FROM (SELECT DISTINCT bundle_key, filter_type, filter_value FROM selected) f LEFT JOIN record_texts USING (bundle_key) LEFT JOIN segment_texts USING (bundle_key))"""


_BY_RESOURCE = _bundles("SELECT 'resourceId=' || resource_id AS bundle_key, 'resourceId' AS filter_type, resource_id AS filter_value, seq FROM chain")

_WINDOWS = (
    "requests AS (SELECT resource_type || '/' || resource_id || '/' || w AS request_id, resource_type, resource_id, from_c, to_c FROM (SELECT DISTINCT resource_type, resource_id FROM hashed), "
    "(VALUES ('w1', '2024-01-03T00:00:00.000000000Z', '2024-01-09T06:30:00.500000000Z'), ('w2', NULL, NULL)) t(w, from_c, to_c))"
)
_MATCHED = """matched AS (
  SELECT r.request_id, r.resource_id AS filter_value, h.seq FROM requests r LEFT JOIN hashed h ON h.resource_type = r.resource_type AND h.resource_id = r.resource_id
    AND h.event_type IN ('ACCOUNT_VIEWED', 'ACCOUNT_SEARCHED') AND (from_c IS NULL OR ts_c >= from_c) AND (to_c IS NULL OR ts_c < to_c)
  WHERE r.resource_type = 'CLIENT_ACCOUNT')"""

_AT = "2026-01-01T00:00:00.000000000Z"
_EVENT_TIME = f"CASE WHEN n % 3 = 0 THEN '{_AT}' ELSE ts_c END"
_LINKED = f"{CHAIN} SELECT seq, event_id, ts_c AS event_ts_c, content_hash, prev_hash, record_hash FROM chain"
_SHORT = "coalesce(replace(replace({0}, '.000000000Z', 'Z'), '500000000Z', '500Z'), 'null')"
_TAKEN = "seq % 8 = 3"

_REPORTS = (
    _bundles(f"WITH {_WINDOWS}, {_MATCHED} SELECT request_id AS bundle_key, 'complianceAccessReport' AS filter_type, filter_value, seq FROM matched")
    + f""", {_WINDOWS}, {_MATCHED},
counted AS (SELECT request_id, coalesce(min(seq), 0) AS from_seq, coalesce(max(seq), 0) AS to_seq, count(seq) AS matched_count FROM matched GROUP BY request_id),
reports AS (SELECT request_id, resource_type, resource_id, from_c, to_c, from_seq, to_seq, matched_count, true AS chain_intact, bundle_hash,
  sha256(resource_type || chr(31) || resource_id || chr(31) || {_SHORT.format('from_c')} || chr(31)
    || {_SHORT.format('to_c')} || chr(31) || bundle_hash || chr(31) || matched_count) AS report_hash
FROM counted JOIN requests USING (request_id) JOIN headers ON bundle_key = request_id)"""
)
_REPORT_EVENTS = f""" SELECT request_id, 'COMPLIANCE_REPORT_GENERATED' AS event_type, 'auditor' AS actor_id, resource_type, resource_id,
  '{{"resourceType":"' || resource_type || '","resourceId":"' || resource_id || '","from":"' || {_SHORT.format('from_c')} || '","to":"' || {_SHORT.format('to_c')}
    || '","requestedBy":"auditor","matchedCount":' || matched_count || ',"reportHash":"' || report_hash || '","bundleHash":"' || bundle_hash || '"}}' AS payload FROM reports"""

_BY_ACTOR = f"{HASHED}, own AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY n) AS place, ('0x' || substr(event_id, 1, 8))::BIGINT % 101 AS x FROM hashed)"

ORACLE_SQL = {
    "append_many_chains": f"{CHAINS} SELECT chain, seq, event_id, content_hash, prev_hash, record_hash FROM chain",
    "chains_ledger": f"{CHAINS} SELECT chain, seq, prev_hash, record_hash, last_seq, last_hash FROM chain",
    "chains_redacted": f"""{CHAINS} SELECT chain, seq, CASE WHEN seq % 5 = 1 THEN '{{"k":' || k || ',"value":"__REDACTED__:' || {_UUID.format(_CHAIN_REDACTION)} || '"}}' ELSE payload END AS payload_json,
  CASE WHEN seq % 5 = 1 THEN '{{"/k":"' || sk || '"}}' ELSE salts_json END AS leaf_salts_json, record_hash FROM chain""",
    "chains_verified": f"""{CHAINS},
summed AS (
  SELECT chain, max(seq) AS last_seq, min(seq) FILTER (x = 5 AND ts < TIMESTAMP '2024-01-17') AS b, count(*) FILTER (ts < TIMESTAMP '2024-01-17') > 0 AS any_due FROM chain GROUP BY chain)
SELECT chain, b IS NULL AS intact, coalesce(b, last_seq) AS records_checked, 1::BIGINT AS from_seq, coalesce(b, last_seq) AS to_seq, true AS deep, (b IS NULL AND any_due)::BIGINT AS archived_runs,
  b AS violation_seq, CASE WHEN b > 0 THEN 'LEAF_COMMITMENT_MISMATCH' END AS violation_type, CASE WHEN b > 0 THEN 'payload leaf /k was modified' END AS detail, last_seq FROM summed""",
    "chains_bundles": _bundles(
        "SELECT chain || '/eventType=ACCOUNT_VIEWED' AS bundle_key, 'eventType' AS filter_type, 'ACCOUNT_VIEWED' AS filter_value, chain, seq FROM chain WHERE event_type = 'ACCOUNT_VIEWED'", CHAINS, "chain, seq"
    )
    + " SELECT bundle_key, bundle_hash FROM headers",
    "retention_months": f"""{_MONTHS}
SELECT month, count(*) AS n, count(*) FILTER (due) AS archived, count(*) FILTER (NOT due) AS payloads, 1 + bool_or(due)::BIGINT AS made FROM dated GROUP BY month""",
    "redaction_overlay": f"""{_MONTHS},
touched AS (SELECT DISTINCT month FROM dated WHERE seq % 1000 = 7 AND month < '2024-03'),
months AS (SELECT DISTINCT month, month IN (SELECT month FROM touched) AS hit FROM dated)
SELECT 'row' AS what, CASE WHEN month < '2024-03' THEN '{{"k":' || k || ',"value":"__REDACTED__:' || {_UUID.format(_REDACTION_ID)} || '"}}' ELSE payload END AS payload_json,
  CASE WHEN month < '2024-03' THEN '{{"/k":"' || sk || '"}}' ELSE salts_json END AS month, seq AS made FROM dated WHERE seq % 1000 = 7
UNION ALL SELECT 'merged', 'events', month, 1 FROM months UNION ALL SELECT 'merged', 'patches', month, 2 FROM touched UNION ALL SELECT 'compacted', month, NULL, NULL FROM touched
UNION ALL SELECT 'compact', 'events', month, CASE WHEN hit THEN 3 ELSE 1 END FROM months""",
    "redact_chained_requests": """SELECT printf('r%09d', event_id) AS request_id, 'a leaf is redacted by an earlier request on seq 1' AS reason
FROM events WHERE event_id % 2 = 1 AND event_id < (SELECT max(event_id) FROM events)""",
    "verify_many_chains": f"""{_BY_ACTOR},
kept AS (SELECT actor_id, place, x FROM own WHERE x != 7),
ends AS (SELECT actor_id, max(place) AS last_seq FROM kept GROUP BY actor_id),
found AS (
  SELECT actor_id, place AS seq, 'CONTENT_HASH_MISMATCH' AS kind, 'recomputed content_hash != stored' AS detail FROM kept WHERE x = 8
  UNION ALL SELECT actor_id, place, 'SEQUENCE_GAP', 'expected seq ' || place || ' but next present record is ' || (SELECT min(k.place) FROM kept k WHERE k.actor_id = own.actor_id AND k.place > own.place)
  FROM own JOIN ends USING (actor_id) WHERE x = 7 AND place < last_seq),
first AS (SELECT actor_id, arg_min({{'s': seq, 'k': kind, 'd': detail}}, seq) AS v FROM found GROUP BY actor_id)
SELECT actor_id AS chain, v IS NULL AS intact, coalesce(v.s, last_seq) AS records_checked, last_seq, v.s AS violation_seq, v.k AS violation_type, v.d AS detail FROM ends LEFT JOIN first USING (actor_id)""",
    "append_in_batches": _LINKED,
    "append_stream": _LINKED,
    "append_default_time": f"{_hashed(_EVENT_TIME, repr(_AT))} SELECT seq, {_EVENT_TIME} AS event_ts_c, '{_AT}' AS recorded_at_c, content_hash FROM hashed",
    "json_ingest": f"{HASHED} SELECT event_type, actor_id, resource_type, resource_id, payload, ts_c AS timestamp FROM hashed",
    "escaped_pointers": f"""{HASHED},
p AS (SELECT n, k, v, '{{"a/b":' || k || ',"c~d":{{"list":[true,null,"é"],"x/~y":' || v || '}}}}' AS canonical FROM hashed)
SELECT n, canonical, unnest(['/c~0d/x~1~0y', '/c~0d/list/0', '/c~0d/list/1', '/c~0d/list/2', '/a~1b']) AS pointer, unnest(['N' || v, 'Btrue', 'Z', 'Sé', 'N' || k]) AS leaf FROM p""",
    "verify_ranges": """WITH kept AS (SELECT event_id + 1 AS seq FROM events WHERE (event_id + 1) % 1009 != 700), r(a, z) AS (VALUES (101, 600), (301, 900), (702, 1500)),
b AS (SELECT a, least(z, (SELECT max(seq) FROM kept)) AS z FROM r),
g AS (SELECT a, z, (SELECT min(x) FROM (SELECT unnest(range(a, z + 1)) AS x) WHERE x NOT IN (SELECT seq FROM kept)) AS gap FROM b)
SELECT a AS asked_from, gap IS NULL AS intact, greatest(coalesce(gap, z) - a + 1, 0)::BIGINT AS records_checked, a::BIGINT AS from_seq,
  CASE WHEN a > z THEN 0 ELSE coalesce((SELECT min(seq) FROM kept WHERE seq > gap), z) END::BIGINT AS to_seq, gap::BIGINT AS violation_seq FROM g""",
    "verify_duplicates": f"""{HASHED} SELECT false AS intact, 105::BIGINT AS records_checked, 105::BIGINT AS violation_seq, 'DUPLICATE_KEY' AS violation_type,
  '2 rows have event_id ' || event_id AS detail FROM hashed WHERE seq = 105""",
    "verify_increments": """SELECT 0::BIGINT AS batch_id, 1::BIGINT AS from_seq, 500::BIGINT AS to_seq, true AS intact, NULL::BIGINT AS violation_seq, NULL AS violation_type
UNION ALL SELECT 1, 501, 700, false, 700, 'CONTENT_HASH_MISMATCH'""",
    "query_by_event_id": f"{HASHED} SELECT seq, event_id, content_hash FROM hashed WHERE seq = 42",
    "query_by_event_ids": f"{HASHED} SELECT seq, event_id, content_hash FROM hashed WHERE n % 97 = 1",
    "query_seq_range": f"{HASHED} SELECT seq, event_id, content_hash FROM hashed WHERE seq BETWEEN 101 AND 250",
    "query_by_seqs": f"{HASHED} SELECT seq, event_id, content_hash FROM hashed WHERE seq IN (SELECT event_id * 2 FROM events WHERE event_id % 89 = 2)",
    "redact_again": f"""WITH r AS (SELECT event_id + 1 AS seq, printf('%012d', event_id + 1) AS id FROM events), told AS (
  SELECT 'a' || id AS request_id, CASE WHEN seq % 50 = 1 AND {_TAKEN} THEN '/value is already redacted on seq ' || seq WHEN seq % 50 = 1 THEN 'payload has no leaf at /none'
    WHEN seq % 50 = 2 THEN '/k is already redacted on seq ' || seq WHEN seq % 50 = 3 THEN 'fieldPaths must not be empty' WHEN seq % 50 = 4 THEN 'no audit event nobody'
    WHEN {_TAKEN} THEN '/value is already redacted on seq ' || seq END AS reason FROM r WHERE {_REQUESTED}
  UNION ALL SELECT 'b' || id, CASE WHEN seq % 50 = 4 THEN 'no audit event nobody' WHEN {_TAKEN} THEN '/value is already redacted on seq ' || seq
    ELSE 'a leaf is redacted by an earlier request on seq ' || seq END FROM r WHERE seq % 10 = 4)
SELECT request_id, reason FROM told WHERE reason IS NOT NULL""",
    "redact_meta_events": f"""{HASHED} SELECT 'a' || printf('%012d', seq) AS request_id, 'AUDIT_RECORD_REDACTED' AS event_type, 'dpo' AS actor_id, 'AUDIT_EVENT' AS resource_type,
  event_id AS resource_id, '{{"targetEventId":"' || event_id || '","targetSeq":' || seq || ',"reason":"erasure","redactedBy":"dpo","saltRetained":'
    || CASE WHEN seq % 20 < 10 THEN 'true' ELSE 'false' END || ',"fieldPaths":["/value"]}}' AS payload FROM hashed WHERE {_WON}""",
    "redaction_table": f"""{HASHED} SELECT seq AS event_seq, '/value' AS field_path, {_UUID.format(_REDACTION_ID)} AS redaction_id, cv AS field_commitment,
  CASE WHEN seq % 20 < 10 THEN sv END AS field_salt, seq % 20 < 10 AS salt_retained, 'erasure' AS reason, 'dpo' AS redacted_by FROM hashed WHERE {_WON}""",
    "retention_tables": f"""{CHAIN} SELECT seq, ts < TIMESTAMP '2024-01-17' AS archived, ts < TIMESTAMP '2024-01-17' AS gone, record_hash,
  CASE WHEN ts < TIMESTAMP '2024-01-17' THEN payload END AS copy, 2::BIGINT AS version FROM chain""",
    "bundle_of_one": f"{_BY_RESOURCE} SELECT bundle_key, filter_type, filter_value, bundle_hash FROM headers WHERE filter_value = 'acct-7'",
    "bundle_json": f"{CHAIN} SELECT 'resourceId=' || resource_id AS bundle_key, seq, event_id, actor_id, payload AS payload_json, salts_json AS leaf_salts_json, content_hash, prev_hash, record_hash, true AS valid FROM chain",
    "verify_chain_stream": f"""{_BY_ACTOR},
kept AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY actor_id ORDER BY place), 0) AS before FROM own WHERE x != 7)
SELECT actor_id AS chain, before + 1 AS seq, NULL AS event_id, 'SEQUENCE_GAP' AS violation_type, 'expected seq ' || (before + 1) || ' but next present record is ' || place AS detail FROM kept WHERE place > before + 1
UNION ALL SELECT actor_id, place, event_id, CASE WHEN place = 1 THEN 'GENESIS_MISMATCH' ELSE 'PREV_HASH_MISMATCH' END,
  CASE WHEN place = 1 THEN 'prev_hash != configured genesis value' ELSE 'prev_hash does not match the previous record''s record_hash' END FROM kept WHERE place = before + 1 AND x = 8""",
    "verify_changed_ranges": f"""{HASHED}
SELECT seq, event_id, 'CONTENT_HASH_MISMATCH' AS violation_type, 'recomputed content_hash != stored' AS detail FROM hashed WHERE seq % 2503 = 100
UNION ALL SELECT seq, event_id, 'RECORD_HASH_MISMATCH', 'recomputed record_hash != stored' FROM hashed WHERE seq % 2503 = 255
UNION ALL SELECT seq, event_id, 'PREV_HASH_MISMATCH', 'prev_hash does not match the previous record''s record_hash' FROM hashed WHERE seq % 2503 = 256""",
    "query_stored_lookup": f"{CHAIN} SELECT seq, event_id, record_hash FROM chain WHERE seq = 42 UNION ALL SELECT seq, event_id, record_hash FROM chain WHERE actor_id = 'user-5'",
    "compliance_many_windows": f"""{HASHED},
accounts AS (SELECT DISTINCT resource_id FROM hashed WHERE resource_type = 'CLIENT_ACCOUNT'),
days AS (SELECT resource_id, d, printf('T%02d:30:00.000000000Z', d % 24) AS t FROM accounts, range(1, 29) r(d)),
requests AS (
  SELECT resource_id || '/' || d AS request_id, resource_id, printf('2024-01-%02d', d) || t AS from_c, printf('2024-01-%02d', d + 2) || t AS to_c FROM days
  UNION ALL SELECT resource_id || '/long', resource_id, '2023-06-01T00:00:00.000000000Z', '2024-01-16T12:00:00.000000000Z' FROM accounts
  UNION ALL SELECT resource_id || '/longer', resource_id, '2001-01-01T00:00:00.000000000Z', '2101-01-01T00:00:00.000000000Z' FROM accounts
  UNION ALL SELECT resource_id || '/open', resource_id, '2024-01-20T00:00:00.000000000Z', '9' FROM accounts)
SELECT request_id, seq FROM requests r JOIN hashed h ON h.resource_type = 'CLIENT_ACCOUNT' AND h.resource_id = r.resource_id AND ts_c >= from_c AND ts_c < to_c
WHERE h.event_type IN ('ACCOUNT_VIEWED', 'ACCOUNT_SEARCHED')""",
    "compliance_capped": f"""{HASHED}, {_WINDOWS},
seen AS (
  SELECT r.request_id, h.seq, h.event_type, row_number() OVER (PARTITION BY r.request_id ORDER BY h.seq) AS place FROM requests r JOIN hashed h ON h.resource_type = r.resource_type
    AND h.resource_id = r.resource_id AND (from_c IS NULL OR ts_c >= from_c) AND (to_c IS NULL OR ts_c < to_c) WHERE r.resource_type = 'CLIENT_ACCOUNT')
SELECT request_id, seq FROM seen WHERE place <= 5 AND event_type IN ('ACCOUNT_VIEWED', 'ACCOUNT_SEARCHED')""",
    "leaf_commitments": f"{HASHED} SELECT seq, '/k' AS pointer, ck AS commitment FROM hashed UNION ALL SELECT seq, '/value', cv FROM hashed",
    "content_hashes": f"{HASHED} SELECT seq, event_id, content_hash FROM hashed",
    "append_chain": f"{CHAIN} SELECT seq, event_id, ts_c AS event_ts_c, content_hash, prev_hash, record_hash FROM chain",
    "append_actor_chains": f"""{HASHED},
per_actor AS (SELECT actor_id, list(seq ORDER BY seq) AS seqs, {_FOLD.format('list(content_hash ORDER BY seq)')} AS acc, count(*) AS total FROM hashed GROUP BY actor_id),
rows AS (SELECT actor_id, acc, total, seqs, unnest(range(1, total + 1)) AS i FROM per_actor)
SELECT actor_id AS chain_id, seqs[i] AS seq, substr(acc, 64 * (total - i + 1) + 1, 64) AS prev_hash, substr(acc, 64 * (total - i) + 1, 64) AS record_hash FROM rows""",
    "append_head": f"{CHAIN} SELECT max(seq) AS last_seq, max_by(record_hash, seq) AS last_record_hash FROM chain",
    "append_validation": """SELECT event_id AS n, CASE event_id % 11 WHEN 1 THEN 'actor_id is blank' WHEN 2 THEN 'resource_id is too long'
  WHEN 3 THEN 'payload is not a JSON object' WHEN 4 THEN 'payload is missing' END AS reason FROM events""",
    "verify_report": """SELECT true AS intact, count(*) AS records_checked, min(event_id) + 1 AS from_seq, max(event_id) + 1 AS to_seq, 0::INTEGER AS n_segments,
  NULL::BIGINT AS violation_seq FROM events""",
    "verify_tampered_report": """WITH kept AS (SELECT event_id + 1 AS seq FROM events WHERE (event_id + 1) % 1009 != 700),
gap AS (SELECT min(seq) + 1 AS e FROM kept WHERE seq + 1 NOT IN (SELECT seq FROM kept) AND seq < (SELECT max(seq) FROM kept))
SELECT e IS NULL AS intact, coalesce(e, (SELECT count(*) FROM kept)) AS records_checked, 1::BIGINT AS from_seq, coalesce((SELECT min(seq) FROM kept WHERE seq > e), (SELECT max(seq) FROM kept)) AS to_seq, e AS violation_seq,
  CASE WHEN e IS NOT NULL THEN 'SEQUENCE_GAP' END AS violation_type,
  'expected seq ' || e || ' but next present record is ' || (SELECT min(seq) FROM kept WHERE seq > e) AS detail FROM gap""",
    "verify_violations": f"""{HASHED},
told AS (SELECT seq, event_id, CASE
  WHEN seq % 1009 = 700 THEN NULL
  WHEN seq = 1 THEN 'GENESIS_MISMATCH|prev_hash != configured genesis value'
  WHEN seq % 1009 IN (401, 500) THEN 'PREV_HASH_MISMATCH|prev_hash does not match the previous record''s record_hash'
  WHEN seq % 1009 = 200 THEN 'LEAF_COMMITMENT_MISMATCH|payload leaf /k was modified'
  WHEN seq % 1009 = 250 AND k = '1' THEN 'LEAF_COMMITMENT_MISMATCH|payload leaf /value is missing (structure changed)'
  WHEN seq % 1009 = 250 THEN 'LEAF_COMMITMENT_MISMATCH|payload leaf /k was modified'
  WHEN seq % 1009 = 300 THEN 'MISSING_SALT|no salt for payload leaf /k'
  WHEN seq % 1009 = 100 THEN 'CONTENT_HASH_MISMATCH|recomputed content_hash != stored'
  WHEN seq % 1009 = 400 THEN 'RECORD_HASH_MISMATCH|recomputed record_hash != stored' END AS v FROM hashed)
SELECT seq, event_id, split_part(v, '|', 1) AS violation_type, split_part(v, '|', 2) AS detail FROM told WHERE v IS NOT NULL""",
    "verify_gaps": "SELECT event_id + 1 AS seq FROM events WHERE (event_id + 1) % 1009 = 700 AND event_id + 1 < (SELECT max(event_id) + 1 FROM events WHERE (event_id + 1) % 1009 != 700)",
    "verify_deep": f"""{HASHED} SELECT seq, event_id, CASE WHEN seq % 97 = 5 THEN 'LEAF_COMMITMENT_MISMATCH' ELSE 'CONTENT_HASH_MISMATCH' END AS violation_type,
  CASE WHEN seq % 97 = 5 THEN 'payload leaf /k was modified' ELSE 'archived row has no archive copy' END AS detail
FROM hashed WHERE ts < TIMESTAMP '2024-01-17' AND seq % 97 IN (5, 6)""",
    "archived_runs": "SELECT min(event_id + 1) AS from_seq, max(event_id + 1) AS to_seq FROM events WHERE ((event_id + 1) // 7) % 3 = 1 GROUP BY (event_id + 1) // 7",
    "query_filter": f"""{HASHED} SELECT seq, event_id, actor_id, resource_id, ts_c AS event_ts_c FROM hashed
WHERE resource_type = 'CLIENT_ACCOUNT' AND event_type = 'ACCOUNT_VIEWED' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00'""",
    "query_page": f"""{HASHED} SELECT seq, event_id, payload AS payload_json, CASE WHEN seq % 16 = 3 THEN '/k,/value' WHEN seq % 8 = 3 THEN '/value' ELSE '' END AS redacted_paths, false AS archived
FROM hashed WHERE resource_id = 'acct-2' ORDER BY seq LIMIT 20 OFFSET 20""",
    "query_page_after": f"{CHAIN} SELECT seq, event_id, record_hash FROM chain WHERE event_type = 'PURCHASE' AND seq > 100 ORDER BY seq LIMIT 30",
    "query_page_info": f"""{HASHED}, total AS (SELECT count(*) AS total FROM hashed WHERE resource_id = 'acct-2')
SELECT 1::INTEGER AS page, 20::INTEGER AS size, total, (total + 19) // 20 AS total_pages, 2 < (total + 19) // 20 AS has_next FROM total""",
    "redacted_paths": "SELECT event_id + 1 AS seq, CASE WHEN (event_id + 1) % 16 = 3 THEN '/k,/value' WHEN (event_id + 1) % 8 = 3 THEN '/value' ELSE '' END AS redacted_paths FROM events",
    "redact_rejects": f"""WITH r AS (SELECT event_id + 1 AS seq, printf('%012d', event_id + 1) AS id FROM events)
SELECT 'a' || id AS request_id, CASE seq % 50 WHEN 1 THEN 'payload has no leaf at /none' WHEN 2 THEN '/k is already redacted on seq ' || seq WHEN 3 THEN 'fieldPaths must not be empty'
  ELSE 'no audit event nobody' END AS reason FROM r WHERE {_REQUESTED} AND seq % 50 IN (1, 2, 3, 4)
UNION ALL SELECT 'b' || id, CASE WHEN seq % 50 = 4 THEN 'no audit event nobody' ELSE 'a leaf is redacted by an earlier request on seq ' || seq END FROM r WHERE seq % 10 = 4""",
    "redact_rows": f"""{HASHED} SELECT seq AS event_seq, '/value' AS field_path, {_UUID.format(_REDACTION_ID)} AS redaction_id, cv AS field_commitment,
  CASE WHEN seq % 20 < 10 THEN sv END AS field_salt, seq % 20 < 10 AS salt_retained FROM hashed WHERE {_WON}""",
    "redact_events": f"""{CHAIN} SELECT seq, CASE WHEN {_WON} THEN '{{"k":' || k || ',"value":"__REDACTED__:' || {_UUID.format(_REDACTION_ID)} || '"}}' ELSE payload END AS payload_json,
  CASE WHEN {_WON} THEN '{{"/k":"' || sk || '"}}' ELSE salts_json END AS leaf_salts_json, record_hash FROM chain""",
    "redact_then_verify": "SELECT true AS intact, count(*) AS records_checked FROM events",
    "disclosure_proof": f"""{HASHED} SELECT seq AS event_seq, '/value' AS field_path, CASE WHEN seq % 5 = 0 THEN 'N0' ELSE 'N' || v END AS leaf,
  CASE WHEN seq % 8 = 4 THEN 'unknown' WHEN seq % 5 = 0 AND v != '0' THEN 'refuted' ELSE 'proven' END AS verdict FROM hashed WHERE seq % 8 IN (3, 4)""",
    "retention_result": "SELECT count(*) AS archived, coalesce(max(event_id + 1), 0) AS through_seq FROM events WHERE ts < TIMESTAMP '2024-01-17'",
    "retention_split": f"""{CHAIN} SELECT seq, ts < TIMESTAMP '2024-01-17' AS archived, ts < TIMESTAMP '2024-01-17' AS gone, record_hash,
  CASE WHEN ts < TIMESTAMP '2024-01-17' THEN payload END AS copy FROM chain""",
    "bundle_segments": f"{_BY_RESOURCE} SELECT bundle_key, from_seq, to_seq, prior_record_hash FROM segments",
    "bundle_headers": f"{_BY_RESOURCE} SELECT bundle_key, filter_type, filter_value, bundle_hash, {_hmac('bundle_hash')} AS hmac FROM headers",
    "bundle_check": f"""{HASHED},
b AS (SELECT *, 'resourceId=' || resource_id AS bundle_key FROM hashed),
p AS (
  SELECT bundle_key, 'bundle hash mismatch' AS problem FROM b WHERE seq % 503 IN (100, 200, 300, 400) GROUP BY bundle_key
  UNION ALL SELECT bundle_key, 'leaf /k modified at seq ' || seq FROM b WHERE seq % 503 = 100
  UNION ALL SELECT bundle_key, 'leaf /value modified at seq ' || seq FROM b WHERE seq % 503 = 100 AND v != '0'
  UNION ALL SELECT bundle_key, 'content hash mismatch at seq ' || seq FROM b WHERE seq % 503 = 200
  UNION ALL SELECT bundle_key, 'record hash mismatch at seq ' || seq FROM b WHERE seq % 503 = 300
  UNION ALL SELECT bundle_key, 'segment record missing: seq ' || seq FROM b WHERE seq % 503 = 400
  UNION ALL SELECT y.bundle_key, 'broken chain link at seq ' || y.seq FROM b x JOIN b y ON y.seq = x.seq + 1 AND y.bundle_key = x.bundle_key WHERE x.seq % 503 = 300)
SELECT bundle_key, count(problem) = 0 AS valid, coalesce(string_agg(problem, ';' ORDER BY problem), '') AS problems
FROM (SELECT DISTINCT bundle_key FROM b) LEFT JOIN p USING (bundle_key) GROUP BY bundle_key""",
    "compliance_headers": _REPORTS + " SELECT request_id, from_seq, to_seq, matched_count, chain_intact, bundle_hash, report_hash FROM reports",
    "compliance_meta_events": _REPORTS + _REPORT_EVENTS,
    "compliance_entries": f"{HASHED}, {_WINDOWS}, {_MATCHED} SELECT request_id, h.seq, event_id, event_type, actor_id, ts_c AS event_ts_c FROM matched m JOIN hashed h USING (seq)",
    "compliance_rejects": f"""{HASHED}, {_WINDOWS} SELECT request_id,
  'resourceType ''' || resource_type || ''' is not classified as client account data; allowed: [CLIENT_ACCOUNT, CLIENT_ACCOUNT_STATEMENT]' AS reason
FROM requests WHERE resource_type != 'CLIENT_ACCOUNT'""",
    "canonical_strings": "SELECT doc_id, sha256(CAST(to_json(text) AS VARCHAR)) AS json_sha256 FROM documents",
    "hmacs": f"{HASHED} SELECT n, {_hmac('payload')} AS hmac FROM hashed",
}
