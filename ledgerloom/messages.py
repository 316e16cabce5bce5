"""Texts of violations, problems and rejections.

Fixed values: consumers of reports match these texts, so they are kept as the
described service words them.
"""

from __future__ import annotations

# What a chain check tells.
GENESIS_DIFFERS = "prev_hash != configured genesis value"
LINK_DIFFERS = "prev_hash does not match the previous record's record_hash"
NO_ARCHIVE_COPY = "archived row has no archive copy"
CONTENT_DIFFERS = "recomputed content_hash != stored"
CONTENT_DIFFERS_ARCHIVED = "recomputed content_hash != stored (archived)"
RECORD_DIFFERS = "recomputed record_hash != stored"
LEAF = "payload leaf "
LEAF_MISSING = " is missing (structure changed)"
LEAF_MODIFIED = " was modified"
LEAF_ADDED = " was added after the record was written"
NO_SALT = "no salt for payload leaf "
GAP = "expected seq {} but next present record is {}"
NOT_ANCHORED = "predecessor of seq %d is missing; the range can't be anchored"
CUT_OFF = "records end at seq {} but chain head is {}"

# What a bundle check tells.
BUNDLE_HASH_DIFFERS = "bundle hash mismatch"
HMAC_DIFFERS = "hmac mismatch"
AT_SEQ = " at seq "
BUNDLE_CONTENT_DIFFERS = "content hash mismatch"
BUNDLE_RECORD_DIFFERS = "record hash mismatch"
BUNDLE_LEAF_UNKNOWN = "cannot verify leaf "
BUNDLE_LEAF = "leaf "
BUNDLE_LEAF_MODIFIED = " modified"
BUNDLE_RECORD_UNREADABLE = "record cannot be read"
SEGMENT_RECORD_MISSING = "segment record missing: seq "
SEGMENT_LINK_BROKEN = "broken chain link at seq "

# Why a request is turned away.
NO_EVENT = "no audit event "
IS_ARCHIVED = "cannot redact archived record seq="
NO_PATHS = "fieldPaths must not be empty"
NO_LEAF = "payload has no leaf at "
ALREADY_REDACTED = " is already redacted on seq "
RESOURCE_TYPE = "resourceType '"
NOT_CLIENT_DATA = "' is not classified as client account data; allowed: [{}]"
