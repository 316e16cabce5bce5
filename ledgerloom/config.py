"""Settings of a ledger, and the values that its hashes freeze."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

# Fixed values of the hash format.
GENESIS = "cdb3681748c47491bb74d81d0c8fb45444a52577331ee03b951cb2b9775fe0fa"
LEAF_PREFIX = "LEAF1"
RECORD_PREFIX = "REC1"
SEPARATOR = "\x1f"
SENTINEL_PREFIX = "__REDACTED__:"
REDACTION_EVENT_TYPE = "AUDIT_RECORD_REDACTED"
REPORT_EVENT_TYPE = "COMPLIANCE_REPORT_GENERATED"
REDACTION_RESOURCE_TYPE = "AUDIT_EVENT"
REPORT_BUNDLE_FILTER = "complianceAccessReport"
VIOLATION_TYPES = (
    "GENESIS_MISMATCH",
    "SEQUENCE_GAP",
    "CONTENT_HASH_MISMATCH",
    "LEAF_COMMITMENT_MISMATCH",
    "RECORD_HASH_MISMATCH",
    "PREV_HASH_MISMATCH",
    "MISSING_SALT",
)
#: A key that repeats, which a database refuses and a lake table doesn't.
DUPLICATE_KEY = "DUPLICATE_KEY"


@dataclass(frozen=True)
class LedgerConfig:
    genesis: str = GENESIS
    retention_enabled: bool = True
    retention_window: timedelta = timedelta(days=365)
    retain_salt: bool = True
    hmac_secret: str | None = None
    access_event_types: tuple[str, ...] = ("ACCOUNT_VIEWED", "ACCOUNT_STATEMENT_DOWNLOADED", "ACCOUNT_SEARCHED", "ACCOUNT_EXPORTED")
    client_data_resource_types: tuple[str, ...] = ("CLIENT_ACCOUNT", "CLIENT_ACCOUNT_STATEMENT")
