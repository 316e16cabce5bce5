import hashlib
import hmac

from pyspark.sql import functions as F

from ledgerloom.config import GENESIS
from ledgerloom.functions import hashing as H
from tests.ledger import golden_chain

# Golden vectors of FIXTURES.md.
CONTENT = [
    "870120b76e605309656da9eb1a8ce93bac53d32fc47a3e6705f9e67252040d0b",
    "935668c7617de23a55b24713df5023682333686c48afae9280a701f10b2ae643",
    "38f3a4961fe6a287b85bce21e052a29c34be4d1555ea7a7f5bc4565a7e359e34",
]
RECORD = [
    "c5c32e29c88fda2ad51a1b519d479768dd04aa9a098ff1e49db5559bbd320571",
    "9ff1e4d635d3caedd8468745e482a3af3aa5b68eb931b48933cacefceded7ff4",
    "9861aacd8745bf1ec6b1e30fb4e27b18761e8a919f6b1d1cd1db0019c1f94ad7",
]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_genesis():
    assert hashlib.sha256(b"tamper-evident-audit-log::genesis::v1").hexdigest() == GENESIS


def test_commitments(spark):
    expected = {
        ("aa", "S123456789"): "35e4a50d1485ed8a4e94b605d86fbbf97d548faca08ed2d57ad0466230832114",
        ("bb", "S123456789"): "5ab0c0bf356b02c896c953c0ae19ab976c7df6e6f91070673209797a999a6d42",
        ("aa", "S987654321"): "bfafee8c06a250c0daa171c48c95923a987849dabbf8e5d7a4eb174578f019b4",
    }
    for (salt, leaf), value in expected.items():
        assert one(spark, H.leaf_commitment(F.lit(salt), F.lit(leaf))) == value
    assert one(spark, H.leaf_commitment(F.lit(None).cast("string"), F.lit("S1"))) is None


def test_golden_chain(spark):
    rows = golden_chain(spark).orderBy("seq").collect()
    assert [r["content_hash"] for r in rows] == CONTENT
    assert [r["record_hash"] for r in rows] == RECORD
    assert [r["prev_hash"] for r in rows] == [GENESIS, *RECORD[:2]]


def test_hmac(spark):
    for secret in ("k", "test-hmac-secret", "x" * 100):
        assert one(spark, H.hmac_sha256_hex(secret, F.lit("text é"))) == hmac.new(secret.encode(), "text é".encode(), "sha256").hexdigest()


def test_instants(spark):
    ns = "2026-01-01T00:00:00.123456789Z"
    assert one(spark, H.canonical_instant(H.instant_to_timestamp(F.lit(ns)))) == "2026-01-01T00:00:00.123456000Z"
    expected = {
        "2026-01-01T00:00:00.000000000Z": "2026-01-01T00:00:00Z",
        "2026-01-01T00:00:00.500000000Z": "2026-01-01T00:00:00.500Z",
        "2026-01-01T00:00:00.000500000Z": "2026-01-01T00:00:00.000500Z",
        "2026-01-01T00:00:00.000000001Z": "2026-01-01T00:00:00.000000001Z",
        "2026-01-01T00:00:10.120000000Z": "2026-01-01T00:00:10.120Z",
    }
    for text, short in expected.items():
        assert one(spark, H.short_instant(F.lit(text))) == short
    assert one(spark, H.short_instant(F.lit(None).cast("string"))) == "null"


def test_string_maps(spark):
    assert one(spark, F.size(H.string_map(F.lit(None).cast("string")))) == 0
    assert one(spark, H.sorted_map_json(F.lit('{"/b":"1","/a":"2"}'))) == '{"/a":"2","/b":"1"}'
