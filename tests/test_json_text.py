import json
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import json_text as J
from ledgerloom.functions.json_text import canonical, parse_payload


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ('{ "b": 1, "a": 2 }', '{"a":2,"b":1}'),
        ('{"z":{"y":1,"x":2},"a":[3,2,1]}', '{"a":[3,2,1],"z":{"x":2,"y":1}}'),
        ("[3,1,2]", "[3,1,2]"),
        ('{"a":1.50,"b":10,"c":0.0,"d":-2.000}', '{"a":1.5,"b":10,"c":0,"d":-2}'),
        ('{"k":"a\\"b\\nc"}', '{"k":"a\\"b\\nc"}'),
        ('{"k":"café"}', '{"k":"café"}'),
        ('{"k":"\\u0001\\u001F"}', '{"k":"\\u0001\\u001f"}'),
        ('{"a":1e2,"b":-0,"c":123456789012345678901234567890}', '{"a":100,"b":0,"c":123456789012345678901234567890}'),
        ('{"\\ud83d\\ude00":1,"\\uffff":2}', '{"￿":2,"\U0001f600":1}'),
    ],
)
def test_canonical(given_text, expected):
    assert J.canonical(J.parse(given_text)) == expected


def test_leaves_in_document_order():
    found = J.leaves(J.parse('{"amount":10,"account":{"number":"123"},"tags":["a","b"],"empty":{},"none":null,"yes":true}'))
    assert found == [("/amount", "N10"), ("/account/number", "S123"), ("/tags/0", "Sa"), ("/tags/1", "Sb"), ("/empty", "E{}"), ("/none", "Z"), ("/yes", "Btrue")]
    assert [p for p, _ in J.leaves(J.parse('{"a/b":1,"c~d":2}'))] == ["/a~1b", "/c~0d"]
    assert J.leaves({}) == [("", "E{}")]


def test_replaced_leaves():
    root = J.parse('{"a":{"b~/":[1,2]},"c":3}')
    assert J.canonical(J.replaced(root, [("/a/b~0~1/1", "x"), ("/c", "y")])) == '{"a":{"b~/":[1,"x"]},"c":"y"}'


_VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), inner, max_size=4),
    max_leaves=12,
)


def _plain(value):
    """An independent writer, by another route: json.dumps of rebuilt values."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_plain(k)}:{_plain(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-32-be"))) + "}"
    if isinstance(value, list):
        return f"[{','.join(map(_plain, value))}]"
    if isinstance(value, float):
        text = f"{Decimal(repr(value)):f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text in ("-0", "0", "") else text
    return json.dumps(value, ensure_ascii=False).replace("\x7f", "\x7f")


@given(_VALUES)
def test_canonical_against_another_writer(value):
    assert J.canonical(J.parse(json.dumps(value))) == _plain(value)


def test_payload_columns(spark):
    rows = [('{"b":1,"a":[]}',), ('"nope"',), ("{",), (None,), ("NaN",)]
    got = [r["p"] for r in spark.createDataFrame(rows, "t string").select(J.parse_payload(F.col("t")).alias("p")).collect()]
    assert got[0]["canonical"] == '{"a":[],"b":1}' and got[0]["is_object"] and [tuple(x) for x in got[0]["leaves"]] == [("/b", "N1"), ("/a", "E[]")]
    assert got[1]["is_object"] is False and got[1]["canonical"] == '"nope"' and [tuple(x) for x in got[1]["leaves"]] == [("", "Snope")]
    assert got[2]["is_object"] is False and got[2]["canonical"] is None
    assert got[3] is None and got[4]["is_object"] is False


def test_json_string_column(spark):
    texts = ["plain", 'q"\\', "\b\f\n\r\t", "\x00\x1f\x7f", "é😀", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(J.json_string(F.col("t"))).collect()]
    assert got == [J.canonical(t) for t in texts]


def test_registered_for_sql(spark):
    J.register(spark)
    assert spark.sql("""SELECT parse_payload('{"b":2,"a":1}').canonical""").first()[0] == '{"a":1,"b":2}'


def test_deep_and_infinite_values(spark):
    deep = "[" * 1500 + "]" * 1500
    rows = [(f'{{"a":{deep}}}',), ('{"a":1e400}',), ('{"a":-1e999}',), ("[" * 200_000,), ('{"a":1e308}',)]
    got = [r["p"] for r in spark.createDataFrame(rows, "t string").select(parse_payload(F.col("t")).alias("p")).collect()]
    assert [p["is_object"] for p in got][1:4] == [False] * 3 and got[4]["is_object"]
    assert not got[0]["is_object"] or got[0]["canonical"] == rows[0][0]
    value = 1
    for _ in range(50_000):
        value = {"k": [value]}
    assert canonical(value) == '{"k":[' * 50_000 + "1" + "]}" * 50_000
