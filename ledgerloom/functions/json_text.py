"""Exact JSON text: canonical form, leaves by pointer, replacing leaves.

Spark's JSON functions can't write this text (key order, number form, escapes),
so payloads pass through Arrow-batched functions of one JSON parse each.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import schemas

_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPES = str.maketrans({**{chr(i): f"\\u{i:04x}" for i in range(0x20)}, **_SHORT})


class Real(str):
    """The token of a number that isn't an integer; one beyond a double's range
    is no JSON that can be written again, and is refused."""

    def __new__(cls, token: str):
        if not math.isfinite(float(token)):
            raise ValueError(f"not finite: {token}")
        return super().__new__(cls, token)


def _no_constant(token: str):
    raise ValueError(f"not JSON: {token}")


def parse(text: str):
    return json.loads(text, parse_float=Real, parse_constant=_no_constant)


def number_text(value: int | Real) -> str:
    """Integers in full; others through a double, plain, without trailing zeros."""
    if not isinstance(value, Real):
        return str(value)
    number = Decimal(repr(float(value)))
    return "0" if number == 0 else format(number.normalize(), "f")


def _scalar(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    return number_text(value) if isinstance(value, (int, Real)) else _quoted(value)


def canonical(value) -> str:
    """Canonical text, however deep the value: what is still to be written is
    kept in a list, as (text is ready, text or value)."""
    out, todo = [], [(False, value)]
    while todo:
        ready, x = todo.pop()
        if ready:
            out.append(x)
        elif isinstance(x, (dict, list)):
            members = [(f"{_quoted(k)}:", x[k]) for k in sorted(x)] if isinstance(x, dict) else [("", v) for v in x]
            opening, closing = "{}" if isinstance(x, dict) else "[]"
            todo.append((True, closing))
            for i in range(len(members) - 1, -1, -1):
                todo += [(False, members[i][1]), (True, ("," if i else "") + members[i][0])]
            out.append(opening)
        else:
            out.append(_scalar(x))
    return "".join(out)


def _quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPES)}"'


def leaf_text(value) -> str | None:
    """The canonical leaf, or null for what has leaves of its own."""
    if value is None:
        return "Z"
    if value is True or value is False:
        return "Btrue" if value else "Bfalse"
    if isinstance(value, (int, Real)):
        return f"N{number_text(value)}"
    if isinstance(value, str):
        return f"S{value}"
    return None if value else ("E{}" if isinstance(value, dict) else "E[]")


def leaves(root) -> list[tuple[str, str]]:
    """(pointer, leaf) in document order."""
    out, todo = [], [("", root)]
    while todo:
        pointer, value = todo.pop()
        leaf = leaf_text(value)
        if leaf is not None:
            out.append((pointer, leaf))
            continue
        children = value.items() if isinstance(value, dict) else enumerate(value)
        todo += reversed([(f"{pointer}/{escape(str(k))}", v) for k, v in children])
    return out


def escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def replaced(root, changes: list[tuple[str, str]]):
    """root with the leaves at the pointers replaced by strings, in place."""
    for pointer, text in changes:
        *way, last = (t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:])
        at = root
        for token in way:
            at = at[int(token)] if isinstance(at, list) else at[token]
        at[int(last) if isinstance(at, list) else last] = text
    return root


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


_LEAVES = pa.list_(pa.struct({"pointer": pa.string(), "leaf": pa.string()}))


def _parse_batch(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        if text is None:
            out.append(None)
            continue
        try:
            root = parse(text)
        except (ValueError, RecursionError):
            out.append({"is_object": False, "canonical": None, "leaves": None})
            continue
        found = [{"pointer": _clean(p), "leaf": _clean(v)} for p, v in leaves(root)]
        out.append({"is_object": isinstance(root, dict), "canonical": _clean(canonical(root)), "leaves": found})
    return pa.array(out, pa.struct({"is_object": pa.bool_(), "canonical": pa.string(), "leaves": _LEAVES}))


def _replace_batch(texts: pa.Array, changes: pa.Array) -> pa.Array:
    out = []
    for text, todo in zip(texts.to_pylist(), changes.to_pylist()):
        if text is None or not todo:
            out.append(text)
        else:
            out.append(_clean(canonical(replaced(parse(text), [(c["pointer"], c["value"]) for c in todo]))))
    return pa.array(out, pa.string())


def parse_payload(text: Column) -> Column:
    """{is_object, canonical, leaves} of JSON text; text that isn't JSON has
    is_object false and nothing else, null text is null."""
    return F.arrow_udf(_parse_batch, schemas.PARSED_PAYLOAD)(text)


def replace_leaves(text: Column, changes: Column) -> Column:
    """Canonical text with each change's pointer holding its string value."""
    return F.arrow_udf(_replace_batch, "string")(text, changes)


def json_string(text: Column) -> Column:
    """text as a JSON string in canonical form, by built-in functions: only texts
    that hold a character to escape go through the replacements."""
    pairs = [(c, _ESCAPES[ord(c)]) for c in ["\\", '"', *map(chr, range(0x20))]]
    steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e in pairs])
    escaped = F.aggregate(steps, text, lambda acc, s: F.replace(acc, s["c"], s["e"]))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text), F.lit('"'))


def register(spark) -> None:
    """Make the payload functions callable from SQL."""
    spark.udf.register("parse_payload", F.arrow_udf(_parse_batch, schemas.PARSED_PAYLOAD))
    spark.udf.register("replace_leaves", F.arrow_udf(_replace_batch, "string"))
