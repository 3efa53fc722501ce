"""Compact JSON text with sorted keys and double-precision numbers.

The only per-value Python in the engine besides envelope decoding; called from the
redaction UDF for bodies that a policy actually changes.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from json.encoder import encode_basestring

_LONE_SURROGATE = re.compile("[\ud800-\udfff]")
# Characters a JSON string writes as an HTML-safe escape.
_HTML_SAFE = str.maketrans(
    {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}
)


_UNSAFE = re.compile("[<>&\u2028\u2029]")


def clean(text: str) -> str:
    """Undecodable bytes and lone surrogates become U+FFFD."""
    return text if text.isascii() else _LONE_SURROGATE.sub("\ufffd", text)


def _reject_constant(name: str):
    raise ValueError(f"not JSON: {name}")


def _double(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


_STRICT = json.JSONDecoder(
    parse_constant=_reject_constant, parse_int=_double, parse_float=_double
)


def loads(raw: bytes):
    """Strict JSON; every number is a double."""
    return _STRICT.decode(raw.decode("utf-8", "surrogateescape"))


def number_text(value: float) -> str:
    text = repr(value)
    if "e" not in text and abs(value) >= 1e-6 or value == 0:
        return text.removesuffix(".0")
    if 1e-6 <= abs(value) < 1e21:
        return format(Decimal(text), "f")
    return text.replace("e-0", "e-")


def string_text(value: str) -> str:
    text = encode_basestring(value if value.isascii() else clean(value))
    return text.translate(_HTML_SAFE) if _UNSAFE.search(text) else text


def dumps(value) -> str:
    kind = value.__class__
    if kind is str:
        return string_text(value)
    if kind is float:
        return number_text(value)
    if kind is dict:
        members = {clean(k): v for k, v in value.items()}
        return "{" + ",".join([f"{string_text(k)}:{dumps(members[k])}" for k in sorted(members)]) + "}"
    if kind is list:
        return "[" + ",".join([dumps(v) for v in value]) + "]"
    return "null" if value is None else "true" if value else "false"
