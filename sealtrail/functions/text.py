"""Timestamps, masks, JSON string escapes and id shapes as native Columns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from sealtrail.functions.hashing import _col

# The accepted timestamp and id shapes.
RFC3339 = (
    r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
    r"(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)"
)
UUID_TEXT = (
    r"(?i)^((urn:uuid:)?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|[0-9a-f]{32})\z"
)

_RFC3339 = re.compile(RFC3339)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_EPOCH_DAY = _EPOCH.toordinal()


def parse_rfc3339(c: Column | str) -> Column:
    """Strict RFC 3339 text to TIMESTAMP; NULL for any other shape.

    Spark's own cast also takes dates, blanks and missing zones, so a shape check
    comes first.  Digits beyond microseconds are cut, never rounded.
    """
    c = _col(c)
    micros = F.regexp_replace(c, r"(\.\d{6})\d+", "$1")
    return F.when(c.rlike(RFC3339 + r"\z"), F.try_to_timestamp(micros))


def rfc3339_nanos(c: Column | str) -> Column:
    """Nanoseconds since the epoch of strict RFC 3339 text (BIGINT)."""
    c = _col(c)
    fraction = F.regexp_extract(c, r"\.(\d+)", 1)
    below_micro = F.substring(F.rpad(fraction, 9, "0"), 7, 3).cast("bigint")
    return F.unix_micros(parse_rfc3339(c)) * 1000 + below_micro


def format_rfc3339(ts: Column | str = "ts", ts_ns: Column | str = "ts_ns") -> Column:
    """UTC text with as many fraction digits as needed and no trailing zeros."""
    nanos = F.lpad(F.pmod(_col(ts_ns), F.lit(1_000_000_000)).cast("string"), 9, "0")
    fraction = F.regexp_replace(F.concat(F.lit("."), nanos), r"\.?0+$", "")
    return F.concat(F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def is_uuid(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(UUID_TEXT), F.lit(False))


def _byte_char(data: Column, position: Column) -> Column:
    """The character whose code point is the byte at a 1-based position."""
    byte = F.conv(F.hex(F.substring(data, position, F.lit(1))), 16, 10)
    return F.char(byte.cast("bigint"))


def mask(c: Column | str) -> Column:
    """First and last byte kept, the bytes between starred; up to two bytes give '*'."""
    c = _col(c)
    data = F.encode(c, "UTF-8")
    size = F.octet_length(data)
    return F.when(size <= 2, F.lit("*")).otherwise(
        F.concat(
            _byte_char(data, F.lit(1)),
            F.repeat(F.lit("*"), size - 2),
            _byte_char(data, size),
        )
    )


# Characters a JSON string writes as an escape, the backslash first.
_JSON_ESCAPES = [
    ("\\", "\\\\"),
    ('"', '\\"'),
    ("\b", "\\b"),
    ("\f", "\\f"),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\t", "\\t"),
    ("<", "\\u003c"),
    (">", "\\u003e"),
    ("&", "\\u0026"),
    ("\u2028", "\\u2028"),
    ("\u2029", "\\u2029"),
]


_OTHER_CONTROLS = [
    (chr(code), f"\\u{code:04x}") for code in range(0x20) if chr(code) not in dict(_JSON_ESCAPES)
]


def json_string(c: Column | str) -> Column:
    """Text as a JSON string literal with HTML-safe escapes."""
    out = _col(c)
    # Most text has none or few of these; only text that does is rewritten.
    for escapes in (_JSON_ESCAPES, _OTHER_CONTROLS):
        rewritten = out
        for raw, escaped in escapes:
            rewritten = F.replace(rewritten, F.lit(raw), F.lit(escaped))
        present = "[" + "".join(f"\\x{{{ord(raw):x}}}" for raw, _ in escapes) + "]"
        out = F.when(out.rlike(present), rewritten).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def hash_text_field(c: Column | str) -> Column:
    """Prefixed SHA-256 of a text value's JSON form."""
    return F.concat(F.lit("sha256:"), F.sha2(json_string(c).cast("binary"), 256))


# --- scalars for driver-side arguments (cursors, query objects) and decoders ---


def nanos_of(text: str) -> int | None:
    """Strict RFC 3339 text to epoch nanoseconds; None for any other shape."""
    if not _RFC3339.fullmatch(text):
        return None
    zone = 1 if text[-1] == "Z" else 6
    head, _, fraction = text[:-zone].partition(".")
    try:
        local = datetime.fromisoformat(head)
    except ValueError:  # 31 February and the like, year 0
        return None
    seconds = (local.toordinal() - _EPOCH_DAY) * 86_400
    seconds += local.hour * 3600 + local.minute * 60 + local.second
    if zone == 6:
        ahead = int(text[-5:-3]) * 3600 + int(text[-2:]) * 60
        seconds += -ahead if text[-6] == "+" else ahead
    return seconds * 1_000_000_000 + (int(fraction[:9].ljust(9, "0")) if fraction else 0)


def text_of(nanos: int) -> str:
    """Epoch nanoseconds to UTC RFC 3339 text."""
    seconds, rest = divmod(nanos, 1_000_000_000)
    head = (_EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0")
    return head + (f".{rest:09d}".rstrip("0") if rest else "") + "Z"
