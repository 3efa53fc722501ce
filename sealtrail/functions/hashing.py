"""Hash text, canonical bytes and event hashes as native Column expressions.

Everything here compiles to JVM code: verification of a whole table runs without
a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The textual hash prefix and the genesis hash.
HASH_PREFIX = "sha256:"
ZERO_HASH_HEX = "0" * 64
ZERO_HASH_TEXT = HASH_PREFIX + ZERO_HASH_HEX

_HEX64 = r"^[0-9a-fA-F]{64}\z"

# Fields covered by an event hash, in hashing order; payload_hash and prev_hash follow.
TEXT_FIELDS = ("source_service", "actor_id", "action", "target_type", "target_id")


def zero_hash() -> Column:
    return F.unhex(F.lit(ZERO_HASH_HEX))


def hex_text(c: Column | str) -> Column:
    """BINARY to lower-case hex."""
    return F.lower(F.hex(_col(c)))


def normalize_hash(c: Column | str) -> Column:
    """Add the prefix to a bare 64-digit hex hash; leave anything else as it is."""
    c = _col(c)
    return F.when(c.rlike(_HEX64), F.concat(F.lit(HASH_PREFIX), c)).otherwise(c)


def _digits(c: Column) -> Column:
    cut = F.length(F.lit(HASH_PREFIX)) + 1
    return F.when(c.startswith(HASH_PREFIX), F.substring(c, cut, F.length(c))).otherwise(c)


def hash_to_bytes(c: Column | str) -> Column:
    """Prefixed or bare hash text to 32 bytes; NULL for anything malformed."""
    digits = _digits(_col(c))
    return F.when(digits.rlike(_HEX64), F.unhex(digits))


def hash_format_error(c: Column | str) -> Column:
    """Why hash_to_bytes() gives NULL; NULL for a well-formed hash."""
    c = _col(c)
    digits = _digits(c)
    quoted = F.concat(F.lit('"'), c, F.lit('"'))
    size = (F.length(digits) / 2).cast("int").cast("string")
    return (
        F.when(digits.rlike(_HEX64), F.lit(None).cast("string"))
        .when(
            digits.rlike("^([0-9a-fA-F]{2})*$"),
            F.concat(F.lit("hash "), quoted, F.lit(" is "), size, F.lit(" bytes, want 32")),
        )
        .otherwise(F.concat(F.lit("bad hash "), quoted))
    )


def hash_to_text(c: Column | str) -> Column:
    """32 bytes to prefixed lower-case text; any other length gives ''."""
    c = _col(c)
    return F.when(F.octet_length(c) == 32, F.concat(F.lit(HASH_PREFIX), hex_text(c))).otherwise("")


def payload_hash(c: Column | str) -> Column:
    """Prefixed SHA-256 of the exact payload bytes."""
    return F.concat(F.lit(HASH_PREFIX), F.sha2(_col(c).cast("binary"), 256))


def payload_ok(hash_text: Column | str, payload: Column | str) -> Column:
    """The supplied hash names this payload.  Upper-case hex never does."""
    return normalize_hash(hash_text) == payload_hash(payload)


# Lengths looked up instead of computed: most values are short, and the lookup in a
# folded literal costs a fraction of hex, lpad and unhex.
_SHORT = 64


def length_prefixed(c: Column | str) -> Column:
    """4-byte big-endian length followed by the bytes."""
    data = _col(c).cast("binary")
    size = F.octet_length(data)
    short = F.array(*[F.lit(n.to_bytes(4, "big")) for n in range(_SHORT)])
    length = F.when(size < _SHORT, F.get(short, size)).otherwise(F.unhex(F.lpad(F.hex(size), 8, "0")))
    return F.concat(length, data)


def big_endian(c: Column | str) -> Column:
    """BIGINT as 8 big-endian bytes (two's complement)."""
    return F.unhex(F.lpad(F.hex(_col(c).cast("bigint")), 16, "0"))


def canonical_body() -> Column:
    """All hashed bytes of an event except its predecessor's hash, which comes last.

    Rows can therefore be encoded in parallel; only the final hash is sequential.
    """
    return F.concat(
        length_prefixed("id"),
        big_endian("ts_ns"),
        *[length_prefixed(f) for f in TEXT_FIELDS],
        length_prefixed("payload_hash"),
    )


def event_hash(body: Column | str, prev_hash: Column | str) -> Column:
    return F.unhex(F.sha2(F.concat(_col(body), length_prefixed(prev_hash)), 256))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
