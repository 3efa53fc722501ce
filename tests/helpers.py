"""Models in plain Python to compare with, and small event frames."""

import hashlib
import struct
from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

BASE = datetime(2026, 7, 13, 10, 0, 0, tzinfo=timezone.utc)
ZERO = bytes(32)

EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id",)]
    + [T.StructField("ts", T.TimestampType()), T.StructField("ts_ns", T.LongType())]
    + [
        T.StructField(n, T.StringType())
        for n in ("source_service", "actor_id", "action", "target_type", "target_id")
    ]
    + [
        T.StructField("payload_hash", T.BinaryType()),
        T.StructField("payload_ref", T.StringType()),
        T.StructField("redacted", T.BooleanType()),
    ]
)


def nanos(ts):
    return int((ts - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) * 1000


def event(id_, ts, service="desk", actor="clerk", action="signed", target=("form", "12"), payload=b"body-digest"):
    return (id_, ts, nanos(ts), service, actor, action, *target, payload, f"store/{id_}", False)


def events(spark, n, step=timedelta(seconds=1), prefix="e", **fields):
    rows = [event(f"{prefix}{i:04d}", BASE + i * step, **fields) for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def body(row):
    def text(value):
        data = value if isinstance(value, (bytes, bytearray)) else value.encode()
        return struct.pack(">I", len(data)) + bytes(data)

    out = text(row["id"]) + struct.pack(">q", row["ts_ns"])
    for name in ("source_service", "actor_id", "action", "target_type", "target_id", "payload_hash"):
        out += text(row[name])
    return out


def digest(row, prev):
    return hashlib.sha256(body(row) + struct.pack(">I", len(prev)) + prev).digest()


def linear_chain(rows):
    """{id: (prev, this)} of one chain over all rows."""
    links, head = {}, ZERO
    for row in sorted(rows, key=lambda r: (r["ts"], r["id"].encode())):
        this = digest(row, head)
        links[row["id"]] = (head, this)
        head = this
    return links


def flat_merkle(leaves):
    level = list(leaves)
    if not level:
        return ZERO
    while len(level) > 1:
        paired = [
            hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
        level = paired
    return level[0]
