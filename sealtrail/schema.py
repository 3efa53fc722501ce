"""Fixed schemas of the engine's tables.  Sessions run with time zone UTC."""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BINARY": T.BinaryType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
    "DECIMAL": T.DecimalType(38, 0),
}


def flat(columns: str) -> T.StructType:
    """Flat schema from "name TYPE, …"; unlike fromDDL it needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


WIRE = flat(
    "topic STRING, partition INT, offset BIGINT, key BINARY, value BINARY, kafka_ts TIMESTAMP"
)

ENVELOPE_FIELDS = flat(
    "id STRING, ts TIMESTAMP, ts_ns BIGINT, source_service STRING, actor_id STRING,"
    " action STRING, target_type STRING, target_id STRING, payload_hash STRING,"
    " payload BINARY, error STRING"
)

AUDIT_EVENTS = flat(
    "id STRING, ts TIMESTAMP, ts_ns BIGINT, source_service STRING, actor_id STRING,"
    " action STRING, target_type STRING, target_id STRING, payload_hash BINARY,"
    " payload_ref STRING, prev_hash BINARY, this_hash BINARY, redacted BOOLEAN,"
    " legal_hold_initial BOOLEAN, seg STRING, pos BIGINT, ingested_at TIMESTAMP,"
    " event_date DATE"
)

# Accepted events that are not chained yet.
ARRIVALS = flat(
    "id STRING, ts TIMESTAMP, ts_ns BIGINT, source_service STRING, actor_id STRING,"
    " action STRING, target_type STRING, target_id STRING, payload_hash BINARY,"
    " payload_ref STRING, redacted BOOLEAN, legal_hold_initial BOOLEAN, ingested_at TIMESTAMP,"
    " event_date DATE"
)

PAYLOADS = flat(
    "payload_ref STRING, body BINARY, content_type STRING, storage_class STRING,"
    " retention_days INT, legal_hold BOOLEAN, created_at TIMESTAMP"
)

DEAD_LETTER = flat(
    "topic STRING, partition INT, offset BIGINT, key STRING, payload BINARY,"
    " reason STRING, rejected_at TIMESTAMP"
)

HEADS = flat(
    "seg STRING, bucket STRING, last_ts TIMESTAMP, last_ts_ns BIGINT, last_id STRING,"
    " last_hash BINARY, n BIGINT"
)

SEGMENTS = flat(
    "seg STRING, n BIGINT, first_id STRING, first_ts TIMESTAMP, last_id STRING, last_ts TIMESTAMP,"
    " root BINARY, sealed_at TIMESTAMP, prev_segment_hash BINARY, segment_hash BINARY"
)

# Segments found intact: digest over ids and the files they are in, and what a report needs.
VERIFIED = flat(
    "seg STRING, n BIGINT, digest DECIMAL, first_ts TIMESTAMP, last_ts TIMESTAMP, last_id STRING,"
    " last_hash BINARY, verified_at TIMESTAMP"
)

ANCHORS = flat(
    "id STRING, anchored_at TIMESTAMP, root_hash BINARY, last_event_id STRING,"
    " last_event_ts TIMESTAMP, signature BINARY, key_id STRING, event_count BIGINT"
)

# Latencies of a batch's new events by service; see operators/metrics.py.
LATENCY = T.StructType(
    flat("service STRING, n BIGINT, total_us BIGINT").fields
    + [T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("at", T.TimestampType())]
)

# What an ingest batch did, committed with it.
BATCHES = flat(
    "writer STRING, batch BIGINT, at TIMESTAMP, messages BIGINT, rejected BIGINT, duplicates BIGINT, ingested BIGINT"
)

# Progress of a streaming query, one row per batch.
PROGRESS = flat(
    "query STRING, batch BIGINT, at TIMESTAMP, rows_in BIGINT, messages BIGINT, undecodable BIGINT,"
    " watermark TIMESTAMP, lag_ms BIGINT, duration_ms BIGINT, state_rows BIGINT"
)

LEGAL_HOLDS = flat("id STRING, hold BOOLEAN, changed_at TIMESTAMP")

EXPORT_RUNS = flat(
    "id STRING, query STRING, format STRING, retention_days INT, status STRING,"
    " row_count BIGINT, payload_ref STRING, chain_root BINARY, anchor_id STRING,"
    " created_at TIMESTAMP, changed_at TIMESTAMP"
)

RULES = flat(
    "rule_ord INT, service STRING, action STRING, field STRING, transform STRING"
)
