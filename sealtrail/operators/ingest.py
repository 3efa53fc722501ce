"""From wire messages to accepted events, duplicates and dead letters."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sealtrail.functions.envelope import decode_envelope
from sealtrail.functions.hashing import hash_format_error, hash_to_bytes, payload_hash, payload_ok
from sealtrail.operators.redact import Policy, redact
from sealtrail.plans.joins import present
from sealtrail.schema import ENVELOPE_FIELDS

# Required members in the order they are reported, retention defaults.
REQUIRED = (
    "id", "ts", "source_service", "actor_id", "action", "target_type", "target_id", "payload_hash",
)
RETENTION_DAYS = 2555
STORAGE_CLASS = "STANDARD"

# Ids of one batch that may be broadcast against the store (about 50 bytes each).
BATCH_IDS = 1_000_000

# Reject kinds, in the order the checks run.
DECODE, PAYLOAD_HASH, REDACTION, HASH_FORMAT = "decode", "payload_hash", "redaction", "payload_hash_format"


def decode(wire: DataFrame, value: str = "value") -> DataFrame:
    """Add the envelope's fields and ``error`` (why the message is no envelope)."""
    df = wire.withColumn("_e", decode_envelope(value))
    return df.select(*[c for c in wire.columns], *[F.col(f"_e.{n}").alias(n) for n in ENVELOPE_FIELDS.names])


def missing_field() -> Column:
    """First required member that is absent or empty, as text; NULL if none is.

    Nothing is trimmed: a blank is a value.
    """
    tests = []
    for name in REQUIRED:
        absent = F.col(name).isNull()
        if name != "ts":
            absent = absent | (F.col(name) == "")
        tests.append(F.when(absent, F.lit(f"event: invalid: missing {name}")))
    return F.coalesce(*tests)


def judge_messages(wire: DataFrame, policy: Policy | None = None, decoded: bool = False) -> DataFrame:
    """Add ``reject_kind`` and ``reject_reason`` (NULL: accepted), ``body`` and ``redacted``.

    Checks run in the order decode, required members, payload hash, redaction, hash
    format; the first that fails names the reason.
    """
    df = wire if decoded else decode(wire)
    has_payload = F.coalesce(F.octet_length("payload") > 0, F.lit(False))
    df = df.withColumn("_decode", F.coalesce("error", missing_field()))
    df = df.withColumn("_mismatch", has_payload & ~payload_ok("payload_hash", "payload"))
    df = redact(df, policy or [], when=F.col("_decode").isNull() & ~F.col("_mismatch"))
    # A payload that passed names its own hash; without one the given text must be a hash.
    df = df.withColumn("_format", F.when(~has_payload, hash_format_error("payload_hash")))
    checks = [
        (DECODE, F.col("_decode").isNotNull(), F.concat(F.lit("decode: "), F.col("_decode"))),
        (PAYLOAD_HASH, F.col("_mismatch"), F.lit("payload_hash mismatch")),
        (REDACTION, F.col("redact_error").isNotNull(), F.concat(F.lit("redaction: "), F.col("redact_error"))),
        (HASH_FORMAT, F.col("_format").isNotNull(), F.concat(F.lit("payload_hash format: event: "), F.col("_format"))),
    ]
    kind = F.coalesce(*[F.when(test, F.lit(name)) for name, test, _ in checks])
    reason = F.coalesce(*[F.when(test, text) for _, test, text in checks])
    return df.select(
        "*", kind.alias("reject_kind"), reason.alias("reject_reason")
    ).drop("_decode", "_mismatch", "_format", "redact_error")


# What an accepted message carries on: no raw value, one copy of the body.
ACCEPTED = (
    "topic", "partition", "offset", "kafka_ts", "id", "ts", "ts_ns", "source_service", "actor_id", "action",
    "target_type", "target_id", "payload_hash", "body", "redacted",
)


def accepted(judged: DataFrame) -> DataFrame:
    """Accepted messages cut to ACCEPTED; ``payload_hash`` becomes the 32 bytes.

    The hash is the original payload's, also for a redacted body, so neither the payload
    nor the raw message has to travel through the duplicate check.
    """
    has_payload = F.coalesce(F.octet_length("payload") > 0, F.lit(False))
    raw_hash = F.when(has_payload, hash_to_bytes(payload_hash("payload"))).otherwise(
        hash_to_bytes("payload_hash")
    )
    kept = judged.where(F.col("reject_kind").isNull()).withColumn("payload_hash", raw_hash)
    return kept.select(*ACCEPTED)


def first_deliveries(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per id: the delivery with the lowest (topic, partition, offset), which names a message.

    Only ids and deliveries are aggregated, so copies of one id shrink to one narrow row per map
    task before the shuffle, however many there are; bodies move once, in the semi-join.  Ids in
    ``known`` (column ``id``) are left out before it.
    """
    delivery = ["topic", "partition", "offset"]
    first = messages.groupBy("id").agg(F.min(F.struct(*delivery)).alias("_first")).select("id", "_first.*")
    if known is not None:
        first = first.join(known, "id", "left_anti")
    same = [messages[c].eqNullSafe(first[c]) for c in ("id", *delivery)]
    return messages.join(first, reduce(lambda a, b: a & b, same), "left_semi")


def dedup(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """New events only: first delivery of each id that is not stored yet."""
    return dedup_known(messages, present(messages, stored, "id", BATCH_IDS))


def dedup_known(messages: DataFrame, known: DataFrame) -> DataFrame:
    """First delivery of each id that is not in ``known`` (column ``id``)."""
    return first_deliveries(messages, known)


def outcomes(judged: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``outcome`` to every message: rejected, duplicate or ingested."""
    delivery = ["id", "topic", "partition", "offset"]
    kept = judged.where(F.col("reject_kind").isNull()).select(*delivery)
    new = first_deliveries(kept) if stored is None else dedup(kept, stored)
    # Joined on the whole delivery, which is unique, so copies of one id spread out.
    joined = judged.join(new.withColumn("_new", F.lit(True)), delivery, "left")
    outcome = (
        F.when(F.col("reject_kind").isNotNull(), "rejected")
        .when(F.col("_new"), "ingested")
        .otherwise("duplicate")
    )
    return joined.withColumn("outcome", outcome).drop("_new")


def as_events(
    messages: DataFrame, ingested_at: datetime | Column | None, legal_hold: bool = False
) -> DataFrame:
    """Accepted messages (see ``accepted``) as event rows, still without chain columns."""
    has_body = F.coalesce(F.octet_length("body") > 0, F.lit(False))
    return messages.select(
        "id",
        "ts",
        "ts_ns",
        "source_service",
        "actor_id",
        "action",
        "target_type",
        "target_id",
        "payload_hash",
        F.when(has_body, F.col("id")).otherwise("").alias("payload_ref"),
        "redacted",
        F.lit(legal_hold).alias("legal_hold_initial"),
        _moment(ingested_at).alias("ingested_at"),
        F.to_date("ts").alias("event_date"),
    )


def as_payloads(
    messages: DataFrame,
    created_at: datetime | Column | None,
    retention_days: int = RETENTION_DAYS,
    storage_class: str = STORAGE_CLASS,
    legal_hold: bool = False,
) -> DataFrame:
    """Bodies to store, keyed by event id."""
    return messages.where(F.octet_length("body") > 0).select(
        F.col("id").alias("payload_ref"),
        "body",
        F.lit("application/json").alias("content_type"),
        F.lit(storage_class).alias("storage_class"),
        F.lit(retention_days).alias("retention_days"),
        F.lit(legal_hold).alias("legal_hold"),
        _moment(created_at).alias("created_at"),
    )


def as_dead_letters(judged: DataFrame, rejected_at: datetime | Column) -> DataFrame:
    """Rejected messages with their raw bytes."""
    return judged.where(F.col("reject_kind").isNotNull()).select(
        "topic",
        "partition",
        "offset",
        F.decode("key", "UTF-8").alias("key"),
        F.col("value").alias("payload"),
        F.col("reject_reason").alias("reason"),
        _moment(rejected_at).alias("rejected_at"),
    )


def _moment(at: datetime | Column | None) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")
