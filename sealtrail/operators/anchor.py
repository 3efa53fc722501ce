"""Anchors: signed statements that a chain had a given root at a given event."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sealtrail.functions.hashing import canonical_body, event_hash
from sealtrail.operators.chain import SEGMENT_MINUTES, bucket_text, build_segments, segment_chain
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.plans.ordering import time_bucket

# Signs a 32-byte root and names the key.
Signer = Callable[[bytes], tuple[bytes, str]]


def hmac_signer(key: bytes, key_id: str) -> Signer:
    def sign(root: bytes) -> tuple[bytes, str]:
        return hmac.new(key, root, hashlib.sha256).digest(), key_id

    return sign


def signature(root: Column | str, signer: Signer | None, required: bool = True) -> Column:
    """struct<signature, key_id> for the few rows that carry a root.

    A failing signer fails the job if ``required``, else leaves the row unsigned.
    """
    shape = "struct<signature: binary, key_id: string>"
    if signer is None:
        return F.lit(None).cast(shape)

    @F.arrow_udf(shape)
    def sign(roots: pa.Array) -> pa.Array:
        signed: list[tuple[bytes | None, str | None]] = []
        for root in roots.to_pylist():
            try:
                signed.append(signer(root) if root is not None and len(root) == 32 else (None, None))
            except Exception:
                if required:
                    raise
                signed.append((None, None))
        return pa.StructArray.from_arrays(
            [pa.array([s[0] for s in signed], pa.binary()), pa.array([s[1] for s in signed], pa.string())],
            names=["signature", "key_id"],
        )

    return sign(F.col(root) if isinstance(root, str) else root)


def make_anchors(
    chained: DataFrame, minutes: int = SEGMENT_MINUTES, signer: Signer | None = None
) -> DataFrame:
    """One anchor per time window with events: its last event's hash and its event count."""
    key = F.struct("ts", "id")
    windows = chained.groupBy(time_bucket(minutes).alias("_bucket")).agg(
        F.max_by(F.struct("id", "ts", "this_hash"), key).alias("head"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return windows.where(F.octet_length("head.this_hash") == 32).select(
        F.concat(F.lit("anchor-"), bucket_text(minutes, F.col("_bucket"))).alias("id"),
        F.timestamp_micros((F.col("_bucket") + 1) * F.lit(minutes * 60_000_000)).alias("anchored_at"),
        F.col("head.this_hash").alias("root_hash"),
        F.col("head.id").alias("last_event_id"),
        F.col("head.ts").alias("last_event_ts"),
        "event_count",
    ).withColumn("_signed", signature("root_hash", signer)).select(
        "id",
        "anchored_at",
        "root_hash",
        "last_event_id",
        "last_event_ts",
        F.col("_signed.signature").alias("signature"),
        F.col("_signed.key_id").alias("key_id"),
        "event_count",
    )


def anchor_segments(
    sealed: DataFrame, minutes: int = SEGMENT_MINUTES, signer: Signer | None = None
) -> DataFrame:
    """One anchor per time window of sealed segments (schema SEGMENTS), by their first event.

    The root is the hash of the window's last sealed segment, which all segments sealed
    before it go into, so it commits to every event up to there.
    """
    started = sealed.withColumn("ts", F.col("first_ts"))
    windows = started.groupBy(time_bucket(minutes).alias("_bucket")).agg(
        F.max_by(F.struct("segment_hash", "last_id", "last_ts"), F.struct("sealed_at", "seg")).alias("last"),
        F.sum("n").alias("event_count"),
    )
    return windows.select(
        F.concat(F.lit("anchor-"), bucket_text(minutes, F.col("_bucket"))).alias("id"),
        F.timestamp_micros((F.col("_bucket") + 1) * F.lit(minutes * 60_000_000)).alias("anchored_at"),
        F.col("last.segment_hash").alias("root_hash"),
        F.col("last.last_id").alias("last_event_id"),
        F.col("last.last_ts").alias("last_event_ts"),
        signature("last.segment_hash", signer).alias("_signed"),
        "event_count",
    ).select(
        "id", "anchored_at", "root_hash", "last_event_id", "last_event_ts",
        F.col("_signed.signature").alias("signature"), F.col("_signed.key_id").alias("key_id"), "event_count",
    )


def anchor_sealed(sealed: DataFrame, signer: Signer | None = None) -> DataFrame:
    """One anchor per time of sealing (schema SEGMENTS): the hash of the segment sealed last then."""
    order = F.struct("sealed_at", "seg")
    moments = sealed.groupBy("sealed_at").agg(
        F.max_by(F.struct("segment_hash", "last_id", "last_ts"), order).alias("last"), F.sum("n").alias("event_count")
    )
    return moments.withColumn("_signed", signature("last.segment_hash", signer)).select(
        F.concat(F.lit("anchor-"), F.date_format("sealed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("id"),
        F.col("sealed_at").alias("anchored_at"),
        F.col("last.segment_hash").alias("root_hash"),
        F.col("last.last_id").alias("last_event_id"),
        F.col("last.last_ts").alias("last_event_ts"),
        F.col("_signed.signature").alias("signature"),
        F.col("_signed.key_id").alias("key_id"),
        "event_count",
    )


def check_segment_anchors(anchors: DataFrame, chained: DataFrame, sealed: DataFrame) -> DataFrame:
    """Add ``mismatch``: the anchored root does not follow from the events any more.

    The chain over segments is made again from the events, in the order of sealing, so a
    lost, forged or resized segment changes every root from there on.
    """
    order = sealed.select("seg", "sealed_at")
    again = segment_chain(build_segments(chained).join(order, "seg", "left"), ("sealed_at", "seg"))
    roots = again.select(F.col("segment_hash").alias("_root")).distinct()
    return anchors.join(roots, F.col("root_hash") == F.col("_root"), "left").select(
        *anchors.columns, F.col("_root").isNull().alias("mismatch")
    )


# Tells whether a signature of a root holds under the named key.
Verifier = Callable[[bytes, bytes, str], bool]


def hmac_verifier(keys: dict[str, bytes]) -> Verifier:
    def verify(root: bytes, sig: bytes, key_id: str) -> bool:
        key = keys.get(key_id)
        return key is not None and hmac.compare_digest(hmac.new(key, root, hashlib.sha256).digest(), sig)

    return verify


def check_signatures(anchors: DataFrame, verifier: Verifier) -> DataFrame:
    """Add ``signature_ok``; NULL for unsigned anchors.  A failing verifier fails the job."""

    @F.arrow_udf("boolean")
    def holds(roots: pa.Array, sigs: pa.Array, keys: pa.Array) -> pa.Array:
        rows = zip(roots.to_pylist(), sigs.to_pylist(), keys.to_pylist())
        return pa.array([None if sig is None else bool(root and verifier(root, sig, key)) for root, sig, key in rows], pa.bool_())

    return anchors.withColumn("signature_ok", holds("root_hash", "signature", "key_id"))


def anchors_between(
    anchors: DataFrame, from_: datetime | None = None, to: datetime | None = None
) -> DataFrame:
    """Anchors with ``anchored_at`` in [from_, to]; both ends belong to it."""
    if from_ is not None:
        anchors = anchors.where(F.col("anchored_at") >= F.lit(from_))
    if to is not None:
        anchors = anchors.where(F.col("anchored_at") <= F.lit(to))
    return anchors


def check_anchors(anchors: DataFrame, chained: DataFrame) -> DataFrame:
    """Add ``mismatch``, and ``recomputed_ok`` for the anchored event's own hash.

    An anchor mismatches if its last event is gone or has another ``this_hash``.
    """
    wanted = broadcast_if_small(anchors.select(F.col("last_event_id").alias("id")).distinct())
    # Cut the events down to the anchored ones first: an outer join cannot broadcast
    # the side it preserves.
    heads = chained.join(wanted, "id", "left_semi").select(
        F.col("id").alias("last_event_id"),
        F.col("this_hash").alias("head_hash"),
        event_hash(canonical_body(), F.col("prev_hash")).alias("head_computed"),
    )
    joined = anchors.join(heads, "last_event_id", "left")
    differs = (F.octet_length("root_hash") == 32) & (F.col("root_hash") != F.col("head_hash"))
    return joined.select(
        *[F.col(c) for c in anchors.columns],
        F.coalesce(F.col("head_hash").isNull() | differs, F.lit(False)).alias("mismatch"),
        F.coalesce(F.col("head_computed") == F.col("root_hash"), F.lit(False)).alias("recomputed_ok"),
    )


def high_water(anchors: DataFrame) -> DataFrame:
    """One row: the furthest anchored (ts, id); NULL without anchors."""
    usable = anchors.where((F.col("last_event_id") != "") & F.col("last_event_ts").isNotNull())
    return usable.agg(
        F.max(F.struct(F.col("last_event_ts").alias("ts"), F.col("last_event_id").alias("id"))).alias("_high")
    )


def with_anchored(chained: DataFrame, anchors: DataFrame) -> DataFrame:
    """Add ``anchored``: the event is at or before the furthest anchored one."""
    reached = F.struct(F.col("ts"), F.col("id")) <= F.col("_high")
    # high_water() always has exactly one row.
    return (
        chained.join(F.broadcast(high_water(anchors)), F.lit(True), "left")
        .withColumn("anchored", F.coalesce(reached, F.lit(False)))
        .drop("_high")
    )


def newly_anchored(chained: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: events covered by the anchors ``after`` but not ``before``."""
    marked = with_anchored(with_anchored(chained, before).withColumnRenamed("anchored", "_before"), after)
    return marked.agg(F.count_if(F.col("anchored") & ~F.col("_before")).alias("newly_anchored"))
