"""Integrity sweep: one report row for a time window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sealtrail.functions.hashing import HASH_PREFIX
from sealtrail.operators.anchor import Signer, anchors_between, check_anchors
from sealtrail.operators.chain import BROKEN, GAP, OK, SEGMENT_MINUTES, check_sealed, verify_chain
from sealtrail.operators.search import EventQuery, search


def sweep(
    chained: DataFrame,
    anchors: DataFrame | None = None,
    from_: datetime | None = None,
    to: datetime | None = None,
    mode: str = "segmented",
    signer: Signer | None = None,
    signed_at: datetime | None = None,
    minutes: int = SEGMENT_MINUTES,
    sealed: DataFrame | None = None,
) -> DataFrame:
    """Verify all events in [from_, to) and the anchors in [from_, to]; one row.

    With ``sealed`` (schema SEGMENTS) the segments sealed within the window must be there,
    whole, unchanged and linked; a lost one is a gap, another change breaks the chain.  The
    report then ends with ``segment_root``, the last segment's hash.

    Verification runs here, in one pass that ends in one row.  Only when it found a
    failure does a second, narrow pass count the rows up to it, with the failure's
    timestamp pushed into the scan.
    """
    window = search(chained, EventQuery(from_=from_, to=to))
    verified = verify_chain(window, mode=mode, window_start=from_, minutes=minutes)
    found = verified.agg(*findings()).first()
    failure, segment_root = found["first"], None
    if sealed is not None:
        failure, segment_root = _segment_failure(window, sealed, from_, to, failure)
    report = report_row(
        chained, window, found["events"], failure, found["last"], anchors, from_, to, signer, signed_at
    )
    if sealed is None:
        return report
    text = None if failure or segment_root is None else HASH_PREFIX + bytes(segment_root).hex()
    return report.select(*REPORT_COLUMNS, _text(text).alias("segment_root"))


def findings() -> list[Column]:
    """Aggregates of verified events: how many, the first failure, the last hash."""
    key = F.struct("ts", "id")
    return [
        F.count(F.lit(1)).alias("events"),
        F.min_by(
            F.struct(F.unix_micros("ts").alias("us"), "id", "status", "reason"),
            F.when(F.col("status") != OK, key),
        ).alias("first"),
        F.max_by("this_hash", key).alias("last"),
    ]


def report_row(
    chained: DataFrame, window: DataFrame, events: int, failure, last: bytes | None, anchors: DataFrame | None,
    from_: datetime | None, to: datetime | None, signer: Signer | None = None, signed_at: datetime | None = None,
) -> DataFrame:
    """The report from what verification found; anchors are checked and signatures made here."""
    root = None if failure else bytes(last or bytes(32))
    sig, key_id = None, None
    if signer is not None and root is not None:
        try:
            sig, key_id = signer(root)
        except Exception:  # an unsigned report is still a report
            sig, key_id = None, None
    if anchors is None:
        zero = F.lit(0).cast("bigint")
        counts = chained.sparkSession.range(1).select(zero.alias("n"), zero.alias("wrong"))
    else:
        counts = check_anchors(anchors_between(anchors, from_, to), chained).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("mismatch").alias("wrong")
        )
    report = counts.select(
        F.lit(from_).cast("timestamp").alias("from"),
        F.lit(to).cast("timestamp").alias("to"),
        F.lit(events).cast("bigint").alias("event_count"),
        F.lit(failure["status"] if failure else OK).alias("status"),
        _text(failure["id"] if failure else None).alias("first_broken_id"),
        _text(failure["reason"] if failure else None).alias("reason"),
        _text(None if root is None else HASH_PREFIX + root.hex()).alias("root_hash"),
        F.col("n").alias("anchor_count"),
        F.col("n").alias("anchors_checked"),
        F.col("wrong").alias("anchor_mismatches"),
        _text(None if sig is None else "sig:" + sig.hex()).alias("signature"),
        F.lit(signed_at if sig is not None else None).cast("timestamp").alias("signed_at"),
        _text(key_id).alias("key_id"),
    )
    if failure:
        position = _rows_up_to(window, failure["us"], failure["id"])
        report = report.join(F.broadcast(position), F.lit(True))  # one row each
    else:
        report = report.withColumn("position", F.lit(None).cast("bigint"))
    return report.select(*REPORT_COLUMNS)


def _segment_failure(window: DataFrame, sealed: DataFrame, from_, to, failure):
    """The earlier of ``failure`` and the first faulty segment, and the last segment's hash."""
    inside = sealed
    if from_ is not None:
        inside = inside.where(F.col("first_ts") >= F.lit(from_))
    if to is not None:
        inside = inside.where(F.col("last_ts") < F.lit(to))
    key = F.struct("first_ts", "first_id")
    # links are looked up among all sealed segments, events only within the window
    checked = check_sealed(window, sealed).join(inside.select("seg"), "seg", "left_semi")
    facts = checked.agg(
        F.min_by(
            F.struct(F.unix_micros("first_ts").alias("us"), F.col("first_id").alias("id"), "status"),
            F.when(F.col("status") != OK, key),
        ).alias("first"),
        F.max_by("segment_hash", F.struct("sealed_at", "seg")).alias("root"),
    ).first()
    first = facts["first"]
    if first and (not failure or (first["us"], first["id"]) < (failure["us"], failure["id"])):
        status = GAP if first["status"] in ("missing", "unlinked") else BROKEN
        failure = {"us": first["us"], "id": first["id"], "status": status, "reason": f"sealed segment {first['status']}"}
    return failure, facts["root"]


# Report columns in order.
REPORT_COLUMNS = (
    "from", "to", "event_count", "status", "first_broken_id", "position", "reason", "root_hash",
    "anchor_count", "anchors_checked", "anchor_mismatches", "signature", "signed_at", "key_id",
)


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _rows_up_to(window: DataFrame, us: int, id_: str) -> DataFrame:
    moment = F.timestamp_micros(F.lit(us))
    up_to = window.where(
        (F.col("ts") <= moment) & ((F.col("ts") < moment) | (F.col("id") <= F.lit(id_)))
    )
    return up_to.agg(F.count(F.lit(1)).alias("position"))


def report_text(report: DataFrame) -> DataFrame:
    """The report row as one JSON text column, absent members left out."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))
