"""Incremental sweeps: only segments that may have changed are hashed again.

A table of verified segments holds a digest of each: the sum of a hash over the id of every row
and the identity (path, size, time of change) of the file it is in.  The sum does not depend on
order, so it comes from a scan of two narrow columns.  A segment is hashed again if it is new, if
its digest differs (a row was added, lost or moved, a file replaced or written to), or if its
turn has come: every sweep also takes the share of segments that its salt's hash chooses, so a
change that leaves a file's identity alone is found within a bounded number of sweeps.

The report is that of a full sweep.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from sealtrail.operators.anchor import Signer
from sealtrail.operators.chain import OK, SEGMENT_MINUTES, verify_chain
from sealtrail.operators.search import EventQuery, search
from sealtrail.operators.sweep import _segment_failure, findings, report_row, REPORT_COLUMNS, _text
from sealtrail.functions.hashing import HASH_PREFIX
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.schema import VERIFIED
from sealtrail.sources.scratch import stored

#: Share of the unchanged segments that a sweep hashes again all the same: one in so many.
EVERY = 24
#: Dates up to which the scan of suspects names its partitions.
MOST_DATES = 1_000


def segment_digests(chained: DataFrame) -> DataFrame:
    """(seg, n, digest, dates) of a table read from files; reads ``seg`` and ``id`` only.

    ``dates`` are those of the partitions a segment is in, none if the table has no ``event_date``.
    """
    row = F.xxhash64("id", "_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time"))
    date = F.col("event_date") if "event_date" in chained.columns else F.lit(None).cast("date")
    return chained.groupBy("seg").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"), F.collect_set(date).alias("dates")
    )


def latest_verified(verified: DataFrame) -> DataFrame:
    """The last verification of each segment."""
    others = [c for c in verified.columns if c != "seg"]
    return verified.groupBy("seg").agg(F.max_by(F.struct(*others), "verified_at").alias("v")).select("seg", "v.*")


def suspects(chained: DataFrame, verified: DataFrame, salt: str, every: int = EVERY) -> DataFrame:
    """(seg, n, digest, dates, again): segments of ``chained``, and whether they must be hashed again."""
    known = latest_verified(verified).select("seg", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest"))
    turn = F.pmod(F.xxhash64("seg", F.lit(salt)), F.lit(every)) == 0
    return segment_digests(chained).join(known, "seg", "left").select(
        "seg", "n", "digest", "dates", (~same | turn).alias("again")
    )


def rows_of(window: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of some segments (seg, dates); other dates' files are not opened."""
    dates = [r[0] for r in segments.select(F.explode("dates")).distinct().limit(MOST_DATES + 1).collect()]
    if 0 < len(dates) <= MOST_DATES:
        window = window.where(F.col("event_date").isin(dates))
    return window.join(broadcast_if_small(segments.select("seg")), "seg", "left_semi")


def sweep_incremental(
    chained: DataFrame,
    verified: DataFrame,
    verified_at: datetime,
    anchors: DataFrame | None = None,
    from_: datetime | None = None,
    to: datetime | None = None,
    signer: Signer | None = None,
    signed_at: datetime | None = None,
    minutes: int = SEGMENT_MINUTES,
    sealed: DataFrame | None = None,
    every: int = EVERY,
) -> tuple[DataFrame, DataFrame]:
    """(report, rows to add to ``verified``): as :func:`sealtrail.operators.sweep.sweep`, hashing little.

    ``chained`` is read from files; ``verified`` has the schema VERIFIED.  Segments cut by the ends
    of the window are always hashed, as is every segment that failed before: only intact ones
    are remembered.  ``verified_at`` also chooses whose turn it is.
    """
    window = search(chained, EventQuery(from_=from_, to=to))
    judged = suspects(chained, verified, verified_at.isoformat(), every)
    known = latest_verified(verified).drop("n", "digest", "verified_at")
    told = stored(judged.join(known, "seg", "left"), "suspects")
    inside = F.lit(True)
    if from_ is not None:
        inside &= F.col("first_ts") >= F.lit(from_)
    if to is not None:
        inside &= F.col("last_ts") < F.lit(to)
    outside = F.lit(False)
    if from_ is not None:
        outside |= F.col("last_ts") < F.lit(from_)
    if to is not None:
        outside |= F.col("first_ts") >= F.lit(to)
    kept = told.where(~F.col("again") & inside)
    hashed = told.where(F.col("again") | ~(inside | outside))
    fresh = verify_chain(rows_of(window, hashed), window_start=from_, minutes=minutes)
    fresh = stored(fresh.groupBy("seg").agg(
        *findings(), F.min("ts").alias("first_ts"), F.max(F.struct("ts", "id", "this_hash")).alias("end")
    ), "fresh")
    first, last = F.struct("first.us", "first.id"), F.struct("end.ts", "end.id")
    new = fresh.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.min_by("first", F.when(F.col("first").isNotNull(), first)).alias("first"),
        F.max(last).alias("key"), F.max_by("end.this_hash", last).alias("last"),
    ).first()
    last = F.struct(F.col("last_ts").alias("ts"), F.col("last_id").alias("id"))
    old = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.max(last).alias("key"), F.max_by("last_hash", last).alias("last")).first()
    ends = max([r for r in (new, old) if r["key"] is not None], key=lambda r: (r["key"]["ts"], r["key"]["id"]), default=None)
    failure, segment_root = new["first"], None
    if sealed is not None:
        failure, segment_root = _segment_failure(window, sealed, from_, to, failure)
    report = report_row(
        chained, window, new["events"] + old["events"], failure, ends["last"] if ends else None, anchors, from_, to, signer, signed_at
    )
    if sealed is not None:
        text = None if failure or segment_root is None else HASH_PREFIX + bytes(segment_root).hex()
        report = report.select(*REPORT_COLUMNS, _text(text).alias("segment_root"))
    # segments that the window cuts have other numbers of rows than they were judged with
    intact = fresh.where(F.col("first").isNull()).join(told.select("seg", "n", "digest"), "seg").where(F.col("events") == F.col("n"))
    remembered = intact.select(
        "seg", "n", "digest", "first_ts", F.col("end.ts").alias("last_ts"), F.col("end.id").alias("last_id"),
        F.col("end.this_hash").alias("last_hash"), F.lit(verified_at).cast("timestamp").alias("verified_at"),
    )
    return report, remembered.select(*VERIFIED.names)
