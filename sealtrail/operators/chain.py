"""Building and verifying SHA-256 hash chains.

A chain is sequential, so one chain over all events could only be built by one task.
Events are linked inside *segments* instead: one per time bucket, more where a bucket
has more than ``max_rows`` events.  A second, short chain over the finished segments
(``segment_chain``) makes the loss of whole segments visible.  While all events fit
one segment the result is the plain linear chain.

Verification recomputes each hash from stored columns and needs only the previous
row's stored hash, so it is parallel for both kinds of chain and has no Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sealtrail.functions.hashing import (
    big_endian,
    canonical_body,
    event_hash,
    length_prefixed,
    zero_hash,
)
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.plans.ordering import MAX_ROWS, time_bucket, with_blocks, with_previous
from sealtrail.schema import SEGMENTS

SEGMENT_MINUTES = 60
SEGMENT_DIGITS = 6
LATE = "late-"

_HASH_BYTES = 32
_ZERO = bytes(_HASH_BYTES)
_HASH_LENGTH = _HASH_BYTES.to_bytes(4, "big")

# Statuses and reasons of a verification.
OK, BROKEN, GAP = "ok", "broken", "gap"
REASONS = {
    BROKEN: "stored this_hash does not match recomputed hash",
    GAP: "prev_hash linkage broken",
}


# --- build ---


def bucket_text(minutes: int = SEGMENT_MINUTES, bucket: Column | None = None) -> Column:
    """Start of the time bucket, as sortable text."""
    number = time_bucket(minutes) if bucket is None else bucket
    start = F.timestamp_micros(number * F.lit(minutes * 60_000_000))
    return F.date_format(start, "yyyy-MM-dd'T'HH:mm")


def segment_name(bucket: Column, number: Column) -> Column:
    digits = number.cast("string")
    fits = F.when(F.length(digits) <= SEGMENT_DIGITS, F.lpad(digits, SEGMENT_DIGITS, "0")).otherwise(
        F.raise_error(F.concat(F.lit("too many segments in bucket "), bucket))
    )
    return F.concat(bucket, F.lit("/"), fits)


def build_chain(
    events: DataFrame,
    minutes: int = SEGMENT_MINUTES,
    max_rows: int = MAX_ROWS,
    heads: DataFrame | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Add ``seg``, ``pos``, ``prev_hash`` and ``this_hash``.

    ``heads`` (schema HEADS) continues stored segments: events after a bucket's head
    extend its last segment while that stays within ``max_rows``, else open the next
    one.  Events at or before the head are *late*; they form segments of their own,
    named after ``batch``, and leave sealed links alone.
    """
    if heads is not None and not batch:
        raise ValueError("continuing a store needs a batch name of its own, or late segments would merge")
    if heads is None:
        placed = _place(events, minutes, max_rows)
    else:
        placed = _place_after_heads(events, minutes, max_rows, heads, batch)
    return _fold(placed)


def _place(
    events: DataFrame, minutes: int, max_rows: int, prefix: str = "", rows: int | None = None
) -> DataFrame:
    bucket = F.concat(F.lit(prefix), bucket_text(minutes, F.col("_bucket")))
    return (
        with_blocks(events, minutes, max_rows, rows=rows)
        .withColumn("seg", segment_name(bucket, F.col("_sub")))
        .drop("_bucket", "_sub")
    )


def _place_after_heads(
    events: DataFrame, minutes: int, max_rows: int, heads: DataFrame, batch: str
) -> DataFrame:
    rows = events.count()
    touched = broadcast_if_small(events.select(bucket_text(minutes).alias("bucket")).distinct())
    last = (
        heads.where(~F.col("seg").startswith(LATE))
        .join(touched, "bucket", "left_semi")
        .groupBy("bucket")
        .agg(F.max_by(F.struct("seg", "last_ts", "last_id", "last_hash", "n"), F.struct("seg", "n")).alias("h"))
    )
    last = broadcast_if_small(last)
    joined = events.withColumn("bucket", bucket_text(minutes)).join(last, "bucket", "left")
    late = F.coalesce(
        (F.col("ts") < F.col("h.last_ts"))
        | ((F.col("ts") == F.col("h.last_ts")) & (F.col("id") <= F.col("h.last_id"))),
        F.lit(False),
    )
    late_rows = (
        _place(joined.where(late).drop("bucket", "h"), minutes, max_rows, f"{LATE}{batch}/", rows)
        .withColumn("_start_hash", F.lit(None).cast("binary"))
        .withColumn("_start_pos", F.lit(0).cast("bigint"))
    )
    on_time = with_blocks(joined.where(~late), minutes, max_rows, rows=rows)
    arriving = broadcast_if_small(
        on_time.groupBy("bucket").agg(F.count(F.lit(1)).alias("_arriving"))
    )
    extends = (F.col("h.n") + F.col("_arriving")) <= max_rows
    head_number = F.substring_index(F.col("h.seg"), "/", -1).cast("int")
    base = F.when(F.col("h").isNull(), 0).when(extends, head_number).otherwise(head_number + 1)
    on_time = (
        on_time.join(arriving, "bucket")
        .withColumn("seg", segment_name(F.col("bucket"), base + F.col("_sub")))
        .withColumn("_start_hash", F.when(extends, F.col("h.last_hash")))
        .withColumn("_start_pos", F.when(extends, F.col("h.n")).otherwise(0).cast("bigint"))
        .drop("bucket", "h", "_arriving", "_bucket", "_sub")
    )
    return on_time.unionByName(late_rows)


def _fold(placed: DataFrame) -> DataFrame:
    """One shuffle on ``seg``; each segment streams through a constant-memory fold."""
    # The encoded body is made after the shuffle, so it is not shuffled beside its fields.
    ready = (
        placed.repartition("seg")
        .sortWithinPartitions("seg", "ts", "id")
        .withColumn("_body", canonical_body())
    )
    kept = [f for f in ready.schema.fields if f.name not in ("_body", "_start_hash", "_start_pos")]
    out = T.StructType(
        kept
        + [
            T.StructField("pos", T.LongType()),
            T.StructField("prev_hash", T.BinaryType()),
            T.StructField("this_hash", T.BinaryType()),
        ]
    )
    names = [f.name for f in kept]
    continued = "_start_hash" in placed.columns

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, head, position = None, _ZERO, 0
        for batch in batches:
            before, after, positions = [], [], []
            segs, bodies = batch.column("seg").to_pylist(), batch.column("_body").to_pylist()
            for i, (seg, body) in enumerate(zip(segs, bodies)):
                if seg != segment:
                    segment, head, position = seg, _ZERO, 0
                    if continued:
                        head = batch.column("_start_hash")[i].as_py() or _ZERO
                        position = batch.column("_start_pos")[i].as_py()
                before.append(head)
                head = hashlib.sha256(body + _HASH_LENGTH + head).digest()
                after.append(head)
                position += 1
                positions.append(position)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [
                    pa.array(positions, pa.int64()),
                    pa.array(before, pa.binary()),
                    pa.array(after, pa.binary()),
                ],
                names=names + ["pos", "prev_hash", "this_hash"],
            )

    return ready.mapInArrow(link, out)


# --- heads and segments ---


def chain_heads(chained: DataFrame, by: str | None = "seg") -> DataFrame:
    """The last event by (ts, id), per segment or (``by=None``) overall."""
    grouped = chained.groupBy(by) if by else chained.groupBy()
    fields = [c for c in ("id", "ts", "ts_ns", "this_hash", "pos", "seg") if c in chained.columns and c != by]
    head = grouped.agg(F.max_by(F.struct(*fields), F.struct("ts", "id")).alias("h"))
    return head.select(*([by] if by else []), "h.*").where(F.col("id").isNotNull())


def segment_heads(chained: DataFrame, minutes: int = SEGMENT_MINUTES) -> DataFrame:
    """Heads in the form ``build_chain(heads=…)`` takes (schema HEADS)."""
    return chain_heads(chained).select(
        "seg",
        bucket_text(minutes).alias("bucket"),
        F.col("ts").alias("last_ts"),
        F.col("ts_ns").alias("last_ts_ns"),
        F.col("id").alias("last_id"),
        F.col("this_hash").alias("last_hash"),
        F.col("pos").alias("n"),
    )


def latest_heads(heads: DataFrame) -> DataFrame:
    """The heads that batches to come continue from: the last of each bucket, no late ones."""
    others = [c for c in heads.columns if c != "bucket"]
    on_time = heads.where(~F.col("seg").startswith(LATE))
    last = on_time.groupBy("bucket").agg(F.max_by(F.struct(*others), F.struct("seg", "n")).alias("h"))
    return last.select("bucket", "h.*").select(*heads.columns)


def build_segments(chained: DataFrame) -> DataFrame:
    """One row per segment: size, borders and root."""
    key = F.struct("ts", "id")
    return (
        chained.groupBy("seg")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(key).alias("first"),
            F.max(key).alias("last"),
            F.max_by("this_hash", key).alias("root"),
        )
        .select(
            "seg",
            "n",
            F.col("first.id").alias("first_id"),
            F.col("first.ts").alias("first_ts"),
            F.col("last.id").alias("last_id"),
            F.col("last.ts").alias("last_ts"),
            "root",
        )
    )


def segment_chain(
    segments: DataFrame, order: tuple[str, ...] = ("seg",), start: bytes = _ZERO
) -> DataFrame:
    """Link segments: SHA-256 over name, size, root and the previous segment's hash.

    The input has one row per segment, so it is smaller than the events by the segment
    size; this short chain is the one place where order forces a single task.
    ``order`` may be ("sealed_at", "seg") for stores that seal late segments later;
    ``start`` is the last stored segment hash a further part continues from.
    """
    ready = segments.withColumn("_body", _segment_body())
    kept = [f for f in ready.schema.fields if f.name != "_body"]
    names = [f.name for f in kept]
    added = ["prev_segment_hash", "segment_hash"]
    out = T.StructType(kept + [T.StructField(n, T.BinaryType()) for n in added])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = start
        for batch in batches:
            hashes = [head]
            for body in batch.column("_body").to_pylist():
                head = hashlib.sha256(body + _HASH_LENGTH + head).digest()
                hashes.append(head)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(hashes[:-1], pa.binary()), pa.array(hashes[1:], pa.binary())],
                names=names + added,
            )

    return ready.repartition(1).sortWithinPartitions(*order).mapInArrow(link, out)


def _segment_body() -> Column:
    return F.concat(length_prefixed("seg"), big_endian("n"), length_prefixed("root"))


def seal_segments(chained: DataFrame, sealed_at: datetime, sealed: DataFrame | None = None) -> DataFrame:
    """Rows (schema SEGMENTS) to append: segments of ``chained`` that ``sealed`` lacks, linked.

    Hand in events of finished segments only; a sealed segment must not grow.  Segments
    sealed together are linked in the order of their names, behind all sealed before.
    """
    new, start = build_segments(chained).withColumn("sealed_at", F.lit(sealed_at).cast("timestamp")), _ZERO
    if sealed is not None:
        new = new.join(sealed.select("seg"), "seg", "left_anti")
        head = sealed.agg(F.max_by("segment_hash", F.struct("sealed_at", "seg"))).first()[0]
        start = bytes(head) if head is not None else _ZERO
    return segment_chain(new, ("sealed_at", "seg"), start).select(*SEGMENTS.names)


def check_sealed(chained: DataFrame, sealed: DataFrame) -> DataFrame:
    """Sealed segments with ``status``: ok, missing, resized, changed, relinked or unlinked.

    The first three compare with the events.  A segment is *relinked* if its own hash does
    not follow from its row, *unlinked* if no sealed segment has the hash it continues, so
    a row taken out of the table shows at its successor.  Links are found by hash, without
    ordering all segments in one task.
    """
    now = build_segments(chained).select("seg", F.col("n").alias("n_now"), F.col("root").alias("root_now"))
    hashes = sealed.select(F.col("segment_hash").alias("_known")).distinct()
    linked = sealed.join(hashes, F.col("prev_segment_hash") == F.col("_known"), "left")
    follows = F.col("_known").isNotNull() | (F.col("prev_segment_hash") == zero_hash())
    own = event_hash(_segment_body(), F.col("prev_segment_hash")).eqNullSafe(F.col("segment_hash"))
    status = (
        F.when(F.col("n_now").isNull(), "missing")
        .when(F.col("n") != F.col("n_now"), "resized")
        .when(~F.col("root").eqNullSafe(F.col("root_now")), "changed")
        .when(~own, "relinked")
        .when(~follows, "unlinked")
        .otherwise(OK)
    )
    return linked.join(now, "seg", "left").select(*sealed.columns, status.alias("status"))


def check_segments(chained: DataFrame, sealed: DataFrame) -> DataFrame:
    """Sealed segments that are missing, resized or carry another root."""
    now = build_segments(chained).select("seg", F.col("n").alias("n_now"), F.col("root").alias("root_now"))
    joined = sealed.join(now, "seg", "full_outer")
    status = (
        F.when(F.col("root").isNull(), "unsealed")
        .when(F.col("root_now").isNull(), "missing")
        .when(F.col("n") != F.col("n_now"), "resized")
        .when(F.col("root") != F.col("root_now"), "changed")
        .otherwise(OK)
    )
    return joined.select("seg", "n", "n_now", status.alias("status"))


# --- verify ---


def verify_chain(
    chained: DataFrame,
    mode: str = "segmented",
    window_start: datetime | None = None,
    minutes: int = SEGMENT_MINUTES,
    genesis: str | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add ``computed``, ``expected_prev``, ``status`` and ``reason`` to every event.

    mode="segmented"  links inside the stored segments; each starts at the zero hash.
        With ``window_start`` the input begins there, and a segment whose bucket began
        earlier is exempt from the check on its first row, unless that is the segment's own.
    mode="linear"     one chain over all rows; its first row is exempt unless
        ``genesis="zero"``.
    """
    # Rehash before the shuffle: unless the caller wants more, only the order, the links and
    # one flag then travel, not the hashed fields.
    hashed = rehash(chained)
    if mode == "segmented":
        order = W.partitionBy("seg").orderBy("ts", "id")
        df = hashed.withColumn("expected_prev", F.lag("this_hash").over(order))
        cut = F.lit(False)
        if window_start is not None:
            bucket_start = F.timestamp_micros(time_bucket(minutes) * F.lit(minutes * 60_000_000))
            cut = (bucket_start < F.lit(window_start)) & (F.col("pos") > 1)
        df = df.withColumn(
            "expected_prev",
            F.when(F.col("expected_prev").isNull() & ~cut, zero_hash()).otherwise(F.col("expected_prev")),
        )
    elif mode == "linear":
        df = with_previous(hashed, "this_hash", "expected_prev", minutes=minutes, max_rows=max_rows)
        if genesis == "zero":
            df = df.withColumn("expected_prev", F.coalesce("expected_prev", zero_hash()))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return judge(df)


def rehash(df: DataFrame) -> DataFrame:
    """Add ``computed``, the hash of the row's stored fields, and ``_broken``."""
    df = df.withColumn("computed", event_hash(canonical_body(), F.col("prev_hash")))
    return df.withColumn("_broken", ~F.col("computed").eqNullSafe(F.col("this_hash")))


def judge(df: DataFrame) -> DataFrame:
    """Status of each rehashed event against ``expected_prev`` (NULL: no link to check)."""
    unlinked = F.col("expected_prev").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("expected_prev"))
    status = F.when(F.col("_broken"), BROKEN).when(unlinked, GAP).otherwise(OK)
    df = df.withColumn("status", status).drop("_broken")
    reason = F.lit(None).cast("string")
    for name, text in REASONS.items():
        reason = F.when(F.col("status") == name, text).otherwise(reason)
    return df.withColumn("reason", reason)


def verify_events(chained: DataFrame, ids: DataFrame, **options) -> DataFrame:
    """Verify the listed events (column ``id``) against their true predecessors.

    Only what holds them is read into the window: their segments, or in linear mode their time
    buckets and the last bucket with events before each of those, where a predecessor may be.
    """
    wanted = broadcast_if_small(ids.select("id").distinct())
    asked = chained.join(wanted, "id", "left_semi")
    if options.get("mode") == "linear":
        minutes = options.get("minutes", SEGMENT_MINUTES)
        near = _with_halo(chained, asked, minutes)
    else:
        dates = [F.col("event_date")] if "event_date" in chained.columns else []
        segments = broadcast_if_small(asked.select("seg", *dates).distinct())
        near = _on_dates(chained, segments).join(segments.select("seg").distinct(), "seg", "left_semi")
    return verify_chain(near, **options).join(wanted, "id", "left_semi")


#: Dates up to which a scan names its partitions.
MOST_DATES = 1_000


def _on_dates(events: DataFrame, dated: DataFrame) -> DataFrame:
    """``events`` without the partitions that ``dated`` (``event_date``) does not name, if they are few."""
    if "event_date" not in events.columns or "event_date" not in dated.columns:
        return events
    dates = [r[0] for r in dated.select("event_date").distinct().limit(MOST_DATES + 1).collect()]
    return events.where(F.col("event_date").isin(dates)) if 0 < len(dates) <= MOST_DATES else events


def _with_halo(chained: DataFrame, asked: DataFrame, minutes: int) -> DataFrame:
    """The rows of the asked events' time buckets and of the last non-empty bucket before each.

    The buckets come from a scan of ``ts``; there is one row per bucket, so their order is cheap.
    """
    dates = [F.collect_set("event_date").alias("dates")] if "event_date" in chained.columns else []
    buckets = chained.groupBy(time_bucket(minutes).alias("_b")).agg(F.count(F.lit(1)).alias("n"), *dates)
    buckets = buckets.withColumn("_before", F.lag("_b").over(W.orderBy("_b")))
    own = broadcast_if_small(asked.select(time_bucket(minutes).alias("_b")).distinct())
    needed = buckets.join(own, "_b", "left_semi").select(F.explode(F.array("_b", "_before")).alias("_b")).distinct()
    needed = broadcast_if_small(buckets.join(needed, "_b", "left_semi").drop("n", "_before"))
    if dates:
        chained = _on_dates(chained, needed.select(F.explode("dates").alias("event_date")))
    return chained.withColumn("_b", time_bucket(minutes)).join(needed.select("_b"), "_b", "left_semi").drop("_b")


def first_failure(verified: DataFrame) -> DataFrame:
    """The first failing event in (ts, id) order; one row, NULLs if there is none."""
    bad = F.col("status") != OK
    first = F.min_by(F.struct("ts", "id", "status", "reason"), F.when(bad, F.struct("ts", "id")))
    return verified.agg(first.alias("f")).select("f.*")


def chain_root(verified: DataFrame) -> DataFrame:
    """Last ``this_hash``; the zero hash if there are no events, NULL if any check failed."""
    return verified.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("status") != OK).alias("failures"),
        F.max_by("this_hash", F.struct("ts", "id")).alias("last"),
    ).select(
        "event_count",
        F.when(F.col("failures") == 0, F.coalesce("last", zero_hash())).alias("root"),
    )
