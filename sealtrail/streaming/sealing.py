"""Chaining and sealing of accepted events as the watermark passes them.

State is kept per segment: the head of what is linked so far, and the events that are not yet
older than the watermark.  Events below the watermark are linked in (ts, id) order, so those that
arrive in any order within the allowed delay end up in one segment, as if they had come sorted.
When the watermark passes the end of a segment's hour a timer links the rest, emits the
segment's row and drops its state.  Events that arrive later form segments of their own.

Each micro-batch commits its chained events and sealed segments together; the segments continue
the stored chain over segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sealtrail.functions.hashing import canonical_body
from sealtrail.operators.chain import LATE, SEGMENT_MINUTES, bucket_text, segment_chain, segment_name
from sealtrail.plans.ordering import time_bucket
from sealtrail.schema import ARRIVALS, SEGMENTS, flat
from sealtrail.sources.tables import Store
from sealtrail.streaming.committed import read_committed
from sealtrail.streaming.ingest import query_name

_ZERO = bytes(32)
_HASH_LENGTH = (32).to_bytes(4, "big")
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

#: A linked event (``event`` is its row as JSON) or, where ``n`` is set, a sealed segment.
LINKED = flat(
    "seg STRING, pos BIGINT, prev_hash BINARY, this_hash BINARY, event STRING, n BIGINT,"
    " first_us BIGINT, first_id STRING, last_us BIGINT, last_id STRING"
)
_EVENT = flat("us BIGINT, id STRING, body BINARY, event STRING")
_HEAD = flat("n BIGINT, first_us BIGINT, first_id STRING, last_us BIGINT, last_id STRING, last_hash BINARY")


class Linker(StatefulProcessor):
    """Links the events of a segment; see the module."""

    def __init__(self, width_us: int):
        self.width_us = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.pending = handle.getListState("pending", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seg = key[0]
        new = [r for batch in rows for r in zip(batch["us"].tolist(), batch["id"], batch["body"], batch["event"])]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        end = (new[0][0] // self.width_us + 1) * self.width_us
        head = self.head.get() if self.head.exists() else None
        waiting = list(self.pending.get()) if self.pending.exists() else []
        if head is None and not waiting and end < passed:
            late, new = new, []  # sealed before, or all of it comes too late
        else:
            reached = (head[3], head[4]) if head else None
            late = [r for r in new if reached and r[:2] <= reached]
            new = [r for r in new if not reached or r[:2] > reached]
        if late:
            name = f"{LATE}{hashlib.sha256(min(late)[1].encode()).hexdigest()[:12]}/{seg}"
            linked, head_of_late = self._linked(name, None, late)
            yield linked
            yield self._sealed(name, head_of_late)
        if new:
            if head is None and not waiting:
                self.handle.registerTimer(end // 1000)
            rest = sorted([*map(tuple, waiting), *new])
            ready = [r for r in rest if r[0] < passed]
            if ready:
                linked, head = self._linked(seg, head, ready)
                self.head.update(head)
                yield linked
            self.pending.clear()
            if len(ready) < len(rest):
                self.pending.put(rest[len(ready):])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seg = key[0]
        head = self.head.get() if self.head.exists() else None
        waiting = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        if waiting:
            linked, head = self._linked(seg, head, waiting)
            yield linked
        if head:
            yield self._sealed(seg, head)
        self.head.clear()
        self.pending.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _linked(seg: str, head: tuple | None, events: list[tuple]) -> tuple[pd.DataFrame, tuple]:
        events = sorted((us, id_, bytes(body), event) for us, id_, body, event in events)
        n, last = (head[0], bytes(head[5])) if head else (0, _ZERO)
        hashes = [last]
        for _, _, body, _ in events:
            hashes.append(hashlib.sha256(body + _HASH_LENGTH + hashes[-1]).digest())
        first = head[1:3] if head else events[0][:2]
        return _links(seg, n + 1, hashes, [e[3] for e in events]), (n + len(events), *first, *events[-1][:2], hashes[-1])

    @staticmethod
    def _sealed(seg: str, head: tuple) -> pd.DataFrame:
        return _frame([(seg, None, None, bytes(head[5]), None, *head[:5])])


def _links(seg: str, first: int, hashes: list[bytes], events: list[str]) -> pd.DataFrame:
    """Rows of linked events by columns, which takes a fraction of the time of rows; ``hashes`` start with the head's."""
    count = len(events)
    numbers = np.arange(first, first + count)
    out = {f.name: pd.arrays.IntegerArray(numbers, np.full(count, f.name != "pos")) for f in LINKED if isinstance(f.dataType, T.LongType)}
    out |= {"seg": seg, "prev_hash": hashes[:-1], "this_hash": hashes[1:], "event": events, "first_id": None, "last_id": None}
    return pd.DataFrame(out, columns=LINKED.names)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=LINKED.names)
    return frame.astype({f.name: "Int64" for f in LINKED if isinstance(f.dataType, T.LongType)})


def linked_events(
    arrivals: DataFrame, delay: str, minutes: int = SEGMENT_MINUTES, shards: int = 1,
) -> DataFrame:
    """The stream of linked events and sealed segments (schema LINKED) of a stream of accepted events.

    Events that are at most ``delay`` older than the newest one seen before are in time.  An
    hour's events are dealt to ``shards`` segments by the hash of their ids, which bounds what one
    key links and keeps: choose it so that no segment has over a million events.
    """
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    rows = arrivals.withWatermark("ts", delay).select(
        segment_name(bucket_text(minutes, time_bucket(minutes)), shard).alias("seg"),
        # a plain number: late events must reach the operator, not Spark's filter for them
        F.unix_micros("ts").alias("us"), "id", canonical_body().alias("body"),
        F.to_json(F.struct(*ARRIVALS.names), _MICROS).alias("event"),
    )
    return rows.groupBy("seg").transformWithStateInPandas(
        Linker(minutes * 60_000_000), LINKED, outputMode="append", timeMode="EventTime"
    )


def _events(linked: DataFrame) -> DataFrame:
    told = linked.where("pos IS NOT NULL").withColumn("e", F.from_json("event", ARRIVALS, _MICROS))
    return told.select("e.*", "seg", "pos", "prev_hash", "this_hash")


def _segments(linked: DataFrame) -> DataFrame:
    return linked.where("n IS NOT NULL").select(
        "seg", "n", "first_id", F.timestamp_micros("first_us").alias("first_ts"), "last_id", F.timestamp_micros("last_us").alias("last_ts"),
        F.col("this_hash").alias("root"),
    )


def _last_sealed(spark: SparkSession, store: Store) -> tuple[bytes, datetime | None]:
    """Hash and time of the segment sealed last; only the newest folder is read."""
    folders = store.log.state().folders("segments")
    if not folders:
        return _ZERO, None
    newest = store.open(spark, "segments", [folders[-1].path], SEGMENTS)
    last = newest.agg(F.max_by(F.struct("segment_hash", F.unix_micros("sealed_at").alias("us")), F.struct("sealed_at", "seg")).alias("l")).first()["l"]
    return bytes(last["segment_hash"]), datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last["us"])


def seal_batch(linked: DataFrame, batch: int, store: Store, clock: Callable[[], datetime], writer: str = "sealing") -> None:
    """Store one batch of linked events and sealed segments in one commit.

    ``sealed_at`` is the clock's time, or just after the segments sealed before if that is later,
    so that it orders the chain over segments.
    """
    spark = linked.sparkSession
    with store.begin(spark, writer, batch) as tx:
        if tx.done:
            return
        linked = linked.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            tx.write(_events(linked), "audit_events")
            start, before = _last_sealed(spark, store)
            now = clock()
            if before is not None:
                now = max(now, before + timedelta(microseconds=1))
            new = _segments(linked).withColumn("sealed_at", F.lit(now).cast("timestamp"))
            tx.write(segment_chain(new, ("sealed_at", "seg"), start), "segments")
        finally:
            linked.unpersist()


def start_sealing(
    spark: SparkSession, store: Store, checkpoint: str, delay: str, minutes: int = SEGMENT_MINUTES, shards: int = 1,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), **trigger,
) -> StreamingQuery:
    """Link and seal a store's arrivals (see ``IngestConfig.sealing``) into events and segments.

    By default a batch follows as soon as there are new arrivals.
    """
    linked = linked_events(read_committed(spark, store, "arrivals"), delay, minutes, shards)
    return (
        linked.writeStream.foreachBatch(lambda df, batch: seal_batch(df, batch, store, clock, query_name(df, "sealing")))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
        .start()
    )
