"""Structured Streaming ingest: wire messages to chained, stored events.

Each micro-batch decodes, judges, dead-letters, de-duplicates, and stores payloads and chained
events, all in one commit: readers see a batch whole or not at all, and one that runs again after
its commit adds nothing.  Copies of stored events are found by the store's index of ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sealtrail.operators.chain import SEGMENT_MINUTES, build_chain, latest_heads, segment_heads
from sealtrail.operators.ingest import (
    RETENTION_DAYS,
    STORAGE_CLASS,
    accepted,
    as_dead_letters,
    as_events,
    as_payloads,
    decode,
    dedup,
    dedup_known,
    judge_messages,
)
from sealtrail.operators.metrics import latency_sketches
from sealtrail.operators.redact import load_policy
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.plans.ordering import MAX_ROWS
from sealtrail.schema import ARRIVALS, BATCHES
from sealtrail.sources.id_index import IdIndex
from sealtrail.sources.tables import Store, Transaction

# Batches after which small folders of the tables are merged.
COMPACT_EVERY = 64


def _now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass(frozen=True)
class IngestConfig:
    """Settings of an ingest stream.

    ``duplicates_share_ts``: redelivered events repeat their timestamp, so the duplicate check
    reads the ids of the batch's own dates, and no index is kept.  Off by default.
    ``sealing``: events are stored as arrivals, and the sealing stream chains them when the
    watermark passes them.  Off by default: then a batch chains its events at once.
    """

    minutes: int = SEGMENT_MINUTES
    max_rows: int = MAX_ROWS
    policy_path: str | None = None
    retention_days: int = RETENTION_DAYS
    storage_class: str = STORAGE_CLASS
    legal_hold: bool = False
    duplicates_share_ts: bool = False
    sealing: bool = False
    clock: Callable[[], datetime] = field(default=_now)


def query_name(df: DataFrame, kind: str) -> str:
    """The writer a streaming query commits as: queries with other checkpoints count batches anew."""
    query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{kind}/{query}" if query else kind


def _new(messages: DataFrame, tx: Transaction, config: IngestConfig) -> DataFrame:
    if not config.duplicates_share_ts:
        return dedup_known(messages, IdIndex(tx.store).known(messages, tx.state))
    table = "arrivals" if config.sealing else "audit_events"
    stored = tx.store.read(tx.spark, table, state=tx.state)
    dates = messages.select(F.to_date("ts").alias("event_date")).distinct()
    return dedup(messages, stored.join(broadcast_if_small(dates), "event_date", "left_semi").select("id"))


def ingest_batch(decoded: DataFrame, batch: int, store: Store, config: IngestConfig, writer: str = "ingest") -> None:
    """Ingest one batch of decoded messages.  Sink failures propagate and fail the batch."""
    spark = decoded.sparkSession
    tx = store.begin(spark, writer, batch)
    if tx.done:
        return
    now = config.clock()
    policy = load_policy(config.policy_path, spark)  # re-read: a changed file applies from here on
    judged = judge_messages(decoded, policy, decoded=True).persist(StorageLevel.MEMORY_AND_DISK)
    new = _new(accepted(judged), tx, config).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tx.write(as_dead_letters(judged, now), "dead_letter")
        tx.write(as_payloads(new, now, config.retention_days, config.storage_class, config.legal_hold), "payloads")
        moment = F.lit(now).cast("timestamp")
        tx.write(latency_sketches(new, moment).withColumn("at", moment), "latency")
        events = as_events(new, now, config.legal_hold)
        if config.sealing:
            tx.write(events.select(*ARRIVALS.names), "arrivals")
        else:
            heads = store.read(spark, "heads", state=tx.state)
            # several streams may write into one store: late segments carry the writer, too
            name = f"{batch:012d}" if writer == "ingest" else f"{batch:012d}-{writer.rsplit('/', 1)[-1][:8]}"
            tx.write(build_chain(events, config.minutes, config.max_rows, heads=heads, batch=name), "audit_events")
            # Read back: the fold is not run again for the heads.
            tx.write(segment_heads(tx.read("audit_events"), config.minutes), "heads")
        if not config.duplicates_share_ts:
            IdIndex(store).add(tx, new)
        tx.write(_outcome(judged, new, writer, batch, now), "batches")
        tx.commit()
    finally:
        new.unpersist()
        judged.unpersist()
    keep_up(store, spark, batch)


def _outcome(judged: DataFrame, new: DataFrame, writer: str, batch: int, now: datetime) -> DataFrame:
    counts = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reject_kind").isNotNull()).alias("rejected")).first()
    ingested = new.count()
    row = (writer, batch, now, counts["n"], counts["rejected"], counts["n"] - counts["rejected"] - ingested, ingested)
    return judged.sparkSession.createDataFrame([row], BATCHES)


def keep_up(store: Store, spark: SparkSession, batch: int) -> None:
    """Upkeep between batches: index levels are merged, now and then small folders, too.

    Of the heads only the latest per time bucket are kept, which is all that batches look at.
    """
    IdIndex(store).merge(spark)
    if batch % COMPACT_EVERY == COMPACT_EVERY - 1:
        store.compact(spark, "heads", reduce=latest_heads)
        for table in ("audit_events", "payloads", "dead_letter", "arrivals", "latency", "batches"):
            store.compact(spark, table)


def start_ingest(
    wire: DataFrame,
    store: Store,
    checkpoint: str,
    config: IngestConfig | None = None,
    watermark: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the stream.  ``watermark`` (e.g. "1 hour") drops near-in-time copies of a message
    in the stream's state already; the check against stored ids stays exact either way.
    Only byte-equal messages count as copies there: one that will be rejected must not hide
    a valid one with the same id.

    Message and reject counts appear in the query progress as ``ingest``.
    """
    config = config or IngestConfig()
    decoded = decode(wire).observe(
        "ingest",
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("error").isNotNull()).alias("undecodable"),
    )
    if watermark:
        # Messages without an id are dead letters, each of which is kept.
        told = F.col("error").isNull() & (F.col("id") != "")
        decoded = decoded.withColumn(
            "_key", F.when(told, F.concat_ws("/", "id", F.sha2("value", 256))).otherwise(
                F.concat_ws("/", "topic", "partition", "offset", F.sha2("value", 256))
            )
        )
        decoded = (
            decoded.withWatermark("kafka_ts", watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
        )
    return (
        decoded.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, store, config, query_name(df, "ingest")))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
