"""Periodic anchors over sealed segments, and over any stream of chained events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sealtrail.operators.anchor import Signer, anchor_sealed, signature
from sealtrail.operators.chain import SEGMENT_MINUTES
from sealtrail.sources.tables import Store
from sealtrail.streaming.committed import read_committed
from sealtrail.streaming.ingest import query_name


def read_events(spark: SparkSession, store: Store) -> DataFrame:
    """Stored events as a stream: each once, also after failed or repeated batches and compaction."""
    return read_committed(spark, store, "audit_events")


def anchor_stream(
    chained: DataFrame, delay: str, minutes: int = SEGMENT_MINUTES, signer: Signer | None = None
) -> DataFrame:
    """One anchor per event-time window, emitted once the watermark has passed it.

    Windows aggregate partially per task, so a crowded window is one row per task.  Such an
    anchor speaks of its window's last event; :func:`start_anchors` signs the chain over segments.
    """
    windows = (
        chained.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{minutes} minutes"))
        .agg(
            F.max_by(F.struct("id", "ts", "this_hash"), F.struct("ts", "id")).alias("head"),
            F.count(F.lit(1)).alias("event_count"),
        )
    )
    signed = windows.withColumn("_signed", signature("head.this_hash", signer))
    return signed.select(
        F.concat(F.lit("anchor-"), F.date_format("window.start", "yyyy-MM-dd'T'HH:mm")).alias("id"),
        F.col("window.end").alias("anchored_at"),
        F.col("head.this_hash").alias("root_hash"),
        F.col("head.id").alias("last_event_id"),
        F.col("head.ts").alias("last_event_ts"),
        F.col("_signed.signature").alias("signature"),
        F.col("_signed.key_id").alias("key_id"),
        "event_count",
    )


def start_anchors(
    spark: SparkSession, store: Store, checkpoint: str, signer: Signer | None = None, **trigger
) -> StreamingQuery:
    """Anchor sealed segments as they are committed into the store's ``anchors`` table.

    An anchor's root is the hash of the segment sealed last, which all segments sealed before it
    go into, those of late events too.  By default a batch follows as soon as there are new ones.
    """

    def anchor(df: DataFrame, batch: int) -> None:
        store.write_batch(anchor_sealed(df, signer), "anchors", batch, query_name(df, "anchors"))

    return (
        read_committed(spark, store, "segments").writeStream.foreachBatch(anchor)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
        .start()
    )
