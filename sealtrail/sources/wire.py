"""Wire messages from a bus or from files.

Every operator takes any DataFrame with the WIRE columns, so the bus can be Kafka (with
Spark's connector on the classpath), a replayed directory, or a test frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealtrail.schema import WIRE

TOPIC = "audit.v1"  # fixed value: default topic


def read_kafka(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    streaming: bool = True,
    **options: str,
) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    loaded = reader.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    return loaded.select(
        "topic", "partition", "offset", "key", "value", F.col("timestamp").alias("kafka_ts")
    )


def read_wire(
    spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Recorded messages with the WIRE columns; a directory replays as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(WIRE).format(fmt).options(**options).load(path)


def from_text(lines: DataFrame, topic: str = TOPIC, partition: int = 0) -> DataFrame:
    """One message per line of ``spark.read.text``; the line number is the offset.

    Text files carry no offsets.  ``monotonically_increasing_id`` gives distinct ones that
    grow inside a file, which is all that first-delivery order needs.
    """
    return lines.select(
        F.lit(topic).alias("topic"),
        F.lit(partition).alias("partition"),
        F.monotonically_increasing_id().alias("offset"),
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit(None).cast("timestamp").alias("kafka_ts"),
    )
