"""Sample tables in the shape of audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealtrail.sources.wire import TOPIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uuid_like(number: Column) -> Column:
    """A UUID-shaped id: the number in its first and last group (up to 8 hex digits)."""
    digits = F.lower(F.hex(number))
    return F.concat(F.lpad(digits, 8, "0"), F.lit("-0000-7000-8000-"), F.lpad(digits, 12, "0"))


def _audit(df: DataFrame, id_: Column, ts: Column, service: Column, actor: Column, action: Column,
           target_type: str, target_id: Column, payload: Column) -> DataFrame:
    moment = ts.cast("timestamp")
    return df.select(
        id_.alias("id"),
        moment.alias("ts"),
        (F.unix_micros(moment) * 1000).alias("ts_ns"),
        service.alias("source_service"),
        actor.alias("actor_id"),
        action.alias("action"),
        F.lit(target_type).alias("target_type"),
        target_id.cast("string").alias("target_id"),
        F.unhex(F.sha2(payload.cast("binary"), 256)).alias("payload_hash"),
        id_.alias("payload_ref"),
        F.lit(False).alias("redacted"),
        F.to_date(moment).alias("event_date"),
    )


def audit_events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``events``, one audit event per row, not yet chained.

    A file may be one row group and so one scan task; with ``dealt`` the narrow rows are dealt out
    evenly before the events are made.
    """
    e = table(spark, sf_dir, "events")
    if dealt:
        e = e.select("event_id", "ts", "user_id", "event_type", "props").hint("rebalance")
    event_id = F.col("event_id")
    return _audit(
        e, uuid_like(event_id), F.col("ts"), F.col("event_type"),
        F.concat(F.lit("user_"), F.col("user_id")), F.col("event_type"), "user", F.col("user_id"), F.col("props"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders``; order dates repeat, so many events share one timestamp."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return _audit(
        o, uuid_like(key), F.col("o_orderdate"), F.lit("orders"),
        F.concat(F.lit("cust_"), F.col("o_custkey")), F.concat(F.lit("order."), F.col("o_orderstatus")),
        "order", key, F.col("o_orderpriority"),
    )


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem``; rows are told apart by all of their key columns."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(20,2)"))
    return _audit(
        li, key, F.col("l_shipdate"), F.lit("shipping"), F.concat(F.lit("supp_"), F.col("l_suppkey")),
        F.concat(F.lit("ship."), F.col("l_linestatus")), "order", F.col("l_orderkey"), F.col("l_returnflag"),
    )


def payload_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads of ``events`` with varied retention, holds and classes."""
    e = table(spark, sf_dir, "events")
    event_id = F.col("event_id")
    return e.select(
        uuid_like(event_id).alias("payload_ref"),
        F.col("props").cast("binary").alias("body"),
        F.lit("application/json").alias("content_type"),
        F.when(event_id % 3 == 0, "GLACIER").otherwise("STANDARD").alias("storage_class"),
        (event_id % 40).cast("int").alias("retention_days"),
        (event_id % 50 == 0).alias("legal_hold"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def hold_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th event is put on hold; every 40th is released a day later."""
    e = table(spark, sf_dir, "events")
    event_id = F.col("event_id")
    base = e.select(uuid_like(event_id).alias("id"), F.col("ts").cast("timestamp").alias("at"), event_id)
    placed = base.where(event_id % 20 == 0).select("id", F.lit(True).alias("hold"), F.col("at").alias("changed_at"))
    released = base.where(event_id % 40 == 0).select(
        "id", F.lit(False).alias("hold"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("changed_at")
    )
    return placed.unionByName(released)


def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as wire messages with defects at fixed ids, and redelivered copies.

    Defects: every 97th lacks the actor, every 89th the target id, every 83rd has the hash
    of other bytes, every 79th a malformed hash and no payload, every 73rd is no JSON,
    every 71st has a payload that is no object.  Every 10th is delivered twice.

    A file may be one row group and so one scan task; the narrow rows are dealt out evenly before the
    messages are made, so that decoding them spreads.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props").hint("rebalance")
    n = F.col("event_id")
    payload = F.when(n % 71 == 0, F.lit("[1, 2]")).otherwise(F.col("props"))
    hashed = F.when(n % 83 == 0, F.concat(payload, F.lit("x"))).otherwise(payload)
    hash_text = F.when(n % 79 == 0, F.lit("sha256:deadbeef")).otherwise(
        F.concat(F.lit("sha256:"), F.sha2(hashed.cast("binary"), 256))
    )
    body = F.when(n % 79 == 0, F.lit("")).otherwise(F.concat(F.lit(', "payload": '), payload))
    text = F.concat(
        F.lit('{"id": "'), uuid_like(n),
        F.lit('", "ts": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z"'),
        F.lit(', "source_service": "'), F.col("event_type"),
        F.lit('", "actor_id": "'), F.when(n % 97 == 0, "").otherwise(F.concat(F.lit("user_"), F.col("user_id"))),
        F.lit('", "action": "'), F.col("event_type"),
        F.lit('", "target_type": "user", "target_id": "'),
        F.when(n % 89 == 0, "").otherwise(F.col("user_id").cast("string")),
        F.lit('", "payload_hash": "'), hash_text, F.lit('"'), body, F.lit("}"),
    )
    value = F.when(n % 73 == 0, F.concat(F.lit("not json "), n.cast("string"))).otherwise(text)
    first = e.select(
        F.lit(TOPIC).alias("topic"),
        (n % 8).cast("int").alias("partition"),
        n.alias("offset"),
        F.concat(F.lit("key-"), n.cast("string")).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.col("ts").cast("timestamp").alias("kafka_ts"),
    )
    # both deliveries come from one scan
    later = F.array(F.lit(0).cast("long"), F.when(F.col("offset") % 10 == 0, F.lit(1_000_000_000_000)))
    deliveries = first.withColumn("_later", F.explode(F.filter(later, lambda x: x.isNotNull())))
    return deliveries.withColumn("offset", F.col("offset") + F.col("_later")).drop("_later")


def tampered(chained: DataFrame) -> DataFrame:
    """Chained sample events, the actor changed where the id's number leaves 5 on division by 1009."""
    number = F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint")
    actor = F.when(number % 1009 == 5, F.lit("tampered")).otherwise(F.col("actor_id"))
    return chained.withColumn("actor_id", actor)
