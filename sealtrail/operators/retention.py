"""Retention, lifecycle and legal holds as plans over the payload inventory.

``as_of`` is always an argument: the same inventory gives the same plan again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sealtrail.plans.joins import broadcast_if_small, present

# Default lifecycle steps (age in days, from class, to class).
LIFECYCLE = ((90, "STANDARD", "GLACIER"), (365, "GLACIER", "DEEP_ARCHIVE"))


def _after_days(start: Column, days: Column | int) -> Column:
    """Exactly 24 hours per day."""
    return F.timestamp_micros(F.unix_micros(start) + F.lit(86_400_000_000) * days)


def is_retained(as_of: datetime) -> Column:
    """Under legal hold, or inside the retention period."""
    until = _after_days(F.col("created_at"), F.col("retention_days"))
    kept = (F.col("retention_days") > 0) & (F.lit(as_of).cast("timestamp") < until)
    return F.col("legal_hold") | kept


def inventory(payloads: DataFrame) -> DataFrame:
    """Size, class, retention and hold of each stored payload; bodies are only measured."""
    return payloads.select(
        "payload_ref",
        F.octet_length("body").alias("size"),
        "storage_class",
        "retention_days",
        "legal_hold",
        "created_at",
    )


def retention_state(payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Add ``retained`` and ``retained_until`` (NULL without a retention period)."""
    until = _after_days(F.col("created_at"), F.col("retention_days"))
    return payloads.withColumn("retained", is_retained(as_of)).withColumn(
        "retained_until", F.when(F.col("retention_days") > 0, until)
    )


def purge_plan(payloads: DataFrame, as_of: datetime, holds: DataFrame | None = None) -> DataFrame:
    """Decision per payload: purge, or refuse with the reason.

    With the hold log an event's latest entry counts instead of the payload's initial hold.
    """
    if holds is not None:
        now = current_holds(holds).select(F.col("id").alias("payload_ref"), "hold")
        payloads = payloads.join(broadcast_if_small(now), "payload_ref", "left").withColumn(
            "legal_hold", F.coalesce("hold", "legal_hold")
        )
    held = F.when(F.col("legal_hold"), "legal hold")
    return payloads.select(
        "payload_ref",
        F.when(is_retained(as_of), "refuse").otherwise("purge").alias("decision"),
        F.when(is_retained(as_of), F.coalesce(held, F.lit("retention active"))).alias("reason"),
    )


def worm_conflicts(incoming: DataFrame, payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Incoming payload keys that would overwrite a retained payload."""
    return present(incoming, payloads.where(is_retained(as_of)), "payload_ref")


def put_payloads(incoming: DataFrame, payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Incoming payloads whose key is free or no longer retained."""
    return incoming.join(worm_conflicts(incoming, payloads, as_of), "payload_ref", "left_anti")


def next_class(as_of: datetime, steps=LIFECYCLE) -> Column:
    """Storage class after one lifecycle run; at most one hop."""

    def due(age: int, source: str) -> Column:
        old = _after_days(F.col("created_at"), age) <= F.lit(as_of).cast("timestamp")
        return (F.col("storage_class") == source) & old

    cases = [F.when(due(age, source), F.lit(target)) for age, source, target in steps]
    return F.coalesce(*cases, F.col("storage_class"))


def lifecycle_plan(payloads: DataFrame, as_of: datetime, steps=LIFECYCLE) -> DataFrame:
    """Payloads that change class."""
    return (
        payloads.withColumn("next_class", next_class(as_of, steps))
        .where(F.col("next_class") != F.col("storage_class"))
        .select("payload_ref", "storage_class", "next_class")
    )


def lifecycle_counts(payloads: DataFrame, as_of: datetime, steps=LIFECYCLE) -> DataFrame:
    return lifecycle_plan(payloads, as_of, steps).groupBy("storage_class", "next_class").agg(
        F.count(F.lit(1)).alias("transitions")
    )


# --- legal holds ---


def current_holds(holds: DataFrame) -> DataFrame:
    """Latest entry per id of the append-only hold log.

    Partial aggregation keeps an id with very many entries out of a single task.
    """
    return holds.groupBy("id").agg(F.max_by("hold", F.struct("changed_at", "hold")).alias("hold"))


def with_legal_hold(events: DataFrame, holds: DataFrame) -> DataFrame:
    """Add ``legal_hold``: the latest logged state, else the event's initial one."""
    initial = F.col("legal_hold_initial") if "legal_hold_initial" in events.columns else F.lit(False)
    return (
        events.join(broadcast_if_small(current_holds(holds)), "id", "left")
        .withColumn("legal_hold", F.coalesce("hold", initial))
        .drop("hold")
    )


def unknown_holds(holds: DataFrame, events: DataFrame) -> DataFrame:
    """Ids in the hold log that no event has."""
    return holds.select("id").distinct().join(present(holds, events, "id"), "id", "left_anti")


def set_holds(spark, ids: list[str], hold: bool, at: datetime) -> DataFrame:
    """Rows to append to the hold log."""
    return spark.createDataFrame([(i, hold, at) for i in ids], "id STRING, hold BOOLEAN, changed_at TIMESTAMP")
