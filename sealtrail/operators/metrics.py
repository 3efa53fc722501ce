"""Counters over outcome rows; latencies as sketches that merge.

Each batch stores one narrow row per service: a KLL sketch of its latencies, their buckets, number
and sum.  Any window over batches, services or both then merges rows, never messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Upper bounds of the latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ingest_counters(outcomes: DataFrame) -> DataFrame:
    """Messages by service and outcome; messages that do not decode count as 'unknown'."""
    return outcomes.groupBy(service_label().alias("service"), "outcome").agg(
        F.count(F.lit(1)).alias("messages")
    )


def reject_counters(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.where(F.col("reject_kind").isNotNull())
        .groupBy("topic", service_label().alias("service"), F.col("reject_kind").alias("reason"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def service_label() -> Column:
    return F.when(F.col("reject_kind") == "decode", "unknown").otherwise(F.col("source_service"))


def verify_outcomes(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count(F.lit(1)).alias("events"))


def latency_histogram(df: DataFrame, seconds: Column, by: str = "source_service") -> DataFrame:
    """Cumulative bucket counts, sum and count per group, one row per bucket."""
    counts = [
        F.struct(F.lit(str(b)).alias("le"), F.count_if(seconds <= b).alias("n")) for b in BUCKETS
    ] + [F.struct(F.lit("+Inf").alias("le"), F.count(seconds).alias("n"))]
    grouped = df.groupBy(by).agg(
        F.array(*counts).alias("_b"), F.sum(seconds).alias("total"), F.count(seconds).alias("n")
    )
    return grouped.select(by, "total", "n", F.explode("_b").alias("_x")).select(
        by, F.col("_x.le").alias("le"), F.col("_x.n").alias("observations"), "total", "n"
    )


def latency_quantile(df: DataFrame, seconds: Column, q: float = 0.99, by: str = "source_service") -> DataFrame:
    return df.groupBy(by).agg(F.percentile_approx(seconds, q, 10_000).alias("latency"))


# Accuracy of a sketch: quantiles are off by at most about 0.4 per cent of the rank.
SKETCH_K = 800


def latency_sketches(messages: DataFrame, at: Column, since: str = "kafka_ts", by: str = "source_service") -> DataFrame:
    """(service, n, total_us, buckets, sketch): the time from ``since`` to ``at``, per service.

    ``buckets`` counts observations up to each of ``BUCKETS`` seconds, and all at its end.
    Messages without either time are left out.
    """
    us = F.unix_micros(at) - F.unix_micros(since)
    told = messages.select(F.col(by).alias("service"), us.alias("us")).where("us IS NOT NULL")
    counts = [F.count_if(F.col("us") <= int(b * 1_000_000)) for b in BUCKETS] + [F.count(F.lit(1))]
    return told.groupBy("service").agg(
        F.count(F.lit(1)).alias("n"), F.sum("us").alias("total_us"), F.array(*counts).alias("buckets"),
        F.kll_sketch_agg_bigint("us", F.lit(SKETCH_K)).alias("sketch"),
    )


def merged_latency(sketches: DataFrame, *by: str) -> DataFrame:
    """Rows of :func:`latency_sketches` merged per ``by`` (none: into one row)."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total_us").alias("total_us"),
        F.array(*[F.sum(F.get("buckets", F.lit(i))) for i in range(len(BUCKETS) + 1)]).alias("buckets"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    )
    return merged.where("n > 0")


def latency_at(sketches: DataFrame, q: float = 0.99, *by: str) -> DataFrame:
    """``latency_us`` below which a share ``q`` of the observations is, from merged sketches."""
    return merged_latency(sketches, *by).select(*by, "n", F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias("latency_us"))


def latency_buckets(sketches: DataFrame, *by: str) -> DataFrame:
    """Cumulative bucket counts, number and sum, one row per bucket; exact."""
    names = F.array(*[F.lit(str(b)) for b in BUCKETS], F.lit("+Inf"))
    return merged_latency(sketches, *by).select(*by, "n", "total_us", F.explode(F.arrays_zip(names.alias("le"), F.col("buckets").alias("c"))).alias("b")).select(
        *by, F.col("b.le").alias("le"), F.col("b.c").alias("observations"), "n", "total_us"
    )


def exports_by_format(runs: DataFrame, status: str = "COMPLETE") -> DataFrame:
    """Export runs in ``status``, counted by format (rows of the run log; logged twice counts twice)."""
    return runs.where(F.col("status") == status).groupBy("format").agg(F.count(F.lit(1)).alias("exports"))


def observed(df: DataFrame, name: str) -> DataFrame:
    """Attach outcome counts to a (streaming) DataFrame for a query listener."""
    return df.observe(
        name,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("reject_kind").isNotNull()).alias("rejected"),
    )
