"""Skew-safe positions in the (ts, id) order of events.

A global window would move all rows into one task, and a window per hour would do the
same to an hour that holds a third of them.  Rows are therefore cut into *blocks*,
consecutive ranges of the order with a bounded number of rows:

* a bucket (an hour by default) with at most ``max_rows`` rows is one block;
* a larger bucket is cut at split rows drawn from the data itself.  A row is a
  candidate when the SHA-256 of its id is small, and every OVERSAMPLE-th candidate of a
  bucket is a split.  This depends on nothing but the rows, so retried tasks and
  repeated scans agree, and it also cuts buckets whose rows all share one timestamp.

Windows, folds and counts then run per block, and a table of one row per block carries
what must cross block borders.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealtrail.sources.scratch import stored

MAX_ROWS = 1_000_000
OVERSAMPLE = 16
# Bound on what is collected and shipped to tasks: about 100 bytes per split.  Of more splits
# only every k-th is; those between two of them are joined to the rows between.
MAX_SPLITS = 200_000

BLOCK = ("_bucket", "_sub")
ORDER = ("ts", "id")


def time_bucket(minutes: int = 60) -> Column:
    """Number of the fixed-length event-time bucket since the epoch."""
    width = F.lit(minutes * 60_000_000)
    us = F.unix_micros("ts")
    return F.call_function("div", us - F.pmod(us, width), width)  # exact, also before 1970


def candidate_threshold(target_rows: int) -> str:
    """Ids whose SHA-256 hex text sorts below this are split candidates."""
    share = min(1.0, OVERSAMPLE / target_rows)
    return f"{min(int(share * 2**32), 2**32 - 1):08x}"


def with_blocks(
    df: DataFrame,
    minutes: int = 60,
    max_rows: int = MAX_ROWS,
    bucket: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``_bucket`` and ``_sub``; blocks ordered by them are ordered by (ts, id).

    ``bucket`` must be a BIGINT that never falls as (ts, id) rises.  One narrow
    aggregation looks for oversized buckets; only if there are any does a second
    narrow job draw splits.  A caller that knows the number of ``rows`` spares small
    inputs the look.
    """
    df = df.withColumn("_bucket", time_bucket(minutes) if bucket is None else bucket)
    if rows is not None and rows <= max_rows:
        return df.withColumn("_sub", F.lit(0))
    oversized = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows)
    hot_rows = oversized.agg(F.sum("n")).first()[0]
    if not hot_rows:
        return df.withColumn("_sub", F.lit(0))
    splits = _splits(df, oversized, max_rows)
    step = math.ceil(hot_rows / max_rows / MAX_SPLITS)
    if step <= 1:
        return df.withColumn("_sub", _sub_of(_collected(splits))(F.col("_bucket"), F.unix_micros("ts"), F.col("id")))
    splits = stored(splits, "splits")
    coarse = _collected(splits.where(F.col("number") % step == 0))
    fine = (
        splits.where(F.col("number") % step != 0)
        .groupBy(F.col("_bucket").alias("_b"), F.expr(f"cast(number div {step} as int)").alias("_c"))
        .agg(F.collect_list(F.struct("us", "id")).alias("_fine"))
    )
    placed = df.withColumn("_coarse", _sub_of(coarse)(F.col("_bucket"), F.unix_micros("ts"), F.col("id")))
    joined = placed.join(fine, (F.col("_bucket") == F.col("_b")) & (F.col("_coarse") == F.col("_c")), "left")
    here = F.struct(F.unix_micros("ts").alias("us"), F.encode("id", "UTF-8").alias("id"))
    before = F.coalesce(F.size(F.filter("_fine", lambda s: s <= here)), F.lit(0))
    sub = (F.col("_coarse") * step + F.when(F.col("_fine").isNull(), 0).otherwise(before)).cast("int")
    return joined.withColumn("_sub", sub).drop("_coarse", "_b", "_c", "_fine")


def _splits(df: DataFrame, oversized: DataFrame, max_rows: int) -> DataFrame:
    """(_bucket, number, us, id): split rows of oversized buckets, counted from 1 in each.

    They depend on the bucket's rows and ``max_rows`` only.
    """
    candidates = df.where(F.sha2("id", 256) < candidate_threshold(max_rows)).join(
        oversized.select("_bucket"), "_bucket", "left_semi"
    )
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(*ORDER))
    return (
        candidates.select("_bucket", *ORDER, rank.alias("rank"))
        .where(F.col("rank") % OVERSAMPLE == 0)
        .select(
            "_bucket", F.expr(f"rank div {OVERSAMPLE}").alias("number"),
            F.unix_micros("ts").alias("us"), F.encode("id", "UTF-8").alias("id"),
        )
    )


def _collected(splits: DataFrame) -> list[tuple[int, int, bytes]]:
    return sorted((r[0], r[1], bytes(r[2])) for r in splits.select("_bucket", "us", "id").collect())


def _sub_of(splits: list[tuple[int, int, bytes]]):
    """UDF (bucket, micros, id) -> number of the bucket's splits at or before the row."""
    buckets = np.array([s[0] for s in splits], dtype="int64")
    micros = np.array([s[1] for s in splits], dtype="int64")
    ids = [s[2] for s in splits]

    @F.arrow_udf("int")
    def sub(bucket: pa.Array, us: pa.Array, id_: pa.Array) -> pa.Array:
        b, t = bucket.to_numpy(zero_copy_only=False), us.to_numpy(zero_copy_only=False)
        # Buckets never fall as time rises, so the splits are sorted by time as well.
        low, high = np.searchsorted(micros, t, "left"), np.searchsorted(micros, t, "right")
        at = low.copy()
        for i in np.flatnonzero(low != high):  # rows sharing a split's timestamp
            at[i] = bisect_right(ids, id_[int(i)].as_py().encode(), int(low[i]), int(high[i]))
        first = np.searchsorted(buckets, b, "left")
        last = np.searchsorted(buckets, b, "right")
        return pa.array(np.where(first < last, at - first, 0).astype("int32"))

    return sub


def block_starts(blocked: DataFrame) -> DataFrame:
    """One row per block: rows in it (``n``) and rows in all blocks before it (``start``).

    The window runs over one row per block: the buckets spanned, and about one per
    ``max_rows`` rows of oversized ones.
    """
    counts = blocked.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy(*BLOCK).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*BLOCK, "n", F.coalesce(before, F.lit(0)).alias("start"))


def with_position(df: DataFrame, **blocks) -> DataFrame:
    """Add ``position``, 1-based, in (ts, id) order."""
    blocked = with_blocks(df, **blocks)
    inner = F.row_number().over(W.partitionBy(*BLOCK).orderBy(*ORDER))
    return (
        blocked.withColumn("_in_block", inner)
        .join(block_starts(blocked).drop("n"), list(BLOCK))
        .withColumn("position", F.col("start") + F.col("_in_block"))
        .drop(*BLOCK, "_in_block", "start")
    )


def with_previous(df: DataFrame, column: str, name: str, **blocks) -> DataFrame:
    """Add ``name``: ``column`` of the previous row in (ts, id) order, NULL on the first row."""
    blocked = with_blocks(df, **blocks)
    inner = W.partitionBy(*BLOCK).orderBy(*ORDER)
    # One row per block; see block_starts for its bound.
    border = (
        blocked.groupBy(*BLOCK)
        .agg(F.max_by(column, F.struct(*ORDER)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(W.orderBy(*BLOCK)))
        .drop("_last")
    )
    first = F.row_number().over(inner) == 1
    return (
        blocked.withColumn("_first", first)
        .withColumn("_inner", F.lag(column).over(inner))
        .join(border, list(BLOCK))
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inner")))
        .drop(*BLOCK, "_first", "_inner", "_carried")
    )
