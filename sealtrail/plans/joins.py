"""Broadcasts behind a size check."""

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``limit`` (narrow) rows, else as it is.

    The check fetches up to ``limit`` rows, which a broadcast would fetch as well, and
    keeps them, so a small side is computed once however often it is joined.  A larger
    one is left to adaptive execution, which chooses the join and splits skewed partitions.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def present(few: DataFrame, table: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct keys of ``few`` that ``table`` has.

    ``table`` is the large side: while the keys are few enough to broadcast it is only
    scanned, one column of it, and never shuffled.
    """
    keys = broadcast_if_small(few.select(key).distinct(), limit)
    return table.select(key).join(keys, key, "left_semi").distinct()
