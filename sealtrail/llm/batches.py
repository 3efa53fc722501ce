"""Sizes of the Arrow batches that Python operators work on."""

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sealtrail.sources.scratch import stored

_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8_000_000
OWN_BYTES = 4_000_000


def at_most(spark: SparkSession, rows: int) -> None:
    """Keep the session's Arrow batches to ``rows`` rows and ``OWN_BYTES`` bytes, which bounds what a worker holds.

    For operators whose result is computed after they return.  Smaller settings stay; results do
    not depend on them.
    """
    for conf, most in ((_CONF, rows), (_BYTES, OWN_BYTES)):
        now = spark.conf.get(conf, None)
        if now is None or not 0 < _number(now) <= most:
            spark.conf.set(conf, str(most))


def _number(text: str) -> int:
    """A setting in bytes or rows; one with a unit counts as too large."""
    digits = text.lower().removesuffix("b")
    return int(digits) if digits.lstrip("-").isdigit() else 0


def give_back() -> None:
    """Return memory that nothing holds any more to the system, for a Python worker at the end of its rows.

    Spark keeps idle workers for later tasks, of any operator, beside those that are at work;
    without this each keeps the most that it ever needed.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


@contextmanager
def byte_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of ``size`` bytes at most (or one row) for the actions inside; then as before."""
    before = spark.conf.get(_BYTES, None)
    spark.conf.set(_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BYTES)
        else:
            spark.conf.set(_BYTES, before)


def stored_in_batches(df: DataFrame, name: str, size: int = BATCH_BYTES) -> DataFrame:
    """``df`` written and read again; its Python operators get batches of ``size`` bytes at most."""
    with byte_batches(df.sparkSession, size):
        return stored(df, name)
