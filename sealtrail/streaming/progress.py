"""A listener that keeps the progress of streaming queries in a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from sealtrail.schema import PROGRESS
from sealtrail.sources.tables import Store


def _moment(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


class ProgressTable(StreamingQueryListener):
    """Appends a row per batch of the named queries (all, if none are named) to ``progress``.

    Rows are numbered by batch, so one that runs again after a restart keeps its first row.  What
    a batch did to messages is in ``batches``, committed with the batch itself.
    """

    def __init__(self, spark: SparkSession, store: Store, names: tuple[str, ...] = ()):
        self.spark, self.store, self.names = spark, store, names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if self.names and told.name not in self.names:
            return
        at, watermark = _moment(told.timestamp), _moment((told.eventTime or {}).get("watermark"))
        if watermark is not None and watermark.timestamp() <= 0:  # none seen yet
            watermark = None
        newest = _moment((told.eventTime or {}).get("max"))
        lag = int((newest - watermark).total_seconds() * 1000) if watermark and newest else None
        seen = told.observedMetrics.get("ingest") if told.observedMetrics else None
        row = (
            str(told.id), told.batchId, at, told.numInputRows,
            seen["messages"] if seen else None, seen["undecodable"] if seen else None, watermark, lag,
            told.durationMs.get("triggerExecution"), sum(s.numRowsTotal for s in told.stateOperators or []),
        )
        rows = self.spark.createDataFrame([row], PROGRESS)
        self.store.write_batch(rows, "progress", told.batchId, f"progress/{told.id}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
