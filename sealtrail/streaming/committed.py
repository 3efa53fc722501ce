"""A stream of a store's table: every committed row once.

The offset is the log's version.  Folders of batches that never committed are not in the log,
and those that compaction wrote bring no new rows, so neither failures nor upkeep repeat a row.
The tasks read spans of rows, dealt out evenly: large files are cut at any row, small ones share a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import dataset as ds
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from sealtrail.sources.commits import Log
from sealtrail.sources.files import data_files, file_system, rows_in
from sealtrail.sources.tables import SCHEMAS, Store

FORMAT = "sealtrail-committed"
# Bytes of data files that one task reads; a row costs far more than its bytes once it is parsed and encoded.
PARTITION_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 8_192
_ALL = 1 << 62


@dataclass
class Spans(InputPartition):
    """Parts of files: (path, first row, end)."""

    spans: tuple[tuple[str, int, int], ...]


class CommittedReader(DataSourceStreamReader):
    def __init__(self, root: str, table: str, schema: T.StructType, start: int):
        self.root, self.table, self.schema, self.first, self.start = root, table, schema, start, start

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        # the last version that brought rows to this table: commits to others are no news
        self.start = max([self.start, *[f.version for f in Log(self.root).state().folders(self.table)]])
        return {"version": self.start}

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        found: list[tuple[str, int]] = []
        for commit in Log(self.root).commits_after(start["version"], end["version"]):
            for row in commit["add"]:
                if row["table"] == self.table and not row["rewritten"]:
                    folder = f"{self.root}/{row['path']}"
                    found += [(f"{folder}/{name}", size) for name, size in data_files(folder)]
        out, size = [[]], 0
        for path, more in found:
            pieces = -(-more // PARTITION_BYTES)
            if pieces > 1:
                rows = rows_in([path])
                cuts = [rows * k // pieces for k in range(pieces + 1)]
                out += [[(path, first, last)] for first, last in zip(cuts, cuts[1:])] + [[]]
                size = 0
                continue
            if out[-1] and size + more > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append((path, 0, _ALL))
            size += more
        return [Spans(tuple(spans)) for spans in out if spans]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema, timestamp_utc=True)
        for path, first, last in partition.spans:
            system, inner = file_system(path)
            keys = ds.partitioning(flavor="hive", schema=pa.schema([wanted.field(c) for c in ("event_date",) if c in wanted.names]))
            found = ds.dataset(inner, filesystem=system, format="parquet", partitioning=keys, partition_base_dir=_base(inner))
            for batch in _span(found, first, last, wanted.names):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in wanted], schema=wanted)


def _span(found: ds.Dataset, first: int, last: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ``first`` to ``last`` of a file; only row groups that have some of them are read."""
    for file in found.get_fragments():
        for group in file.split_by_row_group():
            rows = group.row_groups[0].num_rows
            if last > 0 and first < rows:
                at = 0
                for batch in group.to_batches(schema=found.schema, columns=columns, batch_size=BATCH_ROWS):
                    begin, end = max(0, first - at), min(len(batch), last - at)
                    if begin < end:
                        yield batch.slice(begin, end - begin)
                    at += len(batch)
                    if at >= last:
                        break
            first, last = max(0, first - rows), last - rows


def _base(path: str) -> str:
    """The folder of the attempt that a file belongs to."""
    parts = path.split("/")
    at = max(i for i, part in enumerate(parts) if part.startswith("attempt="))
    return "/".join(parts[: at + 1])


class CommittedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMAS[self.options["table"]]

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return CommittedReader(self.options["root"].rstrip("/"), self.options["table"], schema, int(self.options.get("startversion", "-1")))


def read_committed(spark: SparkSession, store: Store, table: str, after_version: int = -1) -> DataFrame:
    """The rows that commits after ``after_version`` bring to ``table``, as a stream."""
    spark.dataSource.register(CommittedSource)
    return spark.readStream.format(FORMAT).option("root", store.root).option("table", table).option("startVersion", after_version).load()


def drained(query: StreamingQuery) -> None:
    """Wait until all that is committed has been processed, and what only the watermark releases, too; then stop.

    (A trigger of all available data ends before the watermark's last step with this source.)
    """
    try:
        query.processAllAvailable()
    finally:
        query.stop()
