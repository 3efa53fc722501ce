"""Append-only Parquet tables under a commit log.

Every write goes to a folder of its own and counts only once a commit names it.  A micro-batch
commits all its tables at once: readers, also those in the middle of a failing batch, see all of
it or nothing.  Rows are never changed; compaction replaces many small folders by one with the
same rows, again in one commit.  Flags such as holds and anchors live in tables of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sealtrail.operators.search import Zone, page_at
from sealtrail.schema import (
    ANCHORS,
    ARRIVALS,
    AUDIT_EVENTS,
    BATCHES,
    DEAD_LETTER,
    EXPORT_RUNS,
    HEADS,
    LATENCY,
    LEGAL_HOLDS,
    PAYLOADS,
    PROGRESS,
    SEGMENTS,
    VERIFIED,
)
from sealtrail.sources.commits import Folder, Log, State
from sealtrail.sources.files import data_files, delete_file, delete_folder, folders_in, rows_in
from sealtrail.sources.scratch import scratch_dir

SCHEMAS: dict[str, T.StructType] = {
    "audit_events": AUDIT_EVENTS,
    "arrivals": ARRIVALS,
    "segments": SEGMENTS,
    "verified_segments": VERIFIED,
    "latency": LATENCY,
    "batches": BATCHES,
    "progress": PROGRESS,
    "payloads": PAYLOADS,
    "dead_letter": DEAD_LETTER,
    "heads": HEADS,
    "anchors": ANCHORS,
    "legal_holds": LEGAL_HOLDS,
    "export_runs": EXPORT_RUNS,
}

# Point lookups skip row groups whose filter rules the value out.
_BLOOM = ("id", "actor_id", "target_id")

# A file without rows is smaller than this.
_EMPTY_BYTES = 16 * 1024

# Folders smaller than this are worth merging.
SMALL_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class Store:
    """Tables under one root path in shared storage."""

    root: str

    @property
    def log(self) -> Log:
        return Log(self.root)

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    # -- reading --

    def read(self, spark: SparkSession, table: str, version: int | None = None, state: State | None = None) -> DataFrame:
        """The table's rows as of a version of the log, by default the latest.

        The folders are fixed when this is called: a DataFrame keeps reading its snapshot while
        batches and compactions go on (until :meth:`clean` drops the version).
        """
        state = self.log.state(version) if state is None else state
        return self._rows(spark, table, state.folders(table))

    def _rows(self, spark: SparkSession, table: str, folders: list[Folder]) -> DataFrame:
        schema = SCHEMAS[table]
        return self.open(spark, table, [f.path for f in folders], schema).select(*schema.names)

    def open(self, spark: SparkSession, table: str, paths: list[str], schema: T.StructType) -> DataFrame:
        """Parquet folders of a table by their paths below the root."""
        if not paths:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema).option("basePath", self.path(table))
        return reader.parquet(*[f"{self.root.rstrip('/')}/{p}" for p in paths])

    def zones(self, state: State | None = None) -> list[Zone]:
        """The data files of the event table with their rows and bounds, from the log."""
        state = self.log.state() if state is None else state
        return [
            Zone(f"{folder.path}/{name}", n, tuple(first), tuple(last))
            for folder in state.folders("audit_events") for name, n, first, last in folder.facts["zones"]
        ]

    def page(self, spark: SparkSession, number: int, limit: int = 100) -> tuple[DataFrame, int]:
        """Page ``number`` (from 1) of all events, and how many events there are; reads only that page's files."""
        zones = self.zones()
        schema = SCHEMAS["audit_events"]
        files = lambda paths: self.open(spark, "audit_events", paths, schema).select(*schema.names)
        return page_at(files, zones, number, limit), sum(z.rows for z in zones)

    # -- writing --

    def begin(self, spark: SparkSession, writer: str, number: int) -> "Transaction":
        return Transaction(self, spark, writer, number)

    def append(self, df: DataFrame, table: str, key: str) -> None:
        """Add rows outside a stream (holds, anchors, export runs), once per ``key``.

        A repeated call with the same key adds nothing.
        """
        with self.begin(df.sparkSession, f"{table}/{hashlib.sha256(key.encode()).hexdigest()[:32]}", 0) as tx:
            tx.write(df, table)

    def write_batch(self, df: DataFrame, table: str, batch: int, writer: str | None = None) -> None:
        """Add a numbered batch to one table; numbers rise, and a repeated one adds nothing."""
        with self.begin(df.sparkSession, writer or table, batch) as tx:
            tx.write(df, table)

    # -- upkeep --

    def compact(
        self, spark: SparkSession, table: str, small_bytes: int = SMALL_BYTES, least: int = 2,
        reduce: Callable[[DataFrame], DataFrame] | None = None,
    ) -> bool:
        """Merge the table's folders below ``small_bytes`` into one; False if there are fewer than ``least``.

        The rows stay the same unless ``reduce`` drops some.  Files of earlier snapshots stay
        until :meth:`clean`.
        """
        state = self.log.state()
        small = [f for f in state.folders(table) if f.bytes < small_bytes]
        if len(small) < least:
            return False
        rows = self._rows(spark, table, small)
        files = max(1, sum(f.bytes for f in small) // small_bytes)
        rows = rows.repartitionByRange(files, "event_date", "ts") if table == "audit_events" else rows.coalesce(files)
        with self.begin(spark, f"compact/{table}", state.version) as tx:
            tx.write(reduce(rows) if reduce else rows, table, rewrites=small, facts=small[-1].facts)
        return True

    def clean(self, keep_versions: int = 100) -> int:
        """Delete folders that none of the last ``keep_versions`` versions has, and their log.

        Call it while no batch is being written: folders not yet committed count as left over.
        """
        latest = self.log.latest()
        first = max(0, latest - keep_versions)
        state = self.log.state(first) if latest >= 0 else State()
        kept = set(state.live)
        for commit in self.log.commits_after(first, latest):
            kept |= {row["path"] for row in commit["add"]}
        removed = 0
        for table in folders_in(self.root):
            if table.startswith(("_", ".")):
                continue
            for batch in folders_in(self.path(table)):
                for attempt in folders_in(f"{self.path(table)}/{batch}"):
                    if f"{table}/{batch}/{attempt}" not in kept:
                        delete_folder(f"{self.path(table)}/{batch}/{attempt}")
                        removed += 1
        commits, checkpoints = self.log._versions()
        anchor = max([c for c in checkpoints if c <= first], default=-1)
        for version in [c for c in commits if c <= anchor]:
            delete_file(f"{self.log.path}/{version:020d}.json")
        for version in [c for c in checkpoints if c < anchor]:
            delete_file(f"{self.log.path}/{version:020d}.checkpoint.json")
        return removed


@dataclass
class Transaction:
    """Writes to any number of tables that become visible together.

    Leaving a ``with`` block commits; an exception in it leaves the store as it was.  If the
    writer has committed ``number`` before, ``done`` is true, and writes and commit do nothing.
    """

    store: Store
    spark: SparkSession
    writer: str
    number: int
    added: list[Folder] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.state = self.store.log.state()
        self.done = self.state.writers.get(self.writer, -1) >= self.number

    def write(self, df: DataFrame, table: str, rewrites: list[Folder] | None = None, facts: dict | None = None) -> Folder | None:
        """Write rows into a folder of their own; with ``rewrites`` it replaces those folders."""
        if self.done:
            return None
        if table in SCHEMAS:
            df = df.select(*SCHEMAS[table].names)
        if table == "audit_events":
            # Time order inside each file keeps row-group bounds on ts tight.
            df = df.sortWithinPartitions("event_date", "ts", "id")
        writer = df.write
        if table == "audit_events":
            writer = writer.partitionBy("event_date")
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            for column in _BLOOM:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        elif "bucket" in df.columns and table not in SCHEMAS:
            writer = writer.partitionBy("bucket")
        path = f"{table}/ingest_batch={self.number}/attempt={uuid.uuid4().hex[:12]}"
        target = f"{self.store.root.rstrip('/')}/{path}"
        writer.parquet(target)
        files = data_files(target)
        if files and max(size for _, size in files) < _EMPTY_BYTES and not rows_in([f"{target}/{name}" for name, _ in files]):
            files = []
        if rewrites:
            self.removed += [f.path for f in rewrites]
        if not files:
            return None
        if table == "audit_events":
            facts = (facts or {}) | {"zones": _zones(self.store.open(self.spark, table, [path], SCHEMAS[table]))}
        folder = Folder(
            table, path, self.number, len(files), sum(size for _, size in files),
            max((f.version for f in rewrites or []), default=0), bool(rewrites), facts or {},
        )
        self.added.append(folder)
        return folder

    def read(self, table: str) -> DataFrame:
        """The rows this transaction has written to a table."""
        return self.store._rows(self.spark, table, [f for f in self.added if f.table == table])

    def remove(self, folders: list[Folder]) -> None:
        self.removed += [f.path for f in folders]

    def commit(self) -> State | None:
        if self.done or not (self.added or self.removed):
            return None
        self.done = True
        return self.store.log.append(self.writer, self.number, self.added, self.removed)

    def __enter__(self) -> "Transaction":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()


def _zones(written: DataFrame) -> list[list]:
    """(file, rows, first, last) of each data file just written, by (ts, id); reads these columns only."""
    key = F.struct(F.unix_micros("ts").alias("us"), "id")
    rows = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")
    )
    return [[r["path"].split("/attempt=", 1)[1].split("/", 1)[1], r["n"], list(r["first"]), list(r["last"])] for r in rows.collect()]


def scratch_store(spark: SparkSession, name: str) -> Store:
    """A new store in the session's shared folder."""
    return Store(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")


def recent(df: DataFrame, order: str, limit: int = 100) -> DataFrame:
    """Newest rows first; ``limit`` <= 0 returns all of them."""
    ordered = df.orderBy(F.desc(order))
    return ordered.limit(limit) if limit > 0 else ordered


def fetch_payloads(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Add ``body`` to each event and ``payload_found``; NULL body if nothing is stored.

    Events without a payload all share the empty reference; they skip the join, where
    that one key would gather them in one task.
    """
    with_ref = events.where(F.col("payload_ref") != "")
    joined = with_ref.join(payloads.select("payload_ref", "body"), "payload_ref", "left")
    without = events.where(F.coalesce(F.col("payload_ref") == "", F.lit(True)))
    both = joined.unionByName(without.withColumn("body", F.lit(None).cast("binary")))
    return both.withColumn("payload_found", F.col("body").isNotNull())
