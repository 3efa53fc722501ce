"""A levelled index of stored ids: which ids of a batch a store has, without reading the store.

Every batch adds one *run*: its ids in the order of their 64-bit hashes, cut into buckets by the
leading bits, and a blocked Bloom filter beside them.  Runs of one level have one shape; as soon
as ``fanout`` of them exist they are merged into one run, whose size decides its level.  There are
therefore at most fanout x levels runs, and each id is rewritten once per level.

A probe first meets the filters, narrow rows of 256 bits for about twenty ids each, of the buckets
that its own ids fall into.  Only buckets of runs in which a filter says "perhaps" are opened then,
and the ids themselves are compared.  For a batch of new ids that is next to nothing, however
large the store is.

Runs and filters are tables of the store, so they are committed with the batch they index.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sealtrail.schema import flat
from sealtrail.sources.commits import Folder, State
from sealtrail.sources.files import data_files
from sealtrail.sources.tables import Store, Transaction

RUNS, FILTERS = "id_runs", "id_filters"

_RUN = flat("h BIGINT, id STRING, bucket INT")
_FILTER = flat("block INT, w0 BIGINT, w1 BIGINT, w2 BIGINT, w3 BIGINT, bucket INT")
_WORDS = ("w0", "w1", "w2", "w3")

# Ids for which a block of 256 bits is meant (as a power of two), and how many of its bits each sets.
_IDS_PER_BLOCK_BITS, _PROBES = 4, 5
# Candidates of one probe that may pass through the driver.
_MOST_HITS = 100_000


@dataclass(frozen=True)
class IdIndex:
    """``first_bits``: ids of a level-0 run, as a power of two; ``bucket_bits``: of a bucket."""

    store: Store
    first_bits: int = 12
    fanout_bits: int = 3
    bucket_bits: int = 20

    # -- shapes --

    def _level(self, rows: int) -> int:
        level = 0
        while rows > 1 << (self.first_bits + level * self.fanout_bits):
            level += 1
        return level

    def _bits(self, level: int) -> tuple[int, int]:
        """(bits of the bucket number, bits of the block number within a bucket)."""
        ids = self.first_bits + level * self.fanout_bits
        buckets = max(0, ids - self.bucket_bits)
        return buckets, max(0, ids - buckets - _IDS_PER_BLOCK_BITS)

    @staticmethod
    def _leading(h: Column, skip: int, bits: int) -> Column:
        if not bits:
            return F.lit(0)
        return F.shiftrightunsigned(F.shiftleft(h, skip), 64 - bits).cast("int")

    def _placed(self, ids: DataFrame, level: int) -> DataFrame:
        buckets, blocks = self._bits(level)
        return ids.withColumns({"bucket": self._leading(F.col("h"), 0, buckets), "block": self._leading(F.col("h"), buckets, blocks)})

    @staticmethod
    def _spots() -> list[Column]:
        """The bits (of 256) that an id sets in its block, from a second hash."""
        mixed = F.xxhash64("h", F.lit("bits"))
        return [F.shiftright(mixed, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(_PROBES)]

    @classmethod
    def _masks(cls) -> dict[str, Column]:
        """The bits an id sets in the four words of its block."""
        out = {}
        for n, word in enumerate(_WORDS):
            own = [F.when(F.shiftright(s, 6) == n, F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))
                   for s in cls._spots()]
            out[word] = reduce(lambda a, b: a.bitwiseOR(b), own)
        return out

    @classmethod
    def _fits(cls) -> Column:
        """Whether the words of its block have all bits of an id; computed behind the join, so that no masks are shuffled."""
        tests = []
        for s in cls._spots():
            word = F.element_at(F.array(*_WORDS), F.shiftright(s, 6) + 1)
            tests.append(F.call_function("shiftright", word, s.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1)
        return reduce(lambda a, b: a & b, tests)

    # -- runs --

    def _write(self, tx: Transaction, ids: DataFrame, rows: int, replaced: Iterable[Folder] = ()) -> None:
        """Add a run of ``rows`` distinct (h, id) and its filter."""
        level = self._level(rows)
        buckets, _ = self._bits(level)
        placed = self._placed(ids, level)
        ordered = placed.select("h", "id", "bucket")
        ordered = ordered.repartitionByRange(1 << buckets, "h") if buckets else ordered.coalesce(1)
        run = tx.write(ordered.sortWithinPartitions("bucket", "h"), RUNS, facts={"level": level, "rows": rows})
        if run is not None:
            masks = placed.select("bucket", "block", *[m.alias(w) for w, m in self._masks().items()])
            filters = masks.groupBy("bucket", "block").agg(*[F.bit_or(w).alias(w) for w in _WORDS])
            filters = filters.repartitionByRange(1 << buckets, "bucket", "block") if buckets else filters.coalesce(1)
            kept = tx.write(filters.sortWithinPartitions("bucket", "block"), FILTERS, facts={"level": level, "run": run.path})
            there = {int(name.split("bucket=")[1].split("/")[0]) for name, _ in data_files(f"{self.store.root.rstrip('/')}/{kept.path}")}
            kept.facts["empty"] = sorted(set(range(1 << buckets)) - there)
        tx.remove(list(replaced))

    def add(self, tx: Transaction, ids: DataFrame) -> None:
        """Index the ids (column ``id``, distinct) that a transaction stores."""
        if tx.done:
            return
        hashed = ids.select(F.xxhash64("id").alias("h"), "id")
        rows = hashed.count()
        if rows:
            self._write(tx, hashed, rows)

    def merge(self, spark: SparkSession) -> int:
        """Merge levels that have too many runs, each in a commit of its own; the number of merges."""
        merges = 0
        while True:
            state = self.store.log.state()
            levels: dict[int, list[Folder]] = {}
            for run in state.folders(RUNS):
                levels.setdefault(run.facts["level"], []).append(run)
            full = [runs for _, runs in sorted(levels.items()) if len(runs) >= 1 << self.fanout_bits]
            if not full:
                return merges
            runs = full[0]
            paths = {r.path for r in runs}
            filters = [f for f in state.folders(FILTERS) if f.facts["run"] in paths]
            ids = self.store.open(spark, RUNS, sorted(paths), _RUN).select("h", "id")
            with self.store.begin(spark, "compact/ids", state.version) as tx:
                self._write(tx, ids, sum(r.facts["rows"] for r in runs), [*runs, *filters])
            merges += 1

    # -- probes --

    def known(self, ids: DataFrame, state: State | None = None) -> DataFrame:
        """Those of ``ids`` (column ``id``) that the index has, each once.

        The filters are asked by hashes alone, which are kept for all levels; the ids move
        once, to be compared with those of the opened buckets, or not at all if few are found.
        """
        spark = ids.sparkSession
        state = self.store.log.state() if state is None else state
        asked = ids.where("id IS NOT NULL").select("id")
        levels = sorted({f.facts["level"] for f in state.folders(FILTERS)})
        if not levels:
            return asked.limit(0)
        hashes = asked.select(F.xxhash64("id").alias("h")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        hits = reduce(DataFrame.unionByName, [self._perhaps(spark, hashes, state, level) for level in levels])
        hits = hits.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            where = hits.groupBy("level", "run", "bucket").agg(F.count("*").alias("n")).collect()  # buckets of runs, not ids
            few = hits.select("h").toArrow() if sum(r["n"] for r in where) <= _MOST_HITS else None
        finally:
            hits.unpersist()
            hashes.unpersist()
        runs = {f.path.rsplit("=", 1)[1]: f for f in state.folders(RUNS)}
        opened = [(r["level"], f"{runs[r['run']].path}/bucket={r['bucket']}") for r in where]
        found = self.store.open(spark, RUNS, sorted(path for _, path in opened), _RUN).select("h", "id")
        if few is None:
            return found.select("id").join(asked.distinct(), "id", "left_semi").distinct()
        found = found.join(F.broadcast(spark.createDataFrame(few, "h long")), "h", "left_semi")
        return asked.join(F.broadcast(found.select("id")), "id", "left_semi").distinct()

    def _perhaps(self, spark: SparkSession, hashes: DataFrame, state: State, level: int) -> DataFrame:
        """(h, level, run, bucket): hashes that a filter of the level does not rule out."""
        buckets, _ = self._bits(level)
        placed = self._placed(hashes, level)
        folders = [f for f in state.folders(FILTERS) if f.facts["level"] == level]
        paths = [f.path for f in folders]
        if buckets:
            touched = {r[0] for r in placed.select("bucket").distinct().collect()}  # at most 2^buckets numbers
            if len(touched) < 1 << buckets:
                paths = [f"{f.path}/bucket={b}" for f in folders for b in sorted(touched - set(f.facts["empty"]))]
        shape = T.StructType(_FILTER.fields + [T.StructField("attempt", T.StringType())])
        filters = self.store.open(spark, FILTERS, paths, shape)
        runs = spark.createDataFrame(
            [(f.path.rsplit("=", 1)[1], f.facts["run"].rsplit("=", 1)[1]) for f in folders], "attempt string, run string"
        )
        met = filters.join(F.broadcast(runs), "attempt").join(placed, ["bucket", "block"])  # a row per folder of the level
        return met.where(self._fits()).select("h", F.lit(level).alias("level"), "run", "bucket")
