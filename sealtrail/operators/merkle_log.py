"""A Merkle tree that only grows: appended batch by batch, with proofs of inclusion.

The first n leaves are a mountain range of complete subtrees, at most one of each size.  Their
roots, the *peaks*, travel in the store's log, so the root of the whole tree follows without
reading any table, and a batch of new leaves is folded beside the peaks it joins, whatever is
stored already.  Subtrees of ``BLOCK_LEVEL`` and above are stored as they become complete; what is
below is made again from one block of leaves.

A proof is the list of hashes beside a leaf's way to the root.  It is checked against a root and
nothing else.  Root and proofs are those of the flat tree over the same leaves (see
:mod:`sealtrail.operators.merkle`): pairs level by level, an odd last hash moving up unchanged.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sealtrail.operators.merkle import close
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.plans.ordering import with_position
from sealtrail.schema import flat
from sealtrail.sources.commits import State
from sealtrail.sources.scratch import stored
from sealtrail.sources.tables import Store, Transaction

LEAVES, NODES = "merkle_leaves", "merkle_nodes"

# Leaves of a block that a proof reads, and of a range that one task folds, as powers of two.
BLOCK_LEVEL = 10
RANGE_LEVEL = 20
_WHOLE = 62

_LEAF = flat("leaf BIGINT, id STRING, hash BINARY")
_NODE = flat("level INT, first BIGINT, hash BINARY")
_PATH = "array<struct<left: boolean, hash: binary>>"

Peak = tuple[int, int, bytes]  # level, first leaf, hash


def _pair(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()


def peaks_of(state: State) -> list[Peak]:
    """The peaks in a state of the store's log, largest first."""
    folders = state.folders(LEAVES)
    return [(level, first, bytes.fromhex(text)) for level, first, text in folders[-1].facts["peaks"]] if folders else []


def leaves_of(peaks: list[Peak]) -> int:
    return sum(1 << level for level, _, _ in peaks)


def root_of(peaks: list[Peak]) -> bytes:
    """The root over the peaks; the zero hash without leaves."""
    return close(list(peaks)) if peaks else bytes(32)


# -- appending --


def _push(stack: list[Peak], node: Peak, made: list[Peak], keep: int) -> None:
    """Add the next node in order; subtrees of level ``keep`` and above that it completes go to ``made``."""
    level, first, digest = node
    while stack and stack[-1][0] == level and stack[-1][1] == first - (1 << level) and (first >> level) & 1:
        _, first, left = stack.pop()
        level, digest = level + 1, _pair(left, digest)
        if level >= keep:
            made.append((level, first, digest))
    stack.append((level, first, digest))


_FOLDED = flat("level INT, first BIGINT, hash BINARY, open BOOLEAN")


def _folded_batch(nodes: list[Peak], open_: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([n[0] for n in nodes], pa.int32()), pa.array([n[1] for n in nodes], pa.int64()),
            pa.array([n[2] for n in nodes], pa.binary()), pa.array([open_] * len(nodes), pa.bool_()),
        ],
        names=_FOLDED.names,
    )


def _fold_up(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes folded within each aligned range of 2^span leaves.

    Rows that are ``open`` are the largest subtrees of a range, the others those completed on the way.
    """
    keep = BLOCK_LEVEL

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack, made = None, [], []
        for batch in batches:
            for node in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if node[1] >> span != here:
                    if stack:
                        yield _folded_batch(stack, True)
                    here, stack = node[1] >> span, []
                _push(stack, node, made, keep)
            if made:
                yield _folded_batch(made, False)
                made = []
        if stack:
            yield _folded_batch(stack, True)

    group = F.shiftright("first", span)
    return nodes.repartition(group).sortWithinPartitions(group, "first").mapInArrow(fold, _FOLDED)


def _with(nodes: DataFrame, peaks: list[Peak]) -> DataFrame:
    nodes = nodes.select(*_NODE.names)
    return nodes.unionByName(nodes.sparkSession.createDataFrame(peaks, _NODE)) if peaks else nodes


def append(tx: Transaction, events: DataFrame, leaf: str = "this_hash", **blocks) -> list[Peak]:
    """Add a batch of leaves, in (ts, id) order, behind those stored; gives the new peaks.

    Only the batch is read; leaves, completed subtrees and peaks are committed with ``tx``.
    """
    peaks = peaks_of(tx.state)
    if tx.done:
        return peaks
    placed = with_position(events.select("ts", "id", F.col(leaf).alias("hash")), **blocks)
    leaves = stored(placed.select((F.col("position") - 1 + leaves_of(peaks)).alias("leaf"), "id", "hash"), "leaves")
    nodes = leaves.select(F.lit(0).cast("int").alias("level"), F.col("leaf").alias("first"), "hash")
    made = []
    below = 0
    # the last step sees a few rows per 2^RANGE_LEVEL new leaves
    for span in (BLOCK_LEVEL, RANGE_LEVEL, _WHOLE):
        step = stored(_fold_up(_with(nodes, [p for p in peaks if below <= p[0] < span]), span), "folded")
        made.append(step.where("NOT open"))
        nodes, below = step.where("open"), span
    rows = nodes.collect()  # one node a level at most
    peaks = sorted(((r["level"], r["first"], bytes(r["hash"])) for r in rows), key=lambda p: p[1])
    facts = {"leaves": leaves_of(peaks), "peaks": [(level, first, digest.hex()) for level, first, digest in peaks]}
    tx.write(leaves.repartitionByRange("leaf").sortWithinPartitions("leaf"), LEAVES, facts=facts)
    completed = made[0].unionByName(made[1]).unionByName(made[2]).select(*_NODE.names)
    tx.write(completed.coalesce(1 if leaves_of(peaks) < 1 << RANGE_LEVEL else 8).sortWithinPartitions("level", "first"), NODES)
    return peaks


# -- proofs --


def _tails(peaks: list[Peak]) -> list[tuple[int, int, list[tuple[bool, bytes]]]]:
    """(first leaf, level, hashes beside the way from the peak to the root) of each peak."""
    out, bag = [], None
    for k in range(len(peaks) - 1, -1, -1):
        level, first, digest = peaks[k]
        beside = [] if bag is None else [(False, bag)]
        out.append((first, level, beside + [(True, p[2]) for p in reversed(peaks[:k])]))
        bag = digest if bag is None else _pair(digest, bag)
    return out[::-1]


def _low_paths(near: DataFrame, tails: list) -> DataFrame:
    """(id, leaf, hash, low): hashes beside each asked leaf's way within its block of leaves."""
    starts, span = [t[0] for t in tails], BLOCK_LEVEL

    def one(leaves: list[bytes], block: int, asked: list[tuple[int, str]]) -> pa.RecordBatch:
        levels = [leaves]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([_pair(last[i], last[i + 1]) for i in range(0, len(last) - 1, 2)])
        paths = []
        for at, _ in asked:
            peak = bisect_right(starts, (block << span) + at) - 1
            height = min(tails[peak][1], span)
            paths.append([{"left": bool(at >> k & 1), "hash": levels[k][at >> k ^ 1]} for k in range(height)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for _, i in asked], pa.string()), pa.array([(block << span) + at for at, _ in asked], pa.int64()),
                pa.array([leaves[at] for at, _ in asked], pa.binary()),
                pa.array(paths, pa.list_(pa.struct([("left", pa.bool_()), ("hash", pa.binary())]))),
            ],
            names=["id", "leaf", "hash", "low"],
        )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, leaves, asked = None, [], []
        for batch in batches:
            for leaf, id_, digest, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if leaf >> span != here:
                    if asked:
                        yield one(leaves, here, asked)
                    here, leaves, asked = leaf >> span, [], []
                if wanted:
                    asked.append((len(leaves), id_))
                leaves.append(digest)
        if asked:
            yield one(leaves, here, asked)

    block = F.shiftright("leaf", BLOCK_LEVEL)
    ordered = near.repartition(block).sortWithinPartitions(block, "leaf").select("leaf", "id", "hash", "wanted")
    return ordered.mapInArrow(fold, f"id string, leaf bigint, hash binary, low {_PATH}")


def proofs(spark: SparkSession, store: Store, ids: DataFrame, version: int | None = None) -> DataFrame:
    """(id, leaf, hash, path, leaves): where the listed events (column ``id``) are in the tree, with proofs.

    ``path`` has the hashes beside the way from the leaf up, and whether each goes to the left;
    ``leaves`` is the size of the tree it leads to the root of.  Read are the asked leaves' blocks
    and the stored subtrees beside them.  Events that are no leaves have no row.
    """
    state = store.log.state(version)
    tails = _tails(peaks_of(state))
    all_leaves = store.open(spark, LEAVES, [f.path for f in state.folders(LEAVES)], _LEAF)
    wanted = broadcast_if_small(ids.select("id").distinct().withColumn("wanted", F.lit(True)))
    block = F.shiftright("leaf", BLOCK_LEVEL)
    blocks = stored(all_leaves.join(wanted, "id", "left_semi").select(block.alias("block")).distinct(), "blocks")
    near = all_leaves.withColumn("block", block).join(broadcast_if_small(blocks), "block", "left_semi").join(wanted, "id", "left")
    low = _low_paths(near, tails).withColumn("block", block)

    first = F.shiftleft("block", BLOCK_LEVEL)

    def of_peak(leaf, values):
        chosen = values[0]
        for (start, _, _), value in zip(tails[1:], values[1:]):
            chosen = F.when(leaf >= start, value).otherwise(chosen)
        return chosen

    # above its block a leaf's way is the block's
    nodes = store.open(spark, NODES, [f.path for f in state.folders(NODES)], _NODE)
    height = of_peak(first, [F.lit(t[1]) for t in tails]) if tails else F.lit(0)
    steps = blocks.where(height > BLOCK_LEVEL).select(
        "block", first.alias("leaf"), F.explode(F.sequence(F.lit(BLOCK_LEVEL), height - 1)).alias("level")
    )
    at = F.call_function("shiftright", F.col("leaf"), F.col("level"))
    beside = steps.select(
        "block", "level", (at.bitwiseAND(F.lit(1)) == 1).alias("left"),
        F.call_function("shiftleft", at.bitwiseXOR(F.lit(1).cast("bigint")), F.col("level")).alias("first"),
    )
    high = beside.join(nodes, ["level", "first"]).groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("level", "left", "hash"))), lambda s: F.struct(s["left"].alias("left"), s["hash"].alias("hash"))).alias("high")
    )
    none = F.expr(f"cast(array() as {_PATH})")
    tail = of_peak(F.col("leaf"), [
        F.concat(none, F.array(*[F.struct(F.lit(left).alias("left"), F.lit(digest).alias("hash")) for left, digest in t[2]])) if t[2] else none for t in tails
    ]) if tails else none
    return low.join(high, "block", "left").select(
        "id", "leaf", "hash", F.concat("low", F.coalesce("high", none), tail).alias("path"),
        F.lit(leaves_of(peaks_of(state))).cast("bigint").alias("leaves"),
    )


def check_proofs(found: DataFrame, root: bytes) -> DataFrame:
    """Add ``holds``: the path leads from the row's ``hash`` to ``root``.  No table is read."""
    up = F.aggregate(
        "path", F.col("hash"),
        lambda h, s: F.unhex(F.sha2(F.when(s["left"], F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])), 256)),
    )
    return found.withColumn("holds", F.coalesce(up == F.lit(root), F.lit(False)))
