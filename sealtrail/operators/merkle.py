"""Merkle roots over events in (ts, id) order.

Leaves are numbered from 0.  A block of consecutive leaves folds to the few largest
complete subtrees it contains; those nodes, far fewer than the leaves, are folded again
per aligned range, and once more into the root.  The result equals pairing all hashes
level by level, an odd last one moving up unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sealtrail.functions.hashing import zero_hash
from sealtrail.plans.ordering import BLOCK, ORDER, block_starts, with_blocks

# Nodes are combined per aligned range of 2**RANGE_LEVEL leaves.
RANGE_LEVEL = 26

_NODE = "level INT, first BIGINT, hash BINARY"


def _pair(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()


def push(stack: list, level: int, first: int, digest: bytes) -> None:
    """Add the next node in order and merge completed sibling pairs."""
    while stack:
        top_level, top_first, top_digest = stack[-1]
        size = 1 << level
        if top_level != level or top_first + size != first or top_first & size:
            break
        stack.pop()
        level, first, digest = level + 1, top_first, _pair(top_digest, digest)
    stack.append((level, first, digest))


def close(stack: list) -> bytes:
    """Root over the right edge: smaller trees move up until they meet a left sibling."""
    root = stack[-1][2]
    for _, _, left in reversed(stack[:-1]):
        root = _pair(left, root)
    return root


def _nodes(stack: list) -> pa.RecordBatch:
    levels, firsts, hashes = zip(*stack)
    return pa.RecordBatch.from_arrays(
        [pa.array(levels, pa.int32()), pa.array(firsts, pa.int64()), pa.array(hashes, pa.binary())],
        names=["level", "first", "hash"],
    )


def _fold_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and order -> the largest complete subtrees of each block."""
    block, stack, leaf = None, [], 0
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(4))
        for bucket, sub, start, digest in zip(*columns):
            if (bucket, sub) != block:
                if stack:
                    yield _nodes(stack)
                block, stack, leaf = (bucket, sub), [], start
            push(stack, 0, leaf, digest)
            leaf += 1
    if stack:
        yield _nodes(stack)


def _fold_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by first leaf -> the largest complete subtrees of each aligned range."""
    current, stack = None, []
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for level, first, digest in zip(*columns):
            if first >> RANGE_LEVEL != current:
                if stack:
                    yield _nodes(stack)
                current, stack = first >> RANGE_LEVEL, []
            push(stack, level, first, digest)
    if stack:
        yield _nodes(stack)


def _fold_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list = []
    for batch in batches:
        for level, first, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
            push(stack, level, first, digest)
    if stack:
        yield pa.RecordBatch.from_arrays([pa.array([close(stack)], pa.binary())], names=["root"])


def merkle_root(df: DataFrame, leaf: str = "this_hash", **blocks) -> DataFrame:
    """One row: ``leaves`` and ``root`` (the zero hash if there are none)."""
    narrow = df.select(*ORDER, F.col(leaf).alias("_leaf"))
    blocked = with_blocks(narrow, **blocks)
    starts = block_starts(blocked)
    nodes = (
        blocked.repartition(*BLOCK)
        .join(starts.drop("n"), list(BLOCK))
        .sortWithinPartitions(*BLOCK, *ORDER)
        .select(*BLOCK, "start", "_leaf")
        .mapInArrow(_fold_leaves, _NODE)
    )
    ranges = (
        nodes.repartition(F.shiftright("first", RANGE_LEVEL))
        .sortWithinPartitions(F.shiftright("first", RANGE_LEVEL), "first")
        .mapInArrow(_fold_ranges, _NODE)
    )
    root = ranges.repartition(1).sortWithinPartitions("first").mapInArrow(_fold_root, "root BINARY")
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("leaves"))
    # Two one-row sides.
    return total.join(F.broadcast(root), F.lit(True), "left").select(
        "leaves", F.coalesce("root", zero_hash()).alias("root")
    )
