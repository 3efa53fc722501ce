import hashlib
import random

import pytest

from helpers import ZERO, events, flat_merkle
from sealtrail.operators import merkle as m


def leaf(i):
    return hashlib.sha256(str(i).encode()).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 100, 1023, 1024, 1025])
def test_folding_in_pieces_equals_the_flat_tree(n):
    leaves = [leaf(i) for i in range(n)]
    rng = random.Random(n)
    nodes, at = [], 0
    while at < n:
        size = rng.randint(1, max(1, n // 3))
        stack = []
        for i in range(at, min(n, at + size)):
            m.push(stack, 0, i, leaves[i])
        nodes += stack
        at += size
    stack = []
    for node in nodes:
        m.push(stack, *node)
    assert m.close(stack) == flat_merkle(leaves)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 257])
def test_root_of_a_frame(spark, n):
    df = events(spark, n)
    row = m.merkle_root(df, leaf="payload_hash", max_rows=20).first()
    want = flat_merkle([b"body-digest"] * n) if n else ZERO
    assert (row["leaves"], bytes(row["root"])) == (n, want)


def test_ranges_are_combined(spark, monkeypatch):
    monkeypatch.setattr(m, "RANGE_LEVEL", 4)
    df = events(spark, 101)
    want = flat_merkle([b"body-digest"] * 101)
    assert bytes(m.merkle_root(df, leaf="payload_hash", max_rows=7).first()["root"]) == want
