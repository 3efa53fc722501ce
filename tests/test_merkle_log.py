"""The growing Merkle tree against the flat one, and its proofs."""

import hashlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE
from sealtrail.operators import merkle_log as M
from sealtrail.operators.merkle import merkle_root
from sealtrail.sources.tables import Store


def leaves(spark, start, count):
    rows = [(BASE + timedelta(seconds=i), f"e{i:05d}", hashlib.sha256(b"%d" % i).digest()) for i in range(start, start + count)]
    return spark.createDataFrame(rows, "ts timestamp, id string, this_hash binary")


def flat_root(hashes):
    while len(hashes) > 1:
        pairs = [hashes[i : i + 2] for i in range(0, len(hashes), 2)]
        hashes = [hashlib.sha256(b"".join(p)).digest() if len(p) == 2 else p[0] for p in pairs]
    return hashes[0] if hashes else bytes(32)


@pytest.fixture
def grown(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_LEVEL", 3)
    monkeypatch.setattr(M, "RANGE_LEVEL", 5)
    store, roots, total = Store(str(tmp_path / "store")), [], 0
    for batch, count in enumerate((1, 46, 0, 148)):
        with store.begin(spark, "tree", batch) as tx:
            peaks = M.append(tx, leaves(spark, total, count))
        total += count
        roots.append((total, M.root_of(peaks)))
    return store, roots


def test_roots_equal_the_flat_tree_after_every_batch(spark, grown):
    store, roots = grown
    for total, root in roots:
        assert root == flat_root([hashlib.sha256(b"%d" % i).digest() for i in range(total)])
    assert M.root_of(M.peaks_of(store.log.state())) == roots[-1][1] == bytes(merkle_root(leaves(spark, 0, 195)).first()["root"])
    nodes = store.open(spark, M.NODES, [f.path for f in store.log.state().folders(M.NODES)], M._NODE)
    assert nodes.count() == nodes.select("level", "first").distinct().count() == sum(195 >> level for level in range(3, 8))


def test_proofs_hold_and_forged_ones_do_not(spark, grown):
    store, roots = grown
    for version, (total, root) in [(0, roots[0]), (1, roots[1]), (3, roots[3])]:
        ids = leaves(spark, 0, 195).select("id")
        found = M.check_proofs(M.proofs(spark, store, ids, version), root).collect()
        assert [r["leaf"] for r in sorted(found)] == list(range(total)) and all(r["holds"] for r in found)
    some = M.proofs(spark, store, leaves(spark, 70, 3).select("id").unionByName(leaves(spark, 900, 1).select("id")))
    assert some.count() == 3 and M.check_proofs(some, roots[-2][1]).where("holds").count() == 0
    forged = some.withColumn("hash", F.when(F.col("leaf") == 71, F.unhex(F.lit("00" * 32))).otherwise(F.col("hash")))
    assert {r["leaf"]: r["holds"] for r in M.check_proofs(forged, roots[-1][1]).collect()} == {70: True, 71: False, 72: True}


def test_a_repeated_batch_appends_nothing(spark, grown):
    store, roots = grown
    with store.begin(spark, "tree", 3) as tx:
        assert M.root_of(M.append(tx, leaves(spark, 500, 9))) == roots[-1][1]
    assert M.leaves_of(M.peaks_of(store.log.state())) == 195


def test_no_leaves(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    with store.begin(spark, "tree", 0) as tx:
        assert M.root_of(M.append(tx, leaves(spark, 0, 0))) == bytes(32)
    assert M.proofs(spark, store, leaves(spark, 0, 3).select("id")).count() == 0
