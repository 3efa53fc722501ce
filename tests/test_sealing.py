"""Watermark sealing in state against the chain built in one batch."""

import hashlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE
from sealtrail.operators.anchor import check_segment_anchors, check_signatures, hmac_signer, hmac_verifier
from sealtrail.operators.chain import build_chain, build_segments, check_sealed, verify_chain
from sealtrail.operators.ingest import decode
from sealtrail.operators.sweep import sweep
from sealtrail.sources.tables import Store
from sealtrail.sources.wire import read_wire
from sealtrail.streaming.anchors import start_anchors
from sealtrail.streaming.committed import drained
from sealtrail.streaming.ingest import IngestConfig, ingest_batch
from sealtrail.streaming.sealing import start_sealing
from test_streaming import message, put

CONFIG = IngestConfig(clock=lambda: BASE, sealing=True)


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"))


def ingest(spark, store, folder, batch, numbers):
    put(spark, folder / f"b{batch}", [message(i) for i in numbers], offset=1000 * batch)
    ingest_batch(decode(read_wire(spark, str(folder / f"b{batch}"))), batch, store, CONFIG)


def seal(spark, store, tmp_path, **options):
    drained(start_sealing(spark, store, str(tmp_path / "sealing"), "20 minutes", clock=lambda: BASE, **options))


def rows(df):
    return sorted(map(str, df.collect()))


def test_events_in_any_order_within_the_delay_equal_one_batch(spark, store, tmp_path):
    # 40 s apart; batches interleave by up to 15 of 20 minutes
    numbers = sorted(range(300), key=lambda i: i + 22 * (int(hashlib.sha256(b"%d" % i).hexdigest(), 16) % 1000) / 1000)
    for batch in range(3):
        ingest(spark, store, tmp_path / "wire", batch, numbers[batch * 100 : batch * 100 + 100])
        if batch == 1:
            ingest_batch(decode(read_wire(spark, str(tmp_path / "wire/b1"))), 1, store, CONFIG)  # again: adds nothing
        seal(spark, store, tmp_path)
    arrivals, chained, sealed = (store.read(spark, t) for t in ("arrivals", "audit_events", "segments"))
    twin = build_chain(arrivals).cache()
    newest = (BASE + timedelta(seconds=40 * 299)).replace(tzinfo=None)
    done = [r["seg"] for r in build_segments(twin).collect() if r["last_ts"] < newest - timedelta(minutes=20)]
    ended = sorted(r["seg"] for r in sealed.collect())
    assert ended and set(ended) <= set(done) and chained.where("seg LIKE 'late-%'").count() == 0
    columns = ["id", "ts", "ts_ns", "payload_hash", "ingested_at", "event_date", "seg", "pos", "prev_hash", "this_hash"]
    links = {str(r) for r in twin.select(*columns).collect()}
    got = rows(chained.select(*columns))
    assert set(got) <= links and len(got) == len(set(got)) >= chained.where(F.col("seg").isin(ended)).count()
    assert rows(build_segments(twin).where(F.col("seg").isin(ended))) == rows(sealed.select("seg", "n", "first_id", "first_ts", "last_id", "last_ts", "root"))
    assert {r["status"] for r in check_sealed(chained, sealed).collect()} == {"ok"}
    assert verify_chain(chained).where("status <> 'ok'").count() == 0
    report = sweep(chained.where(F.col("seg").isin(ended)), sealed=sealed).first()
    assert report["status"] == "ok"


def test_later_events_get_segments_that_anchors_cover(spark, store, tmp_path):
    ingest(spark, store, tmp_path / "wire", 0, [i for i in range(0, 300) if i % 10 != 3])
    seal(spark, store, tmp_path, shards=3)
    first = store.read(spark, "segments").count()
    ingest(spark, store, tmp_path / "wire", 1, [i for i in range(0, 300) if i % 10 == 3] + list(range(300, 320)))
    seal(spark, store, tmp_path, shards=3)
    chained, sealed = store.read(spark, "audit_events"), store.read(spark, "segments")
    late = chained.where("seg LIKE 'late-%'")
    assert late.count() > 0 and sealed.count() > first
    assert late.select("seg").distinct().join(sealed, "seg", "left_anti").count() == 0
    assert chained.select("id").distinct().count() == chained.count()
    assert {r["status"] for r in check_sealed(chained, sealed).collect()} == {"ok"}
    signer = hmac_signer(b"key", "k1")
    for _ in range(2):
        drained(start_anchors(spark, store, str(tmp_path / "anchors"), signer))
    anchors = store.read(spark, "anchors")
    assert anchors.count() == sealed.select("sealed_at").distinct().count()
    assert anchors.agg(F.sum("event_count")).first()[0] == sealed.agg(F.sum("n")).first()[0]
    assert {r["signature_ok"] for r in check_signatures(anchors, hmac_verifier({"k1": b"key"})).collect()} == {True}
    ended = chained.join(sealed.select("seg"), "seg", "left_semi")
    assert {r["mismatch"] for r in check_segment_anchors(anchors, ended, sealed).collect()} == {False}
    lost = late.agg(F.min("seg")).first()[0]
    found = check_segment_anchors(anchors, ended.where(F.col("seg") != lost), sealed)
    assert found.where("mismatch").count() >= 1
