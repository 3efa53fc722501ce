import hashlib
import json
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE
from sealtrail.operators.anchor import hmac_signer, make_anchors
from sealtrail.operators.chain import OK, verify_chain
from sealtrail.operators.sweep import sweep
from sealtrail.operators.ingest import decode
from sealtrail.operators.metrics import latency_at
from sealtrail.schema import WIRE
from sealtrail.sources.tables import Store, Transaction, recent
from sealtrail.sources.wire import from_text, read_wire
from sealtrail.streaming.anchors import anchor_stream, read_events
from sealtrail.streaming.committed import drained
from sealtrail.streaming.progress import ProgressTable
from sealtrail.streaming.ingest import IngestConfig, ingest_batch, start_ingest


def message(i, ts=None, **changes):
    payload = json.dumps({"ssn": f"123-45-{i:04d}"})
    members = {
        "id": f"e{i:04d}", "ts": (ts or BASE + timedelta(seconds=40 * i)).isoformat().replace("+00:00", "Z"),
        "source_service": "desk", "actor_id": "clerk", "action": "signed", "target_type": "form", "target_id": "12",
        "payload_hash": "sha256:" + hashlib.sha256(payload.encode()).hexdigest(), **changes,
    }
    return (json.dumps(members)[:-1] + ', "payload": ' + payload + "}").encode()


def put(spark, folder, values, offset=0):
    rows = [("audit.v1", 0, offset + i, b"k", v, BASE + timedelta(seconds=i)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, WIRE).coalesce(1).write.mode("append").parquet(str(folder))


CONFIG = IngestConfig(clock=lambda: BASE)


def run(spark, folder, store, checkpoint, **options):
    query = start_ingest(read_wire(spark, str(folder), streaming=True), store, str(checkpoint), options.pop("config", CONFIG), **options)
    query.awaitTermination()
    return query


def table(spark, store, name):
    return store.read(spark, name)


@pytest.fixture
def place(tmp_path):
    return tmp_path / "wire", Store(str(tmp_path / "store")), tmp_path / "checkpoint"


def test_batches_build_one_verifiable_store(spark, place):
    folder, store, checkpoint = place
    put(spark, folder, [message(i) for i in range(100)] + [b"not json", message(3), message(7, actor_id="")])
    query = run(spark, folder, store, checkpoint)
    progress = query.lastProgress["observedMetrics"]["ingest"]
    put(spark, folder, [message(i) for i in range(90, 160)], offset=200)
    run(spark, folder, store, checkpoint)
    events = table(spark, store, "audit_events")
    assert events.count() == events.select("id").distinct().count() == 160
    assert {r["status"]: r["count"] for r in verify_chain(events).groupBy("status").count().collect()} == {OK: 160}
    assert sweep(events).first()["status"] == "ok"
    # The second batch continued the open hour instead of starting a late segment.
    assert events.where("seg LIKE 'late%'").count() == 0
    assert events.groupBy("seg").agg(F.max("pos").alias("p"), F.count("*").alias("n")).where("p <> n").count() == 0
    letters = table(spark, store, "dead_letter")
    assert sorted(r["reason"] for r in letters.collect()) == [
        "decode: event: decode: malformed envelope", "decode: event: invalid: missing actor_id"]
    assert bytes(recent(letters, "rejected_at", 0).where("reason LIKE '%malformed%'").first()["payload"]) == b"not json"
    payloads = table(spark, store, "payloads")
    assert payloads.count() == 160 and payloads.select("payload_ref").distinct().count() == 160
    assert progress["messages"] == 103 and progress["undecodable"] == 1


def test_late_events_get_segments_of_their_own(spark, place):
    folder, store, checkpoint = place
    put(spark, folder, [message(i) for i in range(0, 50, 2)])
    run(spark, folder, store, checkpoint)
    put(spark, folder, [message(i) for i in range(1, 50, 2)], offset=100)
    run(spark, folder, store, checkpoint)
    events = table(spark, store, "audit_events")
    assert events.count() == 50
    # e0049 is later than the head and extends it; the others arrived too late.
    assert events.where("seg LIKE 'late-%'").count() == 24
    assert verify_chain(events).where("status <> 'ok'").count() == 0


def test_a_repeated_batch_changes_nothing(spark, place, tmp_path):
    folder, store, _ = place
    put(spark, folder, [message(i) for i in range(30)] + [b"{"])
    decoded = decode(read_wire(spark, str(folder)))
    ingest_batch(decoded.where("offset < 20"), 0, store, CONFIG)
    ingest_batch(decoded, 1, store, CONFIG)

    def state():
        return [sorted(map(str, table(spark, store, t).collect())) for t in ("audit_events", "payloads", "dead_letter", "heads")]

    once = state()
    ingest_batch(decoded, 1, store, CONFIG)
    assert state() == once
    assert len(once[0]) == 30 and len(once[2]) == 1


def test_a_failing_sink_fails_the_batch_and_a_replay_completes_it(spark, place, monkeypatch):
    folder, store, _ = place
    put(spark, folder, [message(i) for i in range(20)])
    decoded = decode(read_wire(spark, str(folder)))
    ingest_batch(decoded.where("offset < 5"), 0, store, CONFIG)
    write = Transaction.write

    def failing(self, df, name, **more):
        seen = {t: table(spark, store, t).count() for t in ("audit_events", "payloads", "dead_letter", "heads")}
        assert seen == {"audit_events": 5, "payloads": 5, "dead_letter": 0, "heads": 1}
        if name == "heads":
            write(self, df, name, **more)
            raise OSError("disk")
        return write(self, df, name, **more)

    monkeypatch.setattr(Transaction, "write", failing)
    with pytest.raises(OSError):
        ingest_batch(decoded, 1, store, CONFIG)
    # a reader sees nothing of the failed batch, neither does the index of ids
    assert table(spark, store, "audit_events").count() == table(spark, store, "payloads").count() == 5
    monkeypatch.setattr(Transaction, "write", write)
    ingest_batch(decoded, 1, store, CONFIG)
    assert table(spark, store, "audit_events").count() == table(spark, store, "payloads").count() == 20
    assert store.clean(keep_versions=0) > 0  # the failed attempt's files
    assert table(spark, store, "audit_events").count() == 20


def test_policy_is_reloaded_per_batch(spark, place, tmp_path):
    folder, store, checkpoint = place
    policy = tmp_path / "policy.yaml"
    config = IngestConfig(policy_path=str(policy), clock=lambda: BASE)
    put(spark, folder, [message(0)])
    run(spark, folder, store, checkpoint, config=config)
    policy.write_text('- service: "*"\n  action: "*"\n  fields:\n    ssn: mask\n')
    put(spark, folder, [message(1)], offset=9)
    run(spark, folder, store, checkpoint, config=config)
    got = {r["id"]: r["redacted"] for r in table(spark, store, "audit_events").collect()}
    assert got == {"e0000": False, "e0001": True}
    bodies = {r["payload_ref"]: bytes(r["body"]) for r in table(spark, store, "payloads").collect()}
    assert bodies["e0001"] == b'{"ssn":"1*********1"}'
    assert sweep(table(spark, store, "audit_events")).first()["status"] == "ok"


@pytest.mark.parametrize("options", [{"watermark": "1 hour"}, {"config": IngestConfig(duplicates_share_ts=True, clock=lambda: BASE)}])
def test_duplicate_options_give_the_same_events(spark, place, options):
    folder, store, checkpoint = place
    put(spark, folder, [message(1), message(2), message(1), b"x", b"y"])
    run(spark, folder, store, checkpoint, **options)
    put(spark, folder, [message(2), message(3)], offset=50)
    run(spark, folder, store, checkpoint, **options)
    assert sorted(r["id"] for r in table(spark, store, "audit_events").collect()) == ["e0001", "e0002", "e0003"]
    assert table(spark, store, "dead_letter").count() == 2


def test_anchor_stream_equals_its_batch_twin(spark, place):
    folder, store, checkpoint = place
    put(spark, folder, [message(i) for i in range(300)])
    run(spark, folder, store, checkpoint)
    signer = hmac_signer(b"k", "key-1")
    anchors = anchor_stream(read_events(spark, store), "10 minutes", signer=signer)
    drained(anchors.writeStream.format("memory").queryName("anchors_out").outputMode("append").start())
    streamed = {tuple(r) for r in spark.table("anchors_out").collect()}
    batch = {tuple(r) for r in make_anchors(table(spark, store, "audit_events"), signer=signer).collect()}
    # The newest window stays open until the watermark passes it.
    assert streamed and streamed < batch and len(batch) - len(streamed) == 1


def test_committed_rows_stream_once(spark, place, tmp_path, monkeypatch):
    """After a failed batch, its repetition and a compaction, every event is streamed and anchored once."""
    folder, store, _ = place
    put(spark, folder, [message(i) for i in range(60)])
    decoded = decode(read_wire(spark, str(folder)))
    checkpoint = str(tmp_path / "events-checkpoint")

    def stream():
        events = read_events(spark, store).select("id", "event_date", "ts")
        out = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint)
        out.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    ingest_batch(decoded.where("offset < 20"), 0, store, CONFIG)
    assert stream().count() == 20
    monkeypatch.setattr(Transaction, "commit", lambda self: (_ for _ in ()).throw(OSError("lost driver")))
    with pytest.raises(OSError):
        ingest_batch(decoded.where("offset < 40"), 1, store, CONFIG)
    assert stream().count() == 20
    monkeypatch.undo()
    ingest_batch(decoded.where("offset < 40"), 1, store, CONFIG)
    ingest_batch(decoded.where("offset < 40"), 1, store, CONFIG)
    assert store.compact(spark, "audit_events")
    ingest_batch(decoded, 2, store, CONFIG)
    streamed = stream()
    assert streamed.count() == streamed.select("id").distinct().count() == 60
    kept = table(spark, store, "audit_events").select("id", "event_date", "ts")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, kept.collect()))


def test_text_lines_are_messages(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes(message(1) + b"\n" + b"junk\n")
    wire = from_text(spark.read.text(str(path)))
    rows = decode(wire).orderBy("offset").collect()
    assert [r["id"] for r in rows] == ["e0001", None] and wire.columns == WIRE.names


def test_progress_is_kept_once_per_batch(spark, place):
    folder, store, checkpoint = place
    listener = ProgressTable(spark, store)
    spark.streams.addListener(listener)
    try:
        put(spark, folder, [message(i) for i in range(30)] + [b"x", message(3)])
        run(spark, folder, store, checkpoint, watermark="1 hour")
        put(spark, folder, [message(i) for i in range(25, 40)], offset=100)
        query = run(spark, folder, store, checkpoint, watermark="1 hour")
        for _ in range(100):  # the listener runs behind the query
            rows = {r["batch"]: r for r in table(spark, store, "progress").where(F.col("query") == str(query.id)).collect()}
            if sum(r["rows_in"] for r in rows.values()) == 47:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["rows_in"] for r in rows.values()) == 47 and sum(r["messages"] or 0 for r in rows.values()) == 47
    assert any(r["watermark"] is not None and r["lag_ms"] is not None for r in rows.values()) and all(r["duration_ms"] > 0 for r in rows.values())
    again = table(spark, store, "progress").count()
    listener.store.write_batch(table(spark, store, "progress").limit(1), "progress", 0, f"progress/{query.id}")
    assert table(spark, store, "progress").count() == again
    batches = table(spark, store, "batches").agg(*[F.sum(c) for c in ("messages", "rejected", "duplicates", "ingested")]).first()
    assert tuple(batches) == (41, 1, 0, 40)  # copies within the watermark are dropped by the stream
    sketches = table(spark, store, "latency")
    assert latency_at(sketches, 0.5).first()["n"] == 40
    us = [int((BASE - (BASE + timedelta(seconds=i))).total_seconds() * 1e6) for i in range(30)]
    assert latency_at(sketches, 0.0).first()["latency_us"] == min(us)
