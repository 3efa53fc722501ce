"""Incremental sweeps report what full ones do and hash little."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE, events
from sealtrail.operators import incremental as I
from sealtrail.operators.anchor import hmac_signer, make_anchors
from sealtrail.operators.chain import build_chain, seal_segments, segment_heads
from sealtrail.operators.sweep import sweep
from sealtrail.sources.tables import Store


@pytest.fixture
def store(spark, tmp_path):
    """Three folders of chained events, the last with late ones."""
    store = Store(str(tmp_path / "store"))
    rows = events(spark, 300, step=timedelta(minutes=5)).withColumn("event_date", F.to_date("ts"))
    number = F.substring("id", 2, 10).cast("int")
    late = number % 29 == 7
    chained = build_chain(rows.where(~late))
    second = build_chain(rows.where(late), heads=segment_heads(chained), batch="000000000002")
    parts = [chained.where(F.dayofmonth("ts") % 2 == 0), chained.where(F.dayofmonth("ts") % 2 == 1), second]
    for batch, part in enumerate(parts):
        part = part.withColumns({"legal_hold_initial": F.lit(False), "ingested_at": F.lit(BASE)})
        store.write_batch(part, "audit_events", batch)
    return store


def at(hours):
    return BASE + timedelta(days=30, hours=hours)


def run(spark, store, hour, **options):
    chained = store.read(spark, "audit_events")
    report, rows = I.sweep_incremental(chained, store.read(spark, "verified_segments"), at(hour), **options)
    report, n = report.first(), rows.count()
    store.append(rows, "verified_segments", f"hour {hour}")
    full = {k: v for k, v in options.items() if k != "every"}
    assert report == sweep(chained, **full).first()
    return report, n


def test_intact_late_and_tampered_stores(spark, store):
    chained = store.read(spark, "audit_events")
    segments = chained.select("seg").distinct().count()
    signer, anchors = hmac_signer(b"k", "k1"), make_anchors(chained)
    options = {"signer": signer, "signed_at": BASE, "anchors": anchors}
    report, n = run(spark, store, 0, **options)
    assert (report["status"], n) == ("ok", segments)
    report, n = run(spark, store, 1, **options)
    assert report["status"] == "ok" and n < segments / 3  # only those whose turn it is
    # more late events arrive: their segments are new, the others stay as they were
    more = events(spark, 20, step=timedelta(minutes=17), prefix="m").withColumn("event_date", F.to_date("ts"))
    more = build_chain(more, heads=segment_heads(chained), batch="000000000009")
    store.write_batch(more.withColumns({"legal_hold_initial": F.lit(False), "ingested_at": F.lit(BASE)}), "audit_events", 3)
    report, again = run(spark, store, 2, **options)
    assert report["status"] == "ok" and report["event_count"] == 320
    assert more.select("seg").distinct().count() <= again < segments / 2
    # a folder is replaced by one with another actor in a row
    folder = store.log.state().folders("audit_events")[1]
    rows = store._rows(spark, "audit_events", [folder])
    victim = rows.agg(F.min("id")).first()[0]
    forged = rows.withColumn("actor_id", F.when(F.col("id") == victim, "x").otherwise(F.col("actor_id")))
    with store.begin(spark, "forger", 0) as tx:
        tx.write(forged, "audit_events", rewrites=[folder])
    report, _ = run(spark, store, 3, **options)
    assert (report["status"], report["first_broken_id"]) == ("broken", victim)
    report, _ = run(spark, store, 4, **options)  # a failed segment is not remembered
    assert report["status"] == "broken"


def test_lost_rows_and_segments(spark, store):
    chained = store.read(spark, "audit_events")
    sealed = seal_segments(chained, BASE)
    sealed = spark.createDataFrame(sealed.collect(), sealed.schema)
    assert run(spark, store, 0, sealed=sealed)[0]["status"] == "ok"
    folder = store.log.state().folders("audit_events")[0]
    rows = store._rows(spark, "audit_events", [folder])
    for n, lost in enumerate((F.col("pos") == 3, F.col("seg") == rows.agg(F.max("seg")).first()[0])):
        with store.begin(spark, "thief", n) as tx:
            tx.write(rows.where(~lost), "audit_events", rewrites=[folder])
        folder = [f for f in store.log.state().folders("audit_events") if f.rewritten][0]
        report, _ = run(spark, store, n + 1, sealed=sealed)
        assert report["status"] != "ok"


def test_windows(spark, store):
    window = {"from_": BASE + timedelta(hours=3, minutes=20), "to": BASE + timedelta(hours=20, minutes=10)}
    run(spark, store, 0)
    assert run(spark, store, 1, **window)[0]["status"] == "ok"
    assert run(spark, store, 2, from_=BASE + timedelta(days=40))[0]["event_count"] == 0
    assert run(spark, store, 3, to=BASE + timedelta(hours=1))[0]["event_count"] > 0


def test_a_change_that_keeps_the_files_identity_is_found_when_its_turn_comes(spark, store):
    run(spark, store, 0)
    verified = store.read(spark, "verified_segments")
    chosen = [I.suspects(store.read(spark, "audit_events"), verified, at(h).isoformat(), every=4).where("again").count() for h in range(1, 30)]
    assert min(chosen) < max(chosen) and sum(chosen) > store.read(spark, "audit_events").select("seg").distinct().count()


def test_unchanged_segments_are_not_read_beyond_ids(spark, store):
    run(spark, store, 0)
    chained = store.read(spark, "audit_events")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = I.segment_digests(chained)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<id:string,seg:string>", text)
    again = I.suspects(chained, store.read(spark, "verified_segments"), "x", every=10**9).where("again")
    assert again.count() == 0
    one = I.segment_digests(chained).orderBy("seg").limit(1)
    text = I.rows_of(chained, one)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", text)
