import hashlib
import hmac
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import BASE, ZERO, events
from sealtrail.operators import anchor as a, chain as c
from sealtrail.operators.sweep import report_text, sweep

SIGNER = a.hmac_signer(b"secret", "key-1")


@pytest.fixture(scope="module")
def chained(spark):
    df = c.build_chain(events(spark, 60, step=timedelta(minutes=3)))
    return spark.createDataFrame(df.collect(), df.schema).cache()


def test_sweep_of_an_intact_table(chained):
    r = sweep(chained, signer=SIGNER, signed_at=BASE).first()
    last = chained.orderBy(F.desc("ts")).first()["this_hash"]
    assert (r["event_count"], r["status"], r["position"], r["anchor_count"]) == (60, "ok", None, 0)
    assert r["root_hash"] == "sha256:" + bytes(last).hex()
    assert r["signature"] == "sig:" + hmac.new(b"secret", bytes(last), hashlib.sha256).hexdigest()
    assert r["key_id"] == "key-1" and r["signed_at"] is not None


def test_sweep_reports_the_first_failure(chained):
    bad = chained.withColumn("actor_id", F.when(F.col("id").isin("e0030", "e0045"), "v1").otherwise(F.col("actor_id")))
    r = sweep(bad, signer=SIGNER).first()
    assert (r["status"], r["first_broken_id"], r["position"], r["root_hash"]) == ("broken", "e0030", 31, None)
    assert r["signature"] is None and "stored this_hash" in r["reason"]


def test_windows_exempt_only_cut_segments(chained):
    start, end = BASE + timedelta(minutes=31), BASE + timedelta(minutes=121)
    r = sweep(chained, from_=start, to=end).first()
    assert (r["status"], r["event_count"]) == ("ok", 30)
    # A segment that begins inside the window must begin at genesis.
    lost = chained.where(~F.col("id").isin("e0020"))
    r = sweep(lost, from_=start, to=end).first()
    assert (r["status"], r["first_broken_id"], r["position"]) == ("gap", "e0021", 10)


def test_sweep_of_nothing(chained):
    r = sweep(chained, from_=datetime(1999, 1, 1, tzinfo=timezone.utc), to=datetime(1999, 1, 2, tzinfo=timezone.utc)).first()
    assert (r["event_count"], r["status"], r["root_hash"]) == (0, "ok", "sha256:" + "0" * 64)


def test_linear_sweep_of_a_linear_chain(spark):
    whole = c.build_chain(events(spark, 40, step=timedelta(minutes=9)), minutes=60 * 24 * 36_500)
    assert sweep(whole, mode="linear").first()["status"] == "ok"
    assert sweep(whole, from_=BASE + timedelta(minutes=90), mode="linear").first()["status"] == "ok"
    assert sweep(whole.where("id <> 'e0010'"), mode="linear").first()["first_broken_id"] == "e0011"


def test_a_failing_signer_leaves_the_report_unsigned(chained):
    def broken(_):
        raise RuntimeError("no key")

    r = sweep(chained, signer=broken, signed_at=BASE).first()
    assert r["status"] == "ok" and r["signature"] is None and r["signed_at"] is None
    assert '"event_count":60' in report_text(sweep(chained)).first()[0]


def test_anchors_and_their_check(spark, chained):
    anchors = a.make_anchors(chained, signer=SIGNER).cache()
    rows = anchors.orderBy("anchored_at").collect()
    assert [r["event_count"] for r in rows] == [20, 20, 20]
    assert rows[0]["last_event_id"] == "e0019"
    assert bytes(rows[0]["signature"]) == hmac.new(b"secret", bytes(rows[0]["root_hash"]), hashlib.sha256).digest()
    assert not any(r["mismatch"] or not r["recomputed_ok"] for r in a.check_anchors(anchors, chained).collect())
    forged = anchors.withColumn("root_hash", F.when(F.col("last_event_id") == "e0019", F.lit(ZERO)).otherwise(F.col("root_hash")))
    gone = chained.where("id <> 'e0039'")
    found = {r["last_event_id"]: r["mismatch"] for r in a.check_anchors(forged, gone).collect()}
    assert found == {"e0019": True, "e0039": True, "e0059": False}
    short = anchors.withColumn("root_hash", F.lit(b"short"))
    assert a.check_anchors(short, chained).where("mismatch").count() == 0
    r = sweep(chained, forged, from_=BASE, to=BASE + timedelta(hours=2)).first()
    assert (r["anchor_count"], r["anchors_checked"], r["anchor_mismatches"]) == (2, 2, 1)


def test_signing_anchors_must_not_fail_silently(chained):
    def broken(_):
        raise RuntimeError("no key")

    with pytest.raises(Exception, match="no key"):
        a.make_anchors(chained, signer=broken).collect()


def test_anchored_flags(chained):
    anchors = a.make_anchors(chained).orderBy("anchored_at")
    one, two = anchors.limit(1), anchors.limit(2)
    none = anchors.where("false")
    assert a.with_anchored(chained, none).where("anchored").count() == 0
    assert a.with_anchored(chained, one).where("anchored").count() == 20
    assert a.newly_anchored(chained, none, two).first()[0] == 40
    assert a.newly_anchored(chained, two, two).first()[0] == 0
    assert a.newly_anchored(chained, one, two).first()[0] == 20
    assert a.make_anchors(chained.where("false")).count() == 0
