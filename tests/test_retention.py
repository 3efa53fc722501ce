from datetime import timedelta

from helpers import BASE, events
from sealtrail.operators import retention as r
from sealtrail.sources.tables import fetch_payloads
from sealtrail.schema import PAYLOADS


def inventory(spark, *rows):
    full = [(ref, b"body", "application/json", cls, days, hold, BASE - timedelta(hours=age)) for ref, days, hold, cls, age in rows]
    return spark.createDataFrame(full, PAYLOADS)


def by_ref(df, column):
    return {x["payload_ref"]: x[column] for x in df.collect()}


def test_retention_and_holds(spark):
    p = inventory(
        spark, ("kept", 2555, False, "STANDARD", 1), ("held", 0, True, "STANDARD", 9999), ("expired", 1, False, "STANDARD", 48),
        ("edge", 1, False, "STANDARD", 24), ("none", 0, False, "STANDARD", 0), ("negative", -5, False, "STANDARD", 0),
    )
    assert by_ref(r.retention_state(p, BASE), "retained") == {
        "kept": True, "held": True, "expired": False, "edge": False, "none": False, "negative": False}
    plan = r.purge_plan(p, BASE)
    assert by_ref(plan, "decision")["held"] == "refuse" and by_ref(plan, "reason")["held"] == "legal hold"
    assert by_ref(plan, "reason")["kept"] == "retention active" and by_ref(plan, "reason")["none"] is None
    incoming = inventory(spark, *[(ref, 1, False, "STANDARD", 0) for ref in ("kept", "expired", "new")])
    assert {x[0] for x in r.worm_conflicts(incoming, p, BASE).collect()} == {"kept"}
    assert set(by_ref(r.put_payloads(incoming, p, BASE), "body")) == {"expired", "new"}
    assert by_ref(r.inventory(p), "size")["kept"] == 4


def test_lifecycle_moves_one_hop_per_run(spark):
    day = 24
    p = inventory(
        spark, ("young", 1, False, "STANDARD", 89 * day), ("due", 1, False, "STANDARD", 90 * day),
        ("old", 1, False, "STANDARD", 400 * day), ("cold", 1, False, "GLACIER", 400 * day), ("done", 1, False, "DEEP_ARCHIVE", 999 * day),
    )
    assert by_ref(r.lifecycle_plan(p, BASE), "next_class") == {"due": "GLACIER", "old": "GLACIER", "cold": "DEEP_ARCHIVE"}
    counts = {(x[0], x[1]): x[2] for x in r.lifecycle_counts(p, BASE).collect()}
    assert counts == {("STANDARD", "GLACIER"): 2, ("GLACIER", "DEEP_ARCHIVE"): 1}


def test_latest_hold_wins(spark):
    from pyspark.sql import functions as F

    df = events(spark, 4).withColumn("legal_hold_initial", F.col("id") == "e0003")
    log = r.set_holds(spark, ["e0000", "e0001", "gone"], True, BASE).unionByName(
        r.set_holds(spark, ["e0001", "e0003"], False, BASE + timedelta(hours=1)))
    got = {x["id"]: x["legal_hold"] for x in r.with_legal_hold(df, log).collect()}
    assert got == {"e0000": True, "e0001": False, "e0002": False, "e0003": False}
    assert [x["id"] for x in r.unknown_holds(log, df).collect()] == ["gone"]


def test_fetch(spark):
    p = inventory(spark, ("store/e0001", 1, False, "STANDARD", 0))
    got = {x["id"]: (x["body"], x["payload_found"]) for x in fetch_payloads(events(spark, 2), p).collect()}
    assert got["e0000"] == (None, False) and bytes(got["e0001"][0]) == b"body" and got["e0001"][1]
