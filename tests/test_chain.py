import random
import re
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import BASE, EVENT, ZERO, digest, event, events, linear_chain
from sealtrail.operators import chain as c

CENTURY = 60 * 24 * 36_500


def statuses(df, **options):
    return {r["id"]: r["status"] for r in c.verify_chain(df, **options).collect()}


@pytest.fixture(scope="module")
def ten(spark):
    df = c.build_chain(events(spark, 10, prefix="evt"))
    rows = df.collect()
    return spark.createDataFrame(rows, df.schema).cache()


def test_one_segment_is_the_linear_chain(spark):
    df = events(spark, 200, step=timedelta(milliseconds=1)).repartition(7)
    chained = c.build_chain(df, minutes=CENTURY).collect()
    want = linear_chain(chained)
    for row in chained:
        assert (bytes(row["prev_hash"]), bytes(row["this_hash"])) == want[row["id"]]
    assert sorted(r["pos"] for r in chained) == list(range(1, 201))
    assert len({r["seg"] for r in chained}) == 1


def test_each_segment_starts_at_genesis(spark):
    rows = c.build_chain(events(spark, 90, step=timedelta(minutes=7))).collect()
    segments = {}
    for row in rows:
        segments.setdefault(row["seg"], []).append(row)
    assert len(segments) == 11
    for members in segments.values():
        want = linear_chain(members)
        assert all(bytes(r["this_hash"]) == want[r["id"]][1] for r in members)


def test_a_hot_instant_is_cut_into_verifiable_segments(spark):
    rows = [event(f"h{i:05d}", BASE) for i in range(600)]
    chained = c.build_chain(spark.createDataFrame(rows, EVENT).repartition(6), max_rows=50)
    sizes = [r["count"] for r in chained.groupBy("seg").count().collect()]
    assert len(sizes) > 5 and max(sizes) <= 150 and sum(sizes) == 600
    assert set(statuses(chained).values()) == {"ok"}


@pytest.mark.parametrize("column", ["source_service", "actor_id", "action", "target_type", "target_id"])
def test_a_changed_field_is_broken(ten, column):
    hit = F.when(F.col("id") == "evt0005", "v1").otherwise(F.col(column))
    verified = c.verify_chain(ten.withColumn(column, hit))
    first = c.first_failure(verified).first()
    assert (first["id"], first["status"]) == ("evt0005", "broken")
    assert verified.where("status <> 'ok'").count() == 1


def test_a_changed_hash_or_payload_hash(ten):
    bad = ten.withColumn("payload_hash", F.when(F.col("pos") == 3, F.lit(b"x")).otherwise(F.col("payload_hash")))
    assert [i for i, s in sorted(statuses(bad).items()) if s != "ok"] == ["evt0002"]
    bad = ten.withColumn("this_hash", F.when(F.col("pos") == 3, F.lit(bytes(32))).otherwise(F.col("this_hash")))
    found = statuses(bad)
    assert found["evt0002"] == "broken" and found["evt0003"] == "gap"
    nulled = ten.withColumn("this_hash", F.when(F.col("pos") == 3, F.lit(None)).otherwise(F.col("this_hash")))
    assert statuses(nulled)["evt0002"] == "broken"


def test_a_severed_but_rehashed_link_is_a_gap(spark, ten):
    rows = [r.asDict() for r in ten.collect()]
    for row in rows:
        if row["id"] == "evt0004":
            row["prev_hash"] = b"\x01" * 32
            row["this_hash"] = digest(row, row["prev_hash"])
    found = statuses(spark.createDataFrame(rows, ten.schema))
    assert found["evt0004"] == "gap" and found["evt0005"] == "gap" and found["evt0003"] == "ok"


def test_missing_rows_are_gaps_also_at_the_start(ten):
    assert statuses(ten.where("pos > 1"))["evt0001"] == "gap"
    assert statuses(ten.where("pos <> 5"))["evt0005"] == "gap"
    assert set(statuses(ten.where("pos < 8")).values()) == {"ok"}


def test_linear_mode_exempts_only_the_first_row(ten):
    assert set(statuses(ten.where("pos > 3"), mode="linear").values()) == {"ok"}
    assert statuses(ten.where("pos > 3"), mode="linear", genesis="zero")["evt0003"] == "gap"
    with pytest.raises(ValueError):
        c.verify_chain(ten, mode="other")


def test_roots(ten):
    root = c.chain_root(c.verify_chain(ten)).first()
    assert bytes(root["root"]) == bytes(ten.where("pos = 10").first()["this_hash"])
    empty = c.chain_root(c.verify_chain(ten.where("false"))).first()
    assert (empty["event_count"], bytes(empty["root"])) == (0, ZERO)
    broken = c.chain_root(c.verify_chain(ten.withColumn("action", F.lit("y")))).first()
    assert broken["root"] is None


def test_verify_events_uses_the_true_predecessor(spark, ten):
    ids = spark.createDataFrame([("evt0007",), ("none",)], "id STRING")
    rows = c.verify_events(ten, ids).collect()
    assert [(r["id"], r["status"]) for r in rows] == [("evt0007", "ok")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_any_tampering_is_found_at_the_right_event(spark, ten, seed):
    rng = random.Random(seed)
    rows = [r.asDict() for r in ten.collect()]
    victim = rng.choice(rows)
    column = rng.choice(["actor_id", "action", "target_id", "payload_hash", "ts_ns", "prev_hash"])
    value = victim[column]
    if isinstance(value, str):
        victim[column] = value + "~"
    elif isinstance(value, int):
        victim[column] = value ^ (1 << rng.randrange(40))
    else:
        data = bytearray(value)
        data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        victim[column] = bytes(data)
    rng.shuffle(rows)
    first = c.first_failure(c.verify_chain(spark.createDataFrame(rows, ten.schema))).first()
    assert (first["id"], first["status"]) == (victim["id"], "broken")


# --- continuing a stored chain ---


def test_heads_continue_the_same_chain(spark):
    df = events(spark, 300, step=timedelta(seconds=40)).cache()
    whole = {r["id"]: (r["seg"], r["pos"], bytes(r["this_hash"])) for r in c.build_chain(df).collect()}
    cut = BASE + timedelta(seconds=40 * 130)
    first = c.build_chain(df.where(F.col("ts") < F.lit(cut)))
    second = c.build_chain(df.where(F.col("ts") >= F.lit(cut)), heads=c.segment_heads(first), batch="1")
    pieces = {r["id"]: (r["seg"], r["pos"], bytes(r["this_hash"])) for r in first.unionByName(second).collect()}
    assert pieces == whole


def test_a_full_segment_is_followed_by_a_new_one(spark):
    df = events(spark, 60).cache()
    first = c.build_chain(df.where("id < 'e0030'"), max_rows=40)
    second = c.build_chain(df.where("id >= 'e0030'"), max_rows=40, heads=c.segment_heads(first), batch="1")
    both = first.unionByName(second)
    assert {r["seg"]: r["count"] for r in both.groupBy("seg").count().collect()} == {
        "2026-07-13T10:00/000000": 30, "2026-07-13T10:00/000001": 30}
    assert set(statuses(both).values()) == {"ok"}


def test_late_events_leave_sealed_links_alone(spark):
    df = events(spark, 50).cache()
    late = F.col("id").isin("e0003", "e0020")
    first = c.build_chain(df.where(~late))
    second = c.build_chain(df.where(late), heads=c.segment_heads(first), batch="7").collect()
    assert {r["seg"] for r in second} == {"late-7/2026-07-13T10:00/000000"}
    both = first.unionByName(spark.createDataFrame(second, first.schema))
    assert set(statuses(both).values()) == {"ok"}
    # A later batch continues after the regular head, not after the late segment.
    third = c.build_chain(
        spark.createDataFrame([event("z", BASE + timedelta(minutes=5))], EVENT), heads=c.segment_heads(both), batch="8")
    row = third.first()
    assert (row["seg"], row["pos"]) == ("2026-07-13T10:00/000000", 49)


def test_lost_segments_are_found(spark):
    chained = c.build_chain(events(spark, 40, step=timedelta(minutes=10)))
    sealed = c.build_segments(chained)
    lost = chained.where("seg NOT LIKE '%T12%' AND id <> 'e0001'").withColumn(
        "this_hash", F.when(F.col("id") == "e0039", F.lit(ZERO)).otherwise(F.col("this_hash")))
    found = {r["seg"]: r["status"] for r in c.check_segments(lost, sealed).collect()}
    assert found["2026-07-13T12:00/000000"] == "missing"
    assert found["2026-07-13T10:00/000000"] == "resized"
    assert found["2026-07-13T16:00/000000"] == "changed"
    assert list(found.values()).count("ok") == 4
    hashes = [bytes(r["segment_hash"]) for r in c.segment_chain(sealed).orderBy("seg").collect()]
    without = [bytes(r["segment_hash"]) for r in c.segment_chain(sealed.where("seg NOT LIKE '%T12%'")).orderBy("seg").collect()]
    assert hashes[:2] == without[:2] and not set(hashes[2:]) & set(without[2:])


def test_verify_events_in_linear_mode_looks_over_bucket_borders(spark, tmp_path):
    """Sparse events: predecessors are hours and days back."""
    rows = [event(f"e{i:03d}", BASE + timedelta(minutes=m)) for i, m in enumerate([0, 5, 5, 70, 71, 400, 3000, 3001, 9000])]
    one = c.build_chain(spark.createDataFrame(rows, EVENT), minutes=10**6).withColumn("event_date", F.to_date("ts"))
    one.write.partitionBy("event_date").parquet(str(tmp_path / "t"))
    table = spark.read.schema(one.schema).parquet(str(tmp_path / "t"))
    every = table.select("id")
    full = {r["id"]: r for r in c.verify_chain(table, mode="linear").collect()}
    for id_ in [r["id"] for r in every.collect()]:
        got = c.verify_events(table, every.where(F.col("id") == id_), mode="linear").collect()
        assert [(r["id"], r["status"], r["expected_prev"]) for r in got] == [(id_, "ok", full[id_]["expected_prev"])]
    forged = table.withColumn("this_hash", F.when(F.col("id") == "e005", F.unhex(F.lit("00"))).otherwise(F.col("this_hash")))
    found = {r["id"]: r["status"] for r in c.verify_events(forged, every, mode="linear").collect()}
    assert found == {**{r: "ok" for r in found}, "e005": "broken", "e006": "gap"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = c.verify_events(table, every.where("id = 'e006'"), mode="linear")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan)
