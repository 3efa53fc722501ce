from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE, EVENT, event
from sealtrail.plans import ordering as o


def frame(spark, kind):
    """1200 rows: evenly spread, a third in one hour, or a third at one instant."""
    rows = []
    for i in range(1200):
        ts = BASE + timedelta(minutes=7 * i)
        if kind == "hot hour" and i % 3 == 0:
            ts = BASE + timedelta(seconds=i)
        if kind == "hot instant" and i % 3 == 0:
            ts = BASE
        rows.append(event(f"id-{(i * 7919) % 1200:04d}", ts))
    return spark.createDataFrame(rows, EVENT).repartition(5)


def ordered(df):
    return sorted(df.collect(), key=lambda r: (r["ts"], r["id"]))


KINDS = ["even", "hot hour", "hot instant"]


@pytest.mark.parametrize("kind", KINDS)
def test_blocks_are_consecutive_and_bounded(spark, kind):
    blocked = o.with_blocks(frame(spark, kind), max_rows=40)
    rows = ordered(blocked)
    keys = [(r["_bucket"], r["_sub"]) for r in rows]
    assert keys == sorted(keys)
    sizes = {k: keys.count(k) for k in set(keys)}
    assert max(sizes.values()) <= 40 * 3
    if kind != "even":
        assert max(k[1] for k in keys) >= 5


def test_blocks_do_not_depend_on_row_placement(spark):
    df = frame(spark, "hot instant")
    one = {(r["id"], r["_bucket"], r["_sub"]) for r in o.with_blocks(df, max_rows=40).collect()}
    other = {(r["id"], r["_bucket"], r["_sub"]) for r in o.with_blocks(df.repartition(11, "id"), max_rows=40).collect()}
    assert one == other


@pytest.mark.parametrize("kind", KINDS)
def test_position_and_previous_equal_a_global_order(spark, kind):
    df = frame(spark, kind)
    want = [r["id"] for r in ordered(df)]
    got = {r["id"]: r["position"] for r in o.with_position(df, max_rows=40).collect()}
    assert [got[i] for i in want] == list(range(1, 1201))
    previous = {r["id"]: r["before"] for r in o.with_previous(df, "id", "before", max_rows=40).collect()}
    assert [previous[i] for i in want] == [None, *want[:-1]]


def test_buckets_before_1970(spark):
    df = spark.createDataFrame([(-1,), (0,), (3_600_000_000,)], "us BIGINT").select(F.timestamp_micros("us").alias("ts"))
    assert [r[0] for r in df.select(o.time_bucket(60)).collect()] == [-1, 0, 1]


@pytest.mark.parametrize("most", [1, 3, 7])
def test_blocks_do_not_depend_on_what_is_collected(spark, monkeypatch, most):
    df = frame(spark, "hot instant" if most == 3 else "hot hour")
    want = {(r["id"], r["_bucket"], r["_sub"]) for r in o.with_blocks(df, max_rows=40).collect()}
    monkeypatch.setattr(o, "MAX_SPLITS", most)
    got = [(r["id"], r["_bucket"], r["_sub"]) for r in o.with_blocks(df, max_rows=40).collect()]
    assert set(got) == want and len(got) == df.count()
