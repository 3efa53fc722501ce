from datetime import timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import BASE, EVENT, event, events
from sealtrail.operators import search as s
from sealtrail.operators.chain import build_chain
from sealtrail.operators.search import EventQuery
from sealtrail.sources.tables import Store


@pytest.fixture(scope="module")
def five(spark):
    rows = [
        event(f"00000000-0000-4000-8000-00000000000{i}", BASE + timedelta(seconds=i), service="pay" if i == 3 else "desk", actor=f"u{i % 2}")
        for i in range(5)
    ]
    df = spark.createDataFrame(rows, EVENT).withColumn("event_date", F.to_date("ts"))
    return df.cache()


def ids(df):
    return sorted(r["id"][-1] for r in df.collect())


def test_window_is_half_open(five):
    q = EventQuery(from_=BASE + timedelta(seconds=1), to=BASE + timedelta(seconds=4))
    assert ids(s.search(five, q)) == ["1", "2", "3"]


def test_filters_are_a_conjunction(five):
    assert ids(s.search(five, EventQuery())) == list("01234")
    assert ids(s.search(five, EventQuery(service="desk", actor="u1"))) == ["1"]
    assert ids(s.search(five, EventQuery(action="signed", target_type="form", target_id="12", service="pay"))) == ["3"]
    assert ids(s.search(five, EventQuery(service="none"))) == []


def test_pages_follow_the_cursor(five):
    pages, cursor = [], ""
    while True:
        rows, cursor = s.page(five, EventQuery(), 2, cursor)
        pages.append([r["id"][-1] for r in rows.collect()])
        if not cursor:
            break
    assert pages == [["0", "1"], ["2", "3"], ["4"]]
    exact, cursor = s.page(five, EventQuery(), 5)
    assert exact.count() == 5 and cursor == ""


def test_cursor_breaks_ties_by_id(spark):
    df = spark.createDataFrame([event(i, BASE) for i in "dbac"], EVENT)
    rows, cursor = s.page(df, EventQuery(), 3)
    assert [r["id"] for r in rows.collect()] == ["a", "b", "c"]
    rows, cursor = s.page(df, EventQuery(), 3, cursor)
    assert [r["id"] for r in rows.collect()] == ["d"] and cursor == ""


def test_limits(spark):
    df = events(spark, 1001, step=timedelta(milliseconds=1))
    for limit in (0, -1, 5000):
        rows, cursor = s.page(df, EventQuery(), limit)
        assert rows.count() == 1000 and cursor.endswith("|e0999")


def test_cursor_text():
    assert s.encode_cursor(None, "") == "" and s.parse_cursor("") is None
    text = "2026-07-13T10:00:00.123456789Z|e1"
    assert s.encode_cursor(*s.parse_cursor(text)) == text
    assert s.parse_cursor("2026-07-13T10:00:00Z|a|b")[1] == "a|b"
    for bad in ("x", "2026-07-13T10:00:00Z", "yesterday|e1"):
        with pytest.raises(ValueError):
            s.parse_cursor(bad)


def test_query_objects():
    q = EventQuery.from_json('{"from":"2026-07-13T10:00:00Z","to":"soon","service":"desk","actor":5,"x":1}')
    assert q == EventQuery(from_=BASE, service="desk")
    assert EventQuery.from_json("") == EventQuery.from_json("null") == EventQuery()
    for bad in ("{", "[]", '"x"'):
        with pytest.raises(ValueError):
            EventQuery.from_json(bad)


def test_page_numbers(five):
    got = {r["id"][-1]: (r["position"], r["page"]) for r in s.assign_pages(five, EventQuery(service="desk"), 2).collect()}
    assert got == {"0": (1, 1), "1": (2, 1), "2": (3, 2), "4": (4, 2)}


def test_lookup(spark, five):
    wanted = spark.createDataFrame([("00000000-0000-4000-8000-000000000002",), ("00000000-0000-4000-8000-0000000000ff",), ("bad",)], "id STRING")
    assert ids(s.lookup(five, wanted)) == ["2"]
    assert {r["id"][-2:] for r in s.missing_ids(five, wanted).collect()} == {"ff", "ad"}


def test_view(five):
    row = s.event_view(build_chain(five)).orderBy("ts").first()
    assert row["ts"] == "2026-07-13T10:00:00Z"
    assert row["prev_hash"] == "sha256:" + "0" * 64 and row["this_hash"].startswith("sha256:")
    assert row["payload_hash"] == ""  # not a 32-byte hash


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.sampled_from("abc")), min_size=1, max_size=8), max_size=6), st.integers(0, 30), st.integers(1, 9))
def test_seek_keeps_the_files_that_hold_the_rows(files, start, size):
    zones = [s.Zone(str(i), len(rows), min(rows), max(rows)) for i, rows in enumerate(files)]
    kept, before = s.seek(zones, start, start + size)
    want = sorted(r for rows in files for r in rows)[start : start + size]
    assert sorted(r for z in kept for r in files[int(z.path)])[start - before : start - before + size] == want


def test_pages_of_a_store_read_only_their_files(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    chained = build_chain(events(spark, 300, step=timedelta(minutes=10)).withColumn("event_date", F.to_date("ts")))
    chained = chained.withColumns({"legal_hold_initial": F.lit(False), "ingested_at": F.lit(BASE)}).cache()
    for batch in range(2):
        store.write_batch(chained.where(F.col("pos") % 2 == batch), "audit_events", batch)
    order = [r["id"] for r in chained.orderBy("ts", "id").select("id").collect()]
    files = len(store.zones())
    assert files > 4
    for number in (1, 7, 12, 13, 40):
        rows, total = store.page(spark, number, 25)
        assert [r["id"] for r in rows.collect()] == order[(number - 1) * 25 : number * 25] and total == 300
        assert len(rows.inputFiles()) < files or number == 40
    assert store.compact(spark, "audit_events") and len(store.zones()) < files
    assert [r["id"] for r in store.page(spark, 3, 25)[0].collect()] == order[50:75]
    assert store.page(spark, 1)[0].count() == 100
