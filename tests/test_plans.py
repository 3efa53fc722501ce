"""The physical plans that scale depends on."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE, events
from sealtrail.operators import anchor, chain, ingest, redact, search
from sealtrail.operators.search import EventQuery
from sealtrail.plans.ordering import with_position
from sealtrail.schema import WIRE
from sealtrail.sources import samples
from sealtrail.sources.tables import Store


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two days of events written the way ingest writes them."""
    store = Store(str(tmp_path_factory.mktemp("store")))
    df = chain.build_chain(events(spark, 200, step=timedelta(minutes=12)).withColumn("event_date", F.to_date("ts")))
    df = df.withColumn("legal_hold_initial", F.lit(False)).withColumn("ingested_at", F.lit(BASE))
    store.write_batch(df, "audit_events", 0)
    return store.read(spark, "audit_events")


def test_verification_has_one_shuffle_and_no_python(table):
    text = plan(chain.verify_chain(table))
    assert text.count("Exchange ") == 1 and "hashpartitioning(seg" in text
    assert "Python" not in text and "Arrow" not in text and "SinglePartition" not in text
    counted = plan(chain.verify_chain(table).groupBy("status").count())
    window = counted.split("Window [")[0]  # everything above the shuffle
    assert "_broken" in window and "actor_id" not in window and "payload_hash" not in window


def test_building_has_one_shuffle(spark):
    text = plan(chain.build_chain(events(spark, 10)))
    assert text.count("Exchange ") == 1 and "hashpartitioning(seg" in text


def test_search_prunes_dates_and_pushes_filters(table):
    query = EventQuery(from_=BASE, to=BASE + timedelta(hours=2), actor="u1", service="desk")
    text = plan(search.search(table, query).select("id"))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", text)
    for pushed in ("GreaterThanOrEqual(ts", "LessThan(ts", "EqualTo(actor_id,u1)", "EqualTo(source_service,desk)"):
        assert pushed in text
    assert "payload_hash" not in text.split("ReadSchema")[1]


def test_pages_are_top_k(table):
    text = plan(search.page_rows(table, EventQuery(), 100, "2026-07-13T12:00:00Z|e0010"))
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(ts" in text and "Exchange" not in text


def test_positions_never_order_events_in_one_partition(table):
    text = plan(with_position(table.select("id", "ts")))
    # A single partition may hold only the one-row-per-block table.
    for part in re.findall(r"Exchange SinglePartition.*\n(.*)", text):
        assert "Aggregate" in part and "_bucket" in part


def test_flags_join_one_row(spark, table):
    anchors = anchor.make_anchors(table)
    text = plan(anchor.with_anchored(table, anchors))
    assert text.count("BroadcastNestedLoopJoin") == 1 and "CartesianProduct" not in text


def test_each_udf_runs_once_even_under_filters(spark):
    wire = spark.createDataFrame([("t", 0, 0, None, b"{}", None)], WIRE)
    policy = redact.parse_policy('- service: "*"\n  action: "*"\n  fields:\n    a: drop\n')
    judged = ingest.accepted(ingest.judge_messages(wire, policy)).where("id <> ''")
    text = plan(ingest.as_events(judged, BASE))
    assert text.count("ArrowEvalPython [_decode") == 1 and text.count("ArrowEvalPython [_redact") == 1
    assert len(text) < 60_000


def test_copies_shrink_before_the_shuffle(spark):
    wire = spark.createDataFrame([("t", 0, 0, None, b"{}", None)], WIRE)
    text = plan(ingest.first_deliveries(ingest.decode(wire)))
    assert "partial_min(struct(topic" in text and "partial_min_by" not in text and "Window" not in text


def test_messages_of_one_row_group_are_dealt_out_before_decoding(spark, tmp_path):
    rows = spark.range(40).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id as user_id", "'view' as event_type", "1.0D as value", "'{}' as props"
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    wire = samples.wire_messages(spark, str(tmp_path))
    told = plan(wire)
    assert told.count("REBALANCE_PARTITIONS") == 1 and told.count("FileScan") == 1
    later = 1_000_000_000_000
    assert sorted(r.offset for r in wire.collect()) == sorted([*range(40), *(later + n for n in range(0, 40, 10))])
