"""Registered queries: scans, filters, pages, lookups, views."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sealtrail.functions.text import is_uuid
from sealtrail.operators import search as s
from sealtrail.operators.search import EventQuery
from sealtrail.plans import oracle as q
from sealtrail.plans.inputs import chained, hexed, micros
from sealtrail.session import configure
from sealtrail.sources import samples

FROM, TO = datetime(2024, 1, 5, 6, tzinfo=timezone.utc), datetime(2024, 1, 12, 18, 30, tzinfo=timezone.utc)
_SQL_TIME = "ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:30:00'"


def _short(df):
    return df.select("id", micros("ts"), "source_service", "actor_id", "action", "target_id")


_SHORT = "id, epoch_us(ts) AS ts_us, source_service, actor_id, action, target_id"


def scan_events(spark, sf_dir):
    return chained(spark, sf_dir).select(
        "id", micros("ts"), "ts_ns", "source_service", "actor_id", "action", "target_type", "target_id",
        "payload_ref", "redacted", "seg", "pos", *hexed("payload_hash", "prev_hash", "this_hash"),
    )


def _search(query):
    return lambda spark, sf_dir: _short(s.search(chained(spark, sf_dir), query))


def _found(where):
    return f"WITH {q.EV} SELECT {_SHORT} FROM ev WHERE {where}"


_ALL = EventQuery(
    from_=FROM, to=TO, service="click", action="click", actor="user_8", target_type="user", target_id="8"
)


def search_page1(spark, sf_dir):
    rows, _ = s.page(chained(spark, sf_dir), EventQuery(service="view"), 100)
    return _short(rows)


def search_page2(spark, sf_dir):
    events = chained(spark, sf_dir)
    _, cursor = s.page(events, EventQuery(service="view"), 100)
    rows, _ = s.page(events, EventQuery(service="view"), 100, cursor)
    return _short(rows)


def page_assign(spark, sf_dir):
    return s.assign_pages(chained(spark, sf_dir), EventQuery(service="purchase"), 50).select("id", "position", "page")


def event_get(spark, sf_dir):
    return _short(s.get(chained(spark, sf_dir), "00000007-0000-7000-8000-000000000007"))


def lookup_ids(spark, sf_dir):
    return _short(s.lookup(chained(spark, sf_dir), samples.hold_log(spark, sf_dir)))


def missing_ids(spark, sf_dir):
    """Ids made from order keys: those up to the number of events exist."""
    ids = samples.order_events(spark, sf_dir).select("id")
    return s.missing_ids(chained(spark, sf_dir), ids)


def event_view(spark, sf_dir):
    return s.event_view(chained(spark, sf_dir))


def uuid_quality(spark, sf_dir):
    configure(spark)
    ids = samples.audit_events(spark, sf_dir).select("id", F.lit("events").alias("origin")).unionByName(
        samples.line_events(spark, sf_dir).select("id", F.lit("lineitem").alias("origin"))
    )
    return ids.groupBy("origin").agg(
        F.count_if(is_uuid("id")).alias("valid"), F.count_if(~is_uuid("id")).alias("invalid")
    )


QUERIES = {
    "scan_events": (scan_events, q.CHAIN + """
SELECT id, epoch_us(ts) AS ts_us, ts_ns, source_service, actor_id, action, target_type, target_id,
  id AS payload_ref, false AS redacted, seg, pos, ph AS payload_hash, prev_hash, this_hash FROM ch"""),
    "search_time": (_search(EventQuery(from_=FROM, to=TO)), _found(_SQL_TIME)),
    "search_service": (_search(EventQuery(service="signup")), _found("source_service = 'signup'")),
    "search_actor": (_search(EventQuery(actor="user_42")), _found("actor_id = 'user_42'")),
    "search_action": (_search(EventQuery(action="error")), _found("action = 'error'")),
    "search_target": (
        _search(EventQuery(target_type="user", target_id="17")),
        _found("target_type = 'user' AND target_id = '17'"),
    ),
    "search_all": (
        _search(_ALL),
        _found(f"{_SQL_TIME} AND source_service = 'click' AND action = 'click' AND actor_id = 'user_8'"
               " AND target_type = 'user' AND target_id = '8'"),
    ),
    "search_page1": (search_page1, _found("source_service = 'view' ORDER BY ts, id LIMIT 100")),
    "search_page2": (search_page2, _found("source_service = 'view' ORDER BY ts, id LIMIT 100 OFFSET 100")),
    "page_assign": (page_assign, f"""WITH {q.EV}, p AS (
  SELECT id, row_number() OVER (ORDER BY ts, id) AS position FROM ev WHERE source_service = 'purchase')
SELECT id, position, (position + 49) // 50 AS page FROM p"""),
    "event_get": (event_get, _found("n = 7")),
    "lookup_ids": (lookup_ids, _found("n % 20 = 0")),
    "missing_ids": (missing_ids, f"""SELECT {q.uuid('o_orderkey')} AS id FROM orders
WHERE o_orderkey NOT IN (SELECT event_id FROM events)"""),
    "event_view": (event_view, q.CHAIN + f"""
SELECT id, {q.RFC3339} AS ts, source_service, actor_id, action, target_type, target_id, false AS redacted,
  id AS payload_ref, 'sha256:' || ph AS payload_hash, 'sha256:' || prev_hash AS prev_hash,
  'sha256:' || this_hash AS this_hash FROM ch"""),
    "uuid_quality": (uuid_quality, """SELECT 'events' AS origin, count(*) AS valid, 0 AS invalid FROM events
UNION ALL SELECT 'lineitem', 0, count(*) FROM lineitem"""),
}
