"""Registered queries: chain, verification, Merkle roots, anchors."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sealtrail.functions.hashing import canonical_body, event_hash, hex_text, zero_hash
from sealtrail.operators import anchor, chain
from sealtrail.operators.merkle import merkle_root
from sealtrail.operators.metrics import verify_outcomes
from sealtrail.operators.sweep import sweep
from sealtrail.plans import oracle as q
from sealtrail.plans.inputs import anchors, chained, hexed, micros
from sealtrail.plans.ordering import OVERSAMPLE, candidate_threshold, with_position, with_previous
from sealtrail.session import configure
from sealtrail.sources import samples

FROM, TO = datetime(2024, 1, 3, 5, 30, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc)
_SQL_WINDOW = "ts >= TIMESTAMP '2024-01-03 05:30:00' AND ts < TIMESTAMP '2024-01-20'"

_DAY, _WEEK = 1440, 10080
_DAY_ROWS, _WEEK_ROWS = 100, 32


def _links(df):
    return df.select("id", "seg", "pos", *hexed("prev_hash", "this_hash"))


def chain_build(spark, sf_dir):
    configure(spark)
    return _links(chain.build_chain(samples.audit_events(spark, sf_dir)))


def chain_build_split_days(spark, sf_dir):
    configure(spark)
    return _links(chain.build_chain(samples.audit_events(spark, sf_dir), _DAY, _DAY_ROWS))


def chain_build_shared_dates(spark, sf_dir):
    configure(spark)
    return _links(chain.build_chain(samples.order_events(spark, sf_dir), _WEEK, _WEEK_ROWS))


def _split_sql(source, minutes, rows):
    return q.chain_of(
        q.split_segments(source, minutes, rows, candidate_threshold(rows), OVERSAMPLE)
    ) + " SELECT id, seg, pos, prev_hash, this_hash FROM ch"


def verify_chain(spark, sf_dir):
    v = chain.verify_chain(chained(spark, sf_dir))
    return v.select("id", hex_text("computed").alias("computed"), "status")


def verify_linear(spark, sf_dir):
    v = chain.verify_chain(chained(spark, sf_dir), mode="linear")
    return v.select("id", "status", "reason")


def tamper_detect(spark, sf_dir):
    v = chain.verify_chain(samples.tampered(chained(spark, sf_dir)))
    return v.where("status <> 'ok'").select("id", "seg", "pos", "status", "reason")


def gap_detect(spark, sf_dir):
    """Every 1000th event is gone: its successor in the segment shows a gap."""
    kept = chained(spark, sf_dir).where(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 1000 != 7)
    v = chain.verify_chain(kept)
    return v.where("status <> 'ok'").select("id", "seg", "pos", "status", "reason")


def first_failure(spark, sf_dir):
    v = chain.verify_chain(samples.tampered(chained(spark, sf_dir)))
    return chain.first_failure(v).select("id", micros("ts"), "status", "reason")


def _report(df):
    return df.select(
        "event_count", "status", "first_broken_id", "position", "reason", "root_hash",
        "anchor_count", "anchors_checked", "anchor_mismatches",
    )


def sweep_report(spark, sf_dir):
    return _report(sweep(chained(spark, sf_dir), anchors(spark, sf_dir), FROM, TO))


def sweep_tampered(spark, sf_dir):
    return _report(sweep(samples.tampered(chained(spark, sf_dir)), anchors(spark, sf_dir)))


def chain_linkage(spark, sf_dir):
    c = with_previous(chained(spark, sf_dir), "this_hash", "previous")
    return c.select("id", F.coalesce(hex_text("previous"), hex_text(zero_hash())).alias("previous"))


def chain_position(spark, sf_dir):
    return with_position(chained(spark, sf_dir)).select("id", "position")


def position_shared_dates(spark, sf_dir):
    configure(spark)
    orders = samples.order_events(spark, sf_dir)
    return with_position(orders, minutes=_WEEK, max_rows=_WEEK_ROWS).select("id", "position")


def chain_head(spark, sf_dir):
    return chain.chain_heads(chained(spark, sf_dir)).select("seg", "id", "pos", *hexed("this_hash"))


def chain_head_overall(spark, sf_dir):
    return chain.chain_heads(chained(spark, sf_dir), by=None).select("id", micros("ts"), *hexed("this_hash"))


def chain_root(spark, sf_dir):
    root = chain.chain_root(chain.verify_chain(chained(spark, sf_dir)))
    return root.select("event_count", *hexed("root"))


def segment_chain(spark, sf_dir):
    s = chain.segment_chain(chain.build_segments(chained(spark, sf_dir)))
    return s.select("seg", "n", "first_id", "last_id", *hexed("root", "prev_segment_hash", "segment_hash"))


def segment_check(spark, sf_dir):
    """Sealed segments against a table that lost the first 12 hours of the 2nd."""
    c = chained(spark, sf_dir)
    lost = c.where(~F.col("seg").between("2024-01-02T00:00/", "2024-01-02T12"))
    found = chain.check_segments(lost, chain.build_segments(c))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("sealed_events"))


_LOST = "2024-01-02T07:00/000000"
_SEALED_AT = datetime(2024, 3, 1, tzinfo=timezone.utc)


def _sealed(c):
    return chain.seal_segments(c, _SEALED_AT)


def _forged(c):
    """One hour rebuilt with another actor: consistent in itself."""
    hour = c.where(F.col("seg") == _LOST).drop("seg", "pos", "prev_hash", "this_hash")
    again = chain.build_chain(hour.withColumn("actor_id", F.lit("forged")))
    return c.where(F.col("seg") != _LOST).unionByName(again)


def _segment_report(c, events):
    r = sweep(events, sealed=_sealed(c))
    return r.select("event_count", "status", "first_broken_id", "position", "reason", "root_hash", "segment_root")


def sweep_sealed(spark, sf_dir):
    c = chained(spark, sf_dir)
    return _segment_report(c, c)


def sweep_lost_segment(spark, sf_dir):
    """A whole hour is gone; every link that is left holds."""
    c = chained(spark, sf_dir)
    return _segment_report(c, c.where(F.col("seg") != _LOST))


def sweep_forged_segment(spark, sf_dir):
    c = chained(spark, sf_dir)
    return _segment_report(c, _forged(c))


def anchor_lost_segment(spark, sf_dir):
    """Anchors that sign the chain over segments, against events without one hour."""
    c = chained(spark, sf_dir)
    sealed = _sealed(c)
    a = anchor.anchor_segments(sealed, _DAY)
    found = anchor.check_segment_anchors(a, c.where(F.col("seg") != _LOST), sealed)
    return found.select("id", "last_event_id", "event_count", "mismatch")


def anchor_signatures(spark, sf_dir):
    """Signed daily anchors, one of them with a root that was replaced afterwards."""
    signed = anchor.make_anchors(chained(spark, sf_dir), _DAY, anchor.hmac_signer(b"key", "k1"))
    forged = F.when(F.col("id") == "anchor-2024-01-05T00:00", zero_hash()).otherwise(F.col("root_hash"))
    checked = anchor.check_signatures(signed.withColumn("root_hash", forged), anchor.hmac_verifier({"k1": b"key"}))
    return checked.select("id", "key_id", "signature_ok")


def canonical_bytes(spark, sf_dir):
    configure(spark)
    return samples.audit_events(spark, sf_dir).select("id", hex_text(canonical_body()).alias("body"))


def event_hash_genesis(spark, sf_dir):
    configure(spark)
    h = event_hash(canonical_body(), zero_hash())
    return samples.line_events(spark, sf_dir).select("id", hex_text(h).alias("this_hash"))


def verify_event(spark, sf_dir):
    """The events on the hold log, each against its true predecessor."""
    ids = samples.hold_log(spark, sf_dir)
    v = chain.verify_events(samples.tampered(chained(spark, sf_dir)), ids)
    return v.select("id", *hexed("expected_prev", "this_hash", "computed"), "status")


def merkle(spark, sf_dir):
    configure(spark)
    root = merkle_root(samples.audit_events(spark, sf_dir), leaf="payload_hash")
    return root.select("leaves", *hexed("root"))


def merkle_shared_dates(spark, sf_dir):
    configure(spark)
    orders = samples.order_events(spark, sf_dir)
    root = merkle_root(orders, leaf="payload_hash", minutes=_WEEK, max_rows=_WEEK_ROWS)
    return root.select("leaves", *hexed("root"))


def _merkle_sql(table, leaf, order):
    return f"""WITH RECURSIVE
leaves AS (SELECT list(sha256({leaf}) ORDER BY {order}) AS h, count(*) AS leaves FROM {table}),
t AS (
  SELECT h, leaves FROM leaves
  UNION ALL
  SELECT list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i = len(h) THEN h[i]
      ELSE sha256(unhex(h[i]) || unhex(h[i + 1])) END), leaves
  FROM t WHERE len(h) > 1)
SELECT leaves, h[1] AS root FROM t WHERE len(h) = 1"""


def _anchor_columns(df):
    return df.select("id", micros("anchored_at"), *hexed("root_hash"), "last_event_id", micros("last_event_ts"), "event_count")


def anchor_windows(spark, sf_dir):
    return _anchor_columns(anchor.make_anchors(chained(spark, sf_dir)))


def anchors_in_window(spark, sf_dir):
    a = anchor.anchors_between(
        anchors(spark, sf_dir), datetime(2024, 1, 4, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc)
    )
    return a.select("id", micros("anchored_at"), *hexed("root_hash"), "event_count")


def anchor_check(spark, sf_dir):
    """Anchors against a table whose last event of each odd day is gone."""
    a = anchors(spark, sf_dir)
    lost = a.where(F.dayofmonth("last_event_ts") % 2 == 1).select(F.col("last_event_id").alias("id"))
    left = chained(spark, sf_dir).join(lost, "id", "left_anti")
    return anchor.check_anchors(a, left).select("id", "mismatch", "recomputed_ok")


def _anchors_before(spark, sf_dir, day):
    return anchors(spark, sf_dir).where(F.col("anchored_at") <= F.lit(datetime(2024, 1, day, tzinfo=timezone.utc)))


def anchored_flags(spark, sf_dir):
    return anchor.with_anchored(chained(spark, sf_dir), _anchors_before(spark, sf_dir, 11)).select("id", "anchored")


def mark_anchored_count(spark, sf_dir):
    return anchor.newly_anchored(
        chained(spark, sf_dir), _anchors_before(spark, sf_dir, 11), _anchors_before(spark, sf_dir, 21)
    )


def verify_counts(spark, sf_dir):
    return verify_outcomes(chain.verify_chain(samples.tampered(chained(spark, sf_dir))))


_TAMPERED = "ch.n % 1009 = 5"
_BROKEN = "stored this_hash does not match recomputed hash"
_DAILY = """daily AS (
  SELECT 'anchor-' || strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M') AS id,
    date_trunc('day', ts) + INTERVAL 1 DAY AS anchored_at, max_by(this_hash, (ts, id)) AS root_hash,
    max_by(id, (ts, id)) AS last_event_id, max(ts) AS last_event_ts, count(*) AS event_count
  FROM ch GROUP BY date_trunc('day', ts))"""

_SEGMENTS = f""",
s AS (SELECT seg, count(*) AS n, min_by(id, (ts, id)) AS first_id, max_by(id, (ts, id)) AS last_id,
    max_by(this_hash, (ts, id)) AS root FROM ch GROUP BY seg),
b AS (SELECT *, row_number() OVER (ORDER BY seg) AS k,
    {q.lp('seg')} || unhex(printf('%016x', n)) || unhex('00000020') || unhex(root) AS sbody FROM s),
sc AS (
  SELECT k, {q.ZERO} AS prev_segment_hash, {q.link('sbody', q.ZERO)} AS segment_hash FROM b WHERE k = 1
  UNION ALL
  SELECT b.k, sc.segment_hash, {q.link('b.sbody', 'sc.segment_hash')} FROM sc JOIN b ON b.k = sc.k + 1)"""

QUERIES = {
    "chain_build": (chain_build, q.CHAIN + " SELECT id, seg, pos, prev_hash, this_hash FROM ch"),
    "chain_build_split_days": (chain_build_split_days, _split_sql(q.EV.replace(
        ",\n    strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') || '/000000' AS seg", ""), _DAY, _DAY_ROWS)),
    "chain_build_shared_dates": (chain_build_shared_dates, _split_sql(q.ORDERS, _WEEK, _WEEK_ROWS)),
    "verify_chain": (verify_chain, q.CHAIN + " SELECT id, this_hash AS computed, 'ok' AS status FROM ch"),
    "verify_linear": (verify_linear, q.CHAIN + f""",
l AS (SELECT id, prev_hash, lag(this_hash) OVER (ORDER BY ts, id) AS expected FROM ch)
SELECT id, CASE WHEN expected IS NULL OR expected = prev_hash THEN 'ok' ELSE 'gap' END AS status,
  CASE WHEN expected <> prev_hash THEN 'prev_hash linkage broken' END AS reason FROM l"""),
    "tamper_detect": (tamper_detect, q.CHAIN + f"""
SELECT id, seg, pos, 'broken' AS status, '{_BROKEN}' AS reason FROM ch WHERE {_TAMPERED}"""),
    "gap_detect": (gap_detect, q.CHAIN + f""",
k AS (SELECT *, lag(this_hash) OVER (PARTITION BY seg ORDER BY ts, id) AS expected FROM ch WHERE n % 1000 <> 7)
SELECT id, seg, pos, 'gap' AS status, 'prev_hash linkage broken' AS reason FROM k
WHERE prev_hash <> coalesce(expected, {q.ZERO})"""),
    "first_failure": (first_failure, q.CHAIN + f"""
SELECT id, epoch_us(ts) AS ts_us, 'broken' AS status, '{_BROKEN}' AS reason
FROM ch WHERE {_TAMPERED} ORDER BY ts, id LIMIT 1"""),
    "sweep_report": (sweep_report, q.CHAIN + f", {_DAILY}" + f"""
SELECT count(*) AS event_count, 'ok' AS status, CAST(NULL AS VARCHAR) AS first_broken_id,
  CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS reason,
  'sha256:' || max_by(this_hash, (ts, id)) AS root_hash,
  (SELECT count(*) FROM daily WHERE anchored_at BETWEEN TIMESTAMP '2024-01-03 05:30:00' AND TIMESTAMP '2024-01-20') AS anchor_count,
  (SELECT count(*) FROM daily WHERE anchored_at BETWEEN TIMESTAMP '2024-01-03 05:30:00' AND TIMESTAMP '2024-01-20') AS anchors_checked,
  0 AS anchor_mismatches
FROM ch WHERE {_SQL_WINDOW}"""),
    "sweep_tampered": (sweep_tampered, q.CHAIN + f""", {_DAILY},
numbered AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS position FROM ch),
bad AS (SELECT id, position FROM numbered AS ch WHERE {_TAMPERED} ORDER BY position LIMIT 1)
SELECT (SELECT count(*) FROM ch) AS event_count, 'broken' AS status, id AS first_broken_id, position,
  '{_BROKEN}' AS reason, CAST(NULL AS VARCHAR) AS root_hash,
  (SELECT count(*) FROM daily) AS anchor_count, (SELECT count(*) FROM daily) AS anchors_checked,
  0 AS anchor_mismatches
FROM bad"""),
    "chain_linkage": (chain_linkage, q.CHAIN + f"""
SELECT id, coalesce(lag(this_hash) OVER (ORDER BY ts, id), {q.ZERO}) AS previous FROM ch"""),
    "chain_position": (chain_position, f"WITH {q.EV} SELECT id, row_number() OVER (ORDER BY ts, id) AS position FROM ev"),
    "position_shared_dates": (position_shared_dates, f"WITH {q.ORDERS} SELECT id, row_number() OVER (ORDER BY ts, id) AS position FROM ev"),
    "chain_head": (chain_head, q.CHAIN + """
SELECT seg, max_by(id, (ts, id)) AS id, max(pos) AS pos, max_by(this_hash, (ts, id)) AS this_hash FROM ch GROUP BY seg"""),
    "chain_head_overall": (chain_head_overall, q.CHAIN + """
SELECT id, epoch_us(ts) AS ts_us, this_hash FROM ch ORDER BY ts DESC, id DESC LIMIT 1"""),
    "chain_root": (chain_root, q.CHAIN + " SELECT count(*) AS event_count, max_by(this_hash, (ts, id)) AS root FROM ch"),
    "segment_chain": (segment_chain, q.CHAIN + _SEGMENTS + """
SELECT seg, n, first_id, last_id, root, prev_segment_hash, segment_hash FROM b JOIN sc USING (k)"""),
    "sweep_sealed": (sweep_sealed, q.CHAIN + _SEGMENTS + """
SELECT (SELECT count(*) FROM ch) AS event_count, 'ok' AS status, CAST(NULL AS VARCHAR) AS first_broken_id,
  CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS reason,
  'sha256:' || (SELECT max_by(this_hash, (ts, id)) FROM ch) AS root_hash,
  'sha256:' || (SELECT max_by(segment_hash, k) FROM sc) AS segment_root"""),
    "sweep_lost_segment": (sweep_lost_segment, f"""WITH {q.EV}, lost AS (SELECT * FROM ev WHERE seg = '{_LOST}')
SELECT (SELECT count(*) FROM ev WHERE seg <> '{_LOST}') AS event_count, 'gap' AS status,
  min_by(id, (ts, id)) AS first_broken_id,
  (SELECT count(*) FROM ev WHERE ts < (SELECT min(ts) FROM lost)) AS position,
  'sealed segment missing' AS reason, CAST(NULL AS VARCHAR) AS root_hash, CAST(NULL AS VARCHAR) AS segment_root
FROM lost HAVING count(*) > 0
UNION ALL
SELECT (SELECT count(*) FROM ev), 'none lost', NULL, NULL, NULL, NULL, NULL FROM lost HAVING count(*) = 0"""),
    "sweep_forged_segment": (sweep_forged_segment, f"""WITH {q.EV}, lost AS (SELECT * FROM ev WHERE seg = '{_LOST}')
SELECT (SELECT count(*) FROM ev) AS event_count, 'broken' AS status, min_by(id, (ts, id)) AS first_broken_id,
  (SELECT count(*) FROM ev WHERE ts < (SELECT min(ts) FROM lost)) + 1 AS position,
  'sealed segment changed' AS reason, CAST(NULL AS VARCHAR) AS root_hash, CAST(NULL AS VARCHAR) AS segment_root
FROM lost HAVING count(*) > 0"""),
    "anchor_lost_segment": (anchor_lost_segment, f"""WITH {q.EV}
SELECT 'anchor-' || strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M') AS id, max_by(id, (ts, id)) AS last_event_id,
  count(*) AS event_count, max(seg) >= '{_LOST}' AS mismatch
FROM ev GROUP BY date_trunc('day', ts)"""),
    "anchor_signatures": (anchor_signatures, f"""WITH {q.EV}
SELECT DISTINCT 'anchor-' || strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M') AS id, 'k1' AS key_id,
  date_trunc('day', ts) <> TIMESTAMP '2024-01-05' AS signature_ok FROM ev"""),
    "segment_check": (segment_check, f"""WITH {q.EV}, s AS (SELECT seg, count(*) AS n FROM ev GROUP BY seg)
SELECT CASE WHEN seg BETWEEN '2024-01-02T00:00/' AND '2024-01-02T12' THEN 'missing' ELSE 'ok' END AS status,
  count(*) AS segments, CAST(sum(n) AS BIGINT) AS sealed_events FROM s GROUP BY 1"""),
    "canonical_bytes": (canonical_bytes, f"WITH {q.EV} SELECT id, lower(hex({q.BODY})) AS body FROM ev"),
    "event_hash": (event_hash_genesis, f"""WITH ev AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(20, 2))) AS id,
    epoch_us(l_shipdate) * 1000 AS ts_ns, 'shipping' AS source_service, 'supp_' || l_suppkey AS actor_id,
    'ship.' || l_linestatus AS action, 'order' AS target_type, CAST(l_orderkey AS VARCHAR) AS target_id,
    sha256(l_returnflag) AS ph FROM lineitem)
SELECT id, {q.link(q.BODY, q.ZERO)} AS this_hash FROM ev"""),
    "verify_event": (verify_event, q.CHAIN + f""",
l AS (SELECT *, coalesce(lag(this_hash) OVER (PARTITION BY seg ORDER BY ts, id), {q.ZERO}) AS expected_prev FROM ch),
t AS (SELECT * REPLACE (CASE WHEN n % 1009 = 5 THEN 'tampered' ELSE actor_id END AS actor_id) FROM l),
v AS (SELECT *, {q.link(q.BODY, 'prev_hash')} AS computed FROM t WHERE n % 20 = 0)
SELECT id, expected_prev, this_hash, computed, CASE WHEN computed = this_hash THEN 'ok' ELSE 'broken' END AS status FROM v"""),
    "merkle_root": (merkle, _merkle_sql("events", "props", "ts, event_id")),
    "merkle_shared_dates": (merkle_shared_dates, _merkle_sql("orders", "o_orderpriority", "o_orderdate, o_orderkey")),
    "anchor_windows": (anchor_windows, q.CHAIN + """
SELECT 'anchor-' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') AS id,
  epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) AS anchored_at_us, max_by(this_hash, (ts, id)) AS root_hash,
  max_by(id, (ts, id)) AS last_event_id, epoch_us(max(ts)) AS last_event_ts_us, count(*) AS event_count
FROM ch GROUP BY date_trunc('hour', ts)"""),
    "anchors_in_window": (anchors_in_window, q.CHAIN + f""", {_DAILY}
SELECT id, epoch_us(anchored_at) AS anchored_at_us, root_hash, event_count FROM daily
WHERE anchored_at BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-20'"""),
    "anchor_check": (anchor_check, q.CHAIN + f""", {_DAILY}
SELECT id, day(last_event_ts) % 2 = 1 AS mismatch, day(last_event_ts) % 2 = 0 AS recomputed_ok FROM daily"""),
    "anchored_flags": (anchored_flags, f"WITH {q.EV} SELECT id, ts < TIMESTAMP '2024-01-11' AS anchored FROM ev"),
    "mark_anchored_count": (mark_anchored_count, """SELECT count(*) AS newly_anchored FROM events
WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'"""),
    "verify_outcomes": (verify_counts, """SELECT CASE WHEN event_id % 1009 = 5 THEN 'broken' ELSE 'ok' END AS status,
  count(*) AS events FROM events GROUP BY 1"""),
}
