"""Registered queries: payload store, retention, holds, exports."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sealtrail.operators import export as x, retention as r
from sealtrail.operators.anchor import with_anchored
from sealtrail.operators.export import latest_runs
from sealtrail.operators.ingest import accepted, as_payloads, first_deliveries
from sealtrail.operators.metrics import exports_by_format
from sealtrail.operators.search import EventQuery, search
from sealtrail.plans import oracle as q
from sealtrail.plans.inputs import AS_OF, anchors, chained, hexed, judged, micros
from sealtrail.session import configure
from sealtrail.sources import samples
from sealtrail.sources.tables import fetch_payloads, recent

QUERY = '{"from": "2024-01-05T00:00:00Z", "to": "not a time", "service": "view", "actor": 7}'


def _inventory(spark, sf_dir):
    configure(spark)
    return samples.payload_inventory(spark, sf_dir)


def payload_put(spark, sf_dir):
    """Bodies of new events whose key is free or no longer retained."""
    new = first_deliveries(accepted(judged(spark, sf_dir)))
    put = r.put_payloads(as_payloads(new, AS_OF), _inventory(spark, sf_dir), AS_OF)
    return put.select(
        "payload_ref", F.decode("body", "UTF-8").alias("body"), "content_type", "storage_class", "retention_days", "legal_hold"
    )


def worm_conflicts(spark, sf_dir):
    new = first_deliveries(accepted(judged(spark, sf_dir)))
    return r.worm_conflicts(as_payloads(new, AS_OF), _inventory(spark, sf_dir), AS_OF)


def payload_fetch(spark, sf_dir):
    """Events against a store without every seventh payload."""
    kept = _inventory(spark, sf_dir).where(F.conv(F.substring("payload_ref", 1, 8), 16, 10).cast("bigint") % 7 != 0)
    found = fetch_payloads(chained(spark, sf_dir), kept)
    return found.select("id", F.decode("body", "UTF-8").alias("body"), "payload_found")


def payload_inventory(spark, sf_dir):
    i = r.inventory(_inventory(spark, sf_dir))
    return i.select("payload_ref", "size", "storage_class", "retention_days", "legal_hold", micros("created_at"))


def retention_state(spark, sf_dir):
    s = r.retention_state(_inventory(spark, sf_dir), AS_OF)
    return s.select("payload_ref", "retained", micros("retained_until"))


def purge_plan(spark, sf_dir):
    return r.purge_plan(_inventory(spark, sf_dir), AS_OF)


def purge_plan_held(spark, sf_dir):
    return r.purge_plan(_inventory(spark, sf_dir), AS_OF, samples.hold_log(spark, sf_dir))


_STEPS = ((20, "STANDARD", "GLACIER"), (25, "GLACIER", "DEEP_ARCHIVE"))


def lifecycle_plan(spark, sf_dir):
    return r.lifecycle_plan(_inventory(spark, sf_dir), AS_OF, _STEPS)


def lifecycle_counts(spark, sf_dir):
    return r.lifecycle_counts(_inventory(spark, sf_dir), datetime(2025, 1, 20, tzinfo=timezone.utc))


def legal_hold_current(spark, sf_dir):
    return r.with_legal_hold(chained(spark, sf_dir), samples.hold_log(spark, sf_dir)).select("id", "legal_hold")


def unknown_holds(spark, sf_dir):
    """Hold log entries of events a filtered table does not have."""
    few = search(chained(spark, sf_dir), EventQuery(service="click"))
    return r.unknown_holds(samples.hold_log(spark, sf_dir), few)


def _flagged(spark, sf_dir):
    held = r.with_legal_hold(chained(spark, sf_dir), samples.hold_log(spark, sf_dir))
    return with_anchored(held, anchors(spark, sf_dir).where(F.col("anchored_at") < F.lit(AS_OF)))


def export_filtered(spark, sf_dir):
    found = search(chained(spark, sf_dir), EventQuery.from_json(QUERY))
    return found.select("id", micros("ts"), *hexed("this_hash"))


def export_csv_rows(spark, sf_dir):
    return x.csv_rows(_flagged(spark, sf_dir))


def export_json_rows(spark, sf_dir):
    return x.json_rows(_flagged(spark, sf_dir))


def _manifest(df):
    return df.select(
        "type", "export_id", "format", "window_from", "window_to", "row_count", "chain_root", "merkle_root",
        "retention_days",
    )


def export_manifest(spark, sf_dir):
    return _manifest(x.manifest(chained(spark, sf_dir), "exp1", "CSV", AS_OF, 100))


def export_manifest_filtered(spark, sf_dir):
    found = search(chained(spark, sf_dir), EventQuery.from_json(QUERY))
    return _manifest(x.manifest(found, "exp2", "JSON", AS_OF))


def _run_log(spark, sf_dir):
    """One export run per order: created on the order date, finished or failed later."""
    configure(spark)
    o = samples.table(spark, sf_dir, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    base = o.select(
        F.concat(F.lit("exp-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit("{}").alias("query"), F.when(F.col("o_orderkey") % 2 == 0, "JSON").otherwise("CSV").alias("format"),
        F.lit(2555).alias("retention_days"), "o_orderkey", "o_orderstatus", created.alias("created_at"),
    )
    start = base.withColumn("status", F.lit("PENDING")).withColumn("row_count", F.lit(0).cast("bigint")).withColumn("changed_at", F.col("created_at"))
    done = (
        base.where("o_orderstatus <> 'P'")
        .withColumn("status", F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("COMPLETE"))
        .withColumn("row_count", F.col("o_orderkey") % 1000)
        .withColumn("changed_at", F.col("created_at") + F.expr("INTERVAL 5 MINUTES") * (F.col("o_orderkey") % 3))
    )
    return start.unionByName(done)


def export_runs_latest(spark, sf_dir):
    latest = latest_runs(_run_log(spark, sf_dir))
    return latest.select("id", "format", "status", "row_count", micros("created_at"), micros("changed_at"))


def export_runs_recent(spark, sf_dir):
    # Runs share dates, so the time alone does not order them; keep what it does order.
    latest = latest_runs(_run_log(spark, sf_dir)).groupBy("created_at").agg(F.count(F.lit(1)).alias("runs"))
    return recent(latest, "created_at").select(micros("created_at"), "runs")


def export_formats(spark, sf_dir):
    return exports_by_format(_run_log(spark, sf_dir), "PENDING")


def exports_complete(spark, sf_dir):
    return exports_by_format(latest_runs(_run_log(spark, sf_dir)))


_PUT_NEW = f"WITH {q.WIRE}, {q.INVENTORY}, new AS (SELECT * FROM verdicts WHERE outcome = 'ingested')"
_STORED = f"(SELECT payload_ref FROM payloads WHERE {q.RETAINED})"

_RUNS = """runs AS (
  SELECT 'exp-' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'JSON' ELSE 'CSV' END AS format,
    CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FAILED' ELSE 'COMPLETE' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey % 1000 END AS row_count, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate ELSE o_orderdate + to_minutes(5 * (o_orderkey % 3)) END AS changed_at
  FROM orders)"""


def _rows_sql(hash_sql, boolean):
    def flag(c):
        return f"CAST({c} AS VARCHAR)" if boolean == "text" else c

    return q.CHAIN + f"""
SELECT id, {q.RFC3339} AS ts, source_service, actor_id, action, target_type, target_id,
  {hash_sql.format(c='ph')} AS payload_hash, {hash_sql.format(c='prev_hash')} AS prev_hash,
  {hash_sql.format(c='this_hash')} AS this_hash, {flag("ts < TIMESTAMP '2024-02-01'")} AS anchored,
  {flag('(n % 20 = 0 AND n % 40 <> 0)')} AS legal_hold, {flag('false')} AS redacted, id AS payload_ref
FROM ch"""


def _manifest_sql(where, export_id, fmt, intact, days):
    root = "'sha256:' || max_by(this_hash, (ts, id))" if intact else f"'sha256:' || {q.ZERO}"
    last = q.RFC3339
    return q.CHAIN + f""",
f AS (SELECT * FROM ch WHERE {where}),
t AS (
  SELECT list(this_hash ORDER BY ts, id) AS h FROM f
  UNION ALL
  SELECT list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i = len(h) THEN h[i]
    ELSE sha256(unhex(h[i]) || unhex(h[i + 1])) END) FROM t WHERE len(h) > 1)
SELECT 'audit-export-manifest' AS type, '{export_id}' AS export_id, '{fmt}' AS format,
  (SELECT {last} FROM f ORDER BY ts, id LIMIT 1) AS window_from,
  (SELECT {last} FROM f ORDER BY ts DESC, id DESC LIMIT 1) AS window_to,
  count(*) AS row_count, {root} AS chain_root, (SELECT 'sha256:' || h[1] FROM t WHERE len(h) = 1) AS merkle_root,
  {days} AS retention_days
FROM f"""


QUERIES = {
    "payload_put": (payload_put, f"""{_PUT_NEW}
SELECT id AS payload_ref, CASE WHEN payload = props THEN {q.REDACTED_K} ELSE payload END AS body,
  'application/json' AS content_type, 'STANDARD' AS storage_class, 2555 AS retention_days, false AS legal_hold
FROM new WHERE id NOT IN {_STORED}"""),
    "worm_conflicts": (worm_conflicts, f"{_PUT_NEW} SELECT id AS payload_ref FROM new WHERE id IN {_STORED}"),
    "payload_fetch": (payload_fetch, f"""WITH {q.EV}
SELECT id, CASE WHEN n % 7 <> 0 THEN props END AS body, n % 7 <> 0 AS payload_found FROM ev"""),
    "payload_inventory": (payload_inventory, f"""WITH {q.INVENTORY}
SELECT payload_ref, octet_length(encode(body)) AS size, storage_class, retention_days, legal_hold,
  epoch_us(created_at) AS created_at_us FROM payloads"""),
    "retention_state": (retention_state, f"""WITH {q.INVENTORY}
SELECT payload_ref, {q.RETAINED} AS retained,
  CASE WHEN retention_days > 0 THEN epoch_us(created_at + kept_for) END AS retained_until_us FROM payloads"""),
    "purge_plan": (purge_plan, f"""WITH {q.INVENTORY}
SELECT payload_ref, CASE WHEN {q.RETAINED} THEN 'refuse' ELSE 'purge' END AS decision,
  CASE WHEN legal_hold THEN 'legal hold' WHEN {q.RETAINED} THEN 'retention active' END AS reason FROM payloads"""),
    "purge_plan_held": (purge_plan_held, f"""WITH {q.INVENTORY}, {q.HOLDS},
h AS (SELECT id, max_by(hold, (changed_at, hold)) AS hold FROM holds GROUP BY id),
p AS (SELECT payloads.* REPLACE (coalesce(hold, legal_hold) AS legal_hold) FROM payloads LEFT JOIN h ON id = payload_ref)
SELECT payload_ref, CASE WHEN {q.RETAINED} THEN 'refuse' ELSE 'purge' END AS decision,
  CASE WHEN legal_hold THEN 'legal hold' WHEN {q.RETAINED} THEN 'retention active' END AS reason FROM p"""),
    "lifecycle_plan": (lifecycle_plan, f"""WITH {q.INVENTORY}, p AS (
  SELECT payload_ref, storage_class,
    CASE WHEN storage_class = 'STANDARD' AND created_at <= {q.AS_OF} - INTERVAL 20 DAY THEN 'GLACIER'
         WHEN storage_class = 'GLACIER' AND created_at <= {q.AS_OF} - INTERVAL 25 DAY THEN 'DEEP_ARCHIVE' END AS next_class
  FROM payloads)
SELECT * FROM p WHERE next_class IS NOT NULL"""),
    "lifecycle_counts": (lifecycle_counts, f"""WITH {q.INVENTORY}, p AS (
  SELECT storage_class,
    CASE WHEN storage_class = 'STANDARD' AND created_at <= TIMESTAMP '2025-01-20' - INTERVAL 90 DAY THEN 'GLACIER'
         WHEN storage_class = 'GLACIER' AND created_at <= TIMESTAMP '2025-01-20' - INTERVAL 365 DAY THEN 'DEEP_ARCHIVE' END AS next_class
  FROM payloads)
SELECT storage_class, next_class, count(*) AS transitions FROM p WHERE next_class IS NOT NULL GROUP BY 1, 2"""),
    "legal_hold_current": (legal_hold_current, f"""WITH {q.EV}
SELECT id, n % 20 = 0 AND n % 40 <> 0 AS legal_hold FROM ev"""),
    "unknown_holds": (unknown_holds, f"""WITH {q.EV}
SELECT id FROM ev WHERE n % 20 = 0 AND source_service <> 'click'"""),
    "export_filtered": (export_filtered, q.CHAIN + """
SELECT id, epoch_us(ts) AS ts_us, this_hash FROM ch WHERE ts >= TIMESTAMP '2024-01-05' AND source_service = 'view'"""),
    "export_csv_rows": (export_csv_rows, _rows_sql("'sha256:' || {c}", "text")),
    "export_json_rows": (export_json_rows, _rows_sql("to_base64(unhex({c}))", "boolean")),
    "export_manifest": (export_manifest, _manifest_sql("true", "exp1", "CSV", True, 100)),
    "export_manifest_filtered": (export_manifest_filtered, _manifest_sql(
        "ts >= TIMESTAMP '2024-01-05' AND source_service = 'view'", "exp2", "JSON", False, 2555)),
    "export_runs_latest": (export_runs_latest, f"""WITH {_RUNS}
SELECT id, format, status, row_count, epoch_us(created_at) AS created_at_us, epoch_us(changed_at) AS changed_at_us FROM runs"""),
    "export_runs_recent": (export_runs_recent, f"""WITH {_RUNS}
SELECT epoch_us(created_at) AS created_at_us, count(*) AS runs FROM runs GROUP BY created_at ORDER BY created_at DESC LIMIT 100"""),
    "export_formats": (export_formats, f"WITH {_RUNS} SELECT format, count(*) AS exports FROM runs GROUP BY format"),
    "exports_complete": (exports_complete, f"""WITH {_RUNS}
SELECT format, count(*) AS exports FROM runs WHERE status = 'COMPLETE' GROUP BY format"""),
}
