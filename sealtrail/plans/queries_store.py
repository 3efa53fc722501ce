"""Registered queries over stores that grow batch by batch: sealing, Merkle log, incremental sweeps."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sealtrail.operators import incremental, merkle_log
from sealtrail.operators.sweep import REPORT_COLUMNS
from sealtrail.plans import oracle as q
from sealtrail.plans.inputs import AS_OF, anchors, chained, hexed, micros
from sealtrail.plans.queries_chain import _BROKEN, _DAILY, _SEGMENTS, _TAMPERED
from sealtrail.session import configure
from sealtrail.sources import samples
from sealtrail.sources.tables import scratch_store
from sealtrail.streaming.committed import drained
from sealtrail.streaming.sealing import start_sealing

_DELAY = timedelta(hours=6)
_HOUR = 3_600_000_000


def _arrivals(spark, sf_dir):
    """``events`` as accepted, with ``batch``: they arrive up to ``_DELAY`` late, in twelve-day batches."""
    e = samples.audit_events(spark, sf_dir, dealt=True)
    late = F.pmod(F.xxhash64("id"), F.lit(int(_DELAY.total_seconds() * 999_000)))  # microseconds, below the delay
    batch = F.floor((F.unix_micros("ts") + late) / (12 * 24 * _HOUR)).cast("bigint")
    return e.withColumns({"legal_hold_initial": F.lit(False), "ingested_at": F.lit(AS_OF), "batch": batch})


def _batches(rows):
    return [r[0] for r in rows.select("batch").distinct().orderBy("batch").collect()]  # a few per month


def stream_sealed_segments(spark, sf_dir):
    """Interleaved arrivals, chained and sealed by the stream as the watermark passes them."""
    configure(spark)
    rows, store = _arrivals(spark, sf_dir), scratch_store(spark, "sealed")
    for number, batch in enumerate(_batches(rows)):
        store.write_batch(rows.where(F.col("batch") == batch), "arrivals", number)
        drained(start_sealing(spark, store, f"{store.root}-checkpoint", f"{int(_DELAY.total_seconds())} seconds", clock=lambda: AS_OF))
    sealed = store.read(spark, "segments")
    links = store.read(spark, "audit_events").groupBy("seg").agg(F.count(F.lit(1)).alias("stored"))
    return sealed.join(links, "seg").select("seg", "n", "stored", "first_id", "last_id", *hexed("root", "segment_hash"))


_CHUNK = "epoch_us(ts) // (7 * 24 * 3600000000)"


def _grown(spark, sf_dir):
    """A tree over the chained events, appended week by week; (week, leaves, root) of each step."""
    rows = chained(spark, sf_dir).withColumn("batch", F.floor(F.unix_micros("ts") / (7 * 24 * _HOUR)).cast("bigint"))
    store, steps = scratch_store(spark, "tree"), []
    for number, batch in enumerate(_batches(rows)):
        with store.begin(spark, "tree", number) as tx:
            peaks = merkle_log.append(tx, rows.where(F.col("batch") == batch))
        steps.append((batch, merkle_log.leaves_of(peaks), merkle_log.root_of(peaks).hex()))
    return store, steps


def merkle_append(spark, sf_dir):
    _, steps = _grown(spark, sf_dir)
    return spark.createDataFrame(steps, "week bigint, leaves bigint, root string")


def merkle_proofs(spark, sf_dir):
    """Proofs of the events on the hold log; the hash of every 60th event is forged."""
    store, _ = _grown(spark, sf_dir)
    found = merkle_log.proofs(spark, store, samples.hold_log(spark, sf_dir))
    number = F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint")
    forged = found.withColumn("hash", F.when(number % 60 == 0, F.unhex(F.sha2("hash", 256))).otherwise(F.col("hash")))
    checked = merkle_log.check_proofs(forged, merkle_log.root_of(merkle_log.peaks_of(store.log.state())))
    path = F.array_join(F.transform("path", lambda s: F.concat(F.when(s["left"], "l").otherwise("r"), F.lower(F.hex(s["hash"])))), " ")
    return checked.select("id", "leaf", path.alias("path"), "holds")


def _swept(spark, sf_dir, spoil=None):
    """The report after a first sweep has remembered all segments of a store and ``spoil`` changed one folder."""
    store = scratch_store(spark, "swept")
    rows = chained(spark, sf_dir).withColumns({"legal_hold_initial": F.lit(False), "ingested_at": F.lit(AS_OF)})
    for number in range(3):
        store.write_batch(rows.where(F.dayofmonth("ts") % 3 == number), "audit_events", number)
    events = store.read(spark, "audit_events")
    _, remembered = incremental.sweep_incremental(events, store.read(spark, "verified_segments"), AS_OF)
    store.append(remembered, "verified_segments", "first")
    if spoil is not None:
        folder = store.log.state().folders("audit_events")[1]
        with store.begin(spark, "spoiler", 0) as tx:
            tx.write(spoil(store._rows(spark, "audit_events", [folder])), "audit_events", rewrites=[folder])
    verified = store.read(spark, "verified_segments")
    report, _ = incremental.sweep_incremental(
        store.read(spark, "audit_events"), verified, AS_OF + timedelta(hours=1), anchors(spark, sf_dir)
    )
    return report.select(*[c for c in REPORT_COLUMNS if c in _REPORT])


_REPORT = ("event_count", "status", "first_broken_id", "position", "reason", "root_hash", "anchor_count", "anchor_mismatches")


def sweep_incremental(spark, sf_dir):
    return _swept(spark, sf_dir)


def sweep_incremental_tampered(spark, sf_dir):
    """Every 1009th event of a folder has another actor since the last sweep."""
    return _swept(spark, sf_dir, samples.tampered)


def compacted_chain(spark, sf_dir):
    """Rows of a store whose three folders were merged after the second of them failed once."""
    store = scratch_store(spark, "compacted")
    rows = chained(spark, sf_dir).withColumns({"legal_hold_initial": F.lit(False), "ingested_at": F.lit(AS_OF)})
    for number in range(3):
        part = rows.where(F.col("pos") % 3 == number)
        if number == 1:
            tx = store.begin(spark, "audit_events", number)
            tx.write(part, "audit_events")  # never committed
        store.write_batch(part, "audit_events", number)
    store.compact(spark, "audit_events")
    return store.read(spark, "audit_events").select("id", "seg", "pos", *hexed("prev_hash", "this_hash"), micros("ingested_at"))



QUERIES = {
    "stream_sealed_segments": (stream_sealed_segments, q.CHAIN + _SEGMENTS.replace("FROM ch GROUP BY seg)", f"""FROM ch
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR < (SELECT max(ts) FROM ch) - INTERVAL {int(_DELAY.total_seconds())} SECOND GROUP BY seg)""") + """
SELECT seg, n, n AS stored, first_id, last_id, root, segment_hash FROM b JOIN sc USING (k)"""),
    "merkle_append": (merkle_append, q.CHAIN + f""",
w AS (SELECT DISTINCT {_CHUNK} AS week FROM ch),
t AS (
  SELECT week, list(this_hash ORDER BY ts, id) AS h, count(*) AS leaves FROM w JOIN ch ON {_CHUNK} <= week GROUP BY week
  UNION ALL
  SELECT week, list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i = len(h) THEN h[i]
      ELSE sha256(unhex(h[i]) || unhex(h[i + 1])) END), leaves
  FROM t WHERE len(h) > 1)
SELECT week, leaves, h[1] AS root FROM t WHERE len(h) = 1"""),
    "merkle_proofs": (merkle_proofs, q.CHAIN + f""",
lists AS (
  SELECT 0 AS level, list(this_hash ORDER BY ts, id) AS h FROM ch
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: CASE WHEN i = len(h) THEN h[i]
      ELSE sha256(unhex(h[i]) || unhex(h[i + 1])) END)
  FROM lists WHERE len(h) > 1),
lf AS (SELECT id, n, row_number() OVER (ORDER BY ts, id) - 1 AS leaf FROM ch),
steps AS (
  SELECT id, level, leaf >> level AS i, h FROM lf JOIN lists ON len(h) > 1 WHERE n % 20 = 0),
beside AS (
  SELECT id, level, CASE WHEN i % 2 = 1 THEN 'l' || h[i] ELSE 'r' || h[i + 2] END AS step
  FROM steps WHERE i % 2 = 1 OR i + 2 <= len(h))
SELECT id, any_value(leaf) AS leaf, string_agg(step, ' ' ORDER BY level) AS path, any_value(n) % 60 <> 0 AS holds
FROM beside JOIN lf USING (id) GROUP BY id"""),
    "sweep_incremental": (sweep_incremental, q.CHAIN + f""",
{_DAILY}
SELECT count(*) AS event_count, 'ok' AS status, CAST(NULL AS VARCHAR) AS first_broken_id, CAST(NULL AS BIGINT) AS position,
  CAST(NULL AS VARCHAR) AS reason, 'sha256:' || max_by(this_hash, (ts, id)) AS root_hash,
  (SELECT count(*) FROM daily) AS anchor_count, 0::BIGINT AS anchor_mismatches FROM ch"""),
    "sweep_incremental_tampered": (sweep_incremental_tampered, q.CHAIN + f""",
{_DAILY},
bad AS (SELECT min_by(id, (ts, id)) AS id, min(ts) AS ts FROM ch WHERE {_TAMPERED} AND dayofmonth(ts) % 3 = 1)
SELECT count(*) AS event_count, CASE WHEN any_value(bad.id) IS NULL THEN 'ok' ELSE 'broken' END AS status, any_value(bad.id) AS first_broken_id,
  CASE WHEN any_value(bad.id) IS NOT NULL THEN count(*) FILTER ((ch.ts, ch.id) <= (bad.ts, bad.id)) END AS position,
  CASE WHEN any_value(bad.id) IS NOT NULL THEN '{_BROKEN}' END AS reason,
  CASE WHEN any_value(bad.id) IS NULL THEN 'sha256:' || max_by(this_hash, (ch.ts, ch.id)) END AS root_hash,
  (SELECT count(*) FROM daily) AS anchor_count, 0::BIGINT AS anchor_mismatches FROM ch CROSS JOIN bad"""),
    "compacted_chain": (compacted_chain, q.CHAIN + f"""
SELECT id, seg, pos, prev_hash, this_hash, epoch_us({q.AS_OF}) AS ingested_at_us FROM ch"""),
}
