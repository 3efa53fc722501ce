"""DuckDB building blocks for the twins of the registered queries."""


def lp(c: str) -> str:
    return f"unhex(printf('%08x', octet_length(encode({c})))) || encode({c})"


ZERO = "repeat('0', 64)"

BODY = " || ".join(
    [lp("id"), "unhex(printf('%016x', ts_ns))"]
    + [lp(c) for c in ("source_service", "actor_id", "action", "target_type", "target_id")]
    + ["unhex('00000020') || unhex(ph)"]
)


def link(body: str, prev: str) -> str:
    return f"sha256({body} || unhex('00000020') || unhex({prev}))"


def uuid(n: str) -> str:
    return f"printf('%08x-0000-7000-8000-%012x', {n}, {n})"


EV = f"""ev AS (
  SELECT {uuid('event_id')} AS id, event_id AS n, ts, epoch_us(ts) * 1000 AS ts_ns,
    event_type AS source_service, 'user_' || user_id AS actor_id, event_type AS action,
    'user' AS target_type, CAST(user_id AS VARCHAR) AS target_id, sha256(props) AS ph, props,
    strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') || '/000000' AS seg
  FROM events)"""

ORDERS = f"""ev AS (
  SELECT {uuid('o_orderkey')} AS id, o_orderdate AS ts, epoch_us(o_orderdate) * 1000 AS ts_ns,
    'orders' AS source_service, 'cust_' || o_custkey AS actor_id, 'order.' || o_orderstatus AS action,
    'order' AS target_type, CAST(o_orderkey AS VARCHAR) AS target_id, sha256(o_orderpriority) AS ph
  FROM orders)"""


def chain_of(source: str) -> str:
    """Chained rows ``ch`` of a source CTE list that ends in ``ev`` with a ``seg`` column."""
    return f"""WITH RECURSIVE {source},
o AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY ts, id) AS pos, {BODY} AS body FROM ev),
c AS (
  SELECT seg, pos, {ZERO} AS prev_hash, {link('body', ZERO)} AS this_hash FROM o WHERE pos = 1
  UNION ALL
  SELECT o.seg, o.pos, c.this_hash, {link('o.body', 'c.this_hash')}
  FROM c JOIN o ON o.seg = c.seg AND o.pos = c.pos + 1),
ch AS (SELECT o.*, c.prev_hash, c.this_hash FROM o JOIN c USING (seg, pos))"""


CHAIN = chain_of(EV)


def split_segments(source: str, minutes: int, max_rows: int, threshold: str, oversample: int) -> str:
    """``source`` (CTE text ending in ``ev``) renamed and cut at content-defined splits."""
    width = minutes * 60_000_000
    return f"""{source.replace('ev AS (', 'raw AS (', 1)},
bucketed AS (SELECT *, epoch_us(ts) // {width} AS bucket FROM raw),
sized AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS bucket_rows FROM bucketed),
candidates AS (
  SELECT bucket, ts, id, row_number() OVER (PARTITION BY bucket ORDER BY ts, id) AS rank
  FROM sized WHERE bucket_rows > {max_rows} AND sha256(id) < '{threshold}'),
splits AS (SELECT bucket, ts, id FROM candidates WHERE rank % {oversample} = 0),
marked AS (
  SELECT s.* EXCLUDE (bucket_rows), p.id IS NOT NULL AS is_split
  FROM sized s LEFT JOIN splits p ON s.bucket = p.bucket AND s.id = p.id),
ev AS (
  SELECT * EXCLUDE (is_split),
    strftime(make_timestamp(bucket * {width}), '%Y-%m-%dT%H:%M') || '/' || printf('%06d',
      CAST(count(*) FILTER (is_split) OVER (PARTITION BY bucket ORDER BY ts, id) AS INTEGER)) AS seg
  FROM marked)"""


RFC3339 = (
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
    "regexp_replace('.' || printf('%09d', ts_ns % 1000000000), '\\.?0+$', '') || 'Z'"
)

HOLDS = f"""holds AS (
  SELECT {uuid('event_id')} AS id, true AS hold, ts AS changed_at FROM events WHERE event_id % 20 = 0
  UNION ALL
  SELECT {uuid('event_id')}, false, ts + INTERVAL 1 DAY FROM events WHERE event_id % 40 = 0)"""

INVENTORY = f"""payloads AS (
  SELECT {uuid('event_id')} AS payload_ref, props AS body,
    CASE WHEN event_id % 3 = 0 THEN 'GLACIER' ELSE 'STANDARD' END AS storage_class,
    event_id % 40 AS retention_days, event_id % 50 = 0 AS legal_hold, ts AS created_at,
    to_microseconds(CAST(86400000000 AS BIGINT) * (event_id % 40)) AS kept_for
  FROM events)"""

AS_OF = "TIMESTAMP '2024-02-01'"
RETAINED = f"(legal_hold OR (retention_days > 0 AND {AS_OF} < created_at + kept_for))"

# Verdicts on the wire messages, from the defects put into them.
WIRE = f"""first AS (
  SELECT *, CASE WHEN event_id % 71 = 0 THEN '[1, 2]' ELSE props END AS payload FROM events),
wire AS (
  SELECT *, event_id % 8 AS partition, event_id AS "offset" FROM first
  UNION ALL
  SELECT *, event_id % 8, event_id + 1000000000000 FROM first WHERE event_id % 10 = 0),
judged AS (
  SELECT *, {uuid('event_id')} AS id,
    CASE WHEN event_id % 73 = 0 THEN 'decode: event: decode: malformed envelope'
         WHEN event_id % 97 = 0 THEN 'decode: event: invalid: missing actor_id'
         WHEN event_id % 89 = 0 THEN 'decode: event: invalid: missing target_id'
         WHEN event_id % 83 = 0 AND event_id % 79 <> 0 THEN 'payload_hash mismatch'
         WHEN event_id % 71 = 0 AND event_id % 79 <> 0 AND event_type <> 'error'
           THEN 'redaction: redaction: decode payload: not a JSON object'
         WHEN event_id % 79 = 0
           THEN 'payload_hash format: event: hash "sha256:deadbeef" is 4 bytes, want 32'
    END AS reason
  FROM wire),
verdicts AS (
  SELECT *,
    CASE WHEN reason IS NULL THEN NULL
         WHEN reason LIKE 'decode%' THEN 'decode'
         WHEN reason LIKE 'payload_hash mismatch%' THEN 'payload_hash'
         WHEN reason LIKE 'redaction%' THEN 'redaction'
         ELSE 'payload_hash_format' END AS reject_kind,
    CASE WHEN reason IS NOT NULL THEN 'rejected'
         WHEN row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY partition, "offset") = 1
           THEN 'ingested'
         ELSE 'duplicate' END AS outcome
  FROM judged)"""

# The sample policy's effect on {"k": <number>}.
REDACTED_K = """CASE event_type
  WHEN 'click' THEN '{"k":"sha256:' || sha256(json_extract_string(props, '$.k')) || '"}'
  WHEN 'purchase' THEN '{"k":"*"}'
  WHEN 'view' THEN '{}'
  ELSE props END"""
