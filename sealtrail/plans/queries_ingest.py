"""Registered queries: decoding, validation, hashes, verdicts, redaction."""

from functools import reduce

from pyspark.sql import functions as F

from sealtrail.functions import hashing as h, text as t
from sealtrail.operators import ingest as i, metrics as m, redact as r
from sealtrail.operators.chain import build_chain, segment_heads
from sealtrail.plans import oracle as q
from sealtrail.plans.inputs import (
    AS_OF,
    ORDER_POLICY_TEXT,
    POLICY_TEXT,
    chained,
    hexed,
    judged,
    micros,
    policy,
)
from sealtrail.session import configure
from sealtrail.sources import samples
from sealtrail.sources.id_index import IdIndex
from sealtrail.sources.scratch import stored
from sealtrail.sources.tables import recent, scratch_store


def _text(c):
    return F.decode(c, "UTF-8")


def decode_envelope(spark, sf_dir):
    configure(spark)
    d = i.decode(samples.wire_messages(spark, sf_dir))
    return d.select(
        "partition", "offset", "id", micros("ts"), "source_service", "actor_id", "action", "target_type",
        "target_id", "payload_hash", _text("payload").alias("payload"), "error",
    )


def validate_reasons(spark, sf_dir):
    configure(spark)
    d = i.decode(samples.wire_messages(spark, sf_dir)).where("error IS NULL")
    return d.select(i.missing_field().alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def parse_rfc3339(spark, sf_dir):
    """Shipping dates in several textual shapes, only some of them strict RFC 3339."""
    configure(spark)
    li = samples.table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    shapes = F.array(
        F.concat(day, F.lit("T10:20:30.123456789Z")),
        F.concat(day, F.lit("T10:20:30+02:00")),
        F.concat(day, F.lit(" 10:20:30Z")),
        F.concat(day, F.lit("T10:20:30")),
        day,
    )
    text = F.get(shapes, F.col("l_linenumber") % 5)
    c = li.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    return c.select(
        "l_orderkey", "l_linenumber", "l_partkey", "text",
        F.unix_micros(t.parse_rfc3339("text")).alias("ts_us"), t.rfc3339_nanos("text").alias("ts_ns"),
    )


def _hash_texts(spark, sf_dir):
    """Order keys' hashes in several shapes: prefixed, bare, upper case, short, no hex."""
    configure(spark)
    o = samples.table(spark, sf_dir, "orders")
    digest = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    shapes = F.array(
        F.concat(F.lit("sha256:"), digest), digest, F.upper(digest), F.substring(digest, 1, 10),
        F.concat(F.lit("sha256:"), F.lit("x"), digest), F.lit(""),
    )
    return o.select("o_orderkey", F.get(shapes, (F.col("o_orderkey") % 6).cast("int")).alias("text"))


_HASH_TEXTS = """texts AS (
  SELECT o_orderkey, d, [('sha256:' || d), d, upper(d), substr(d, 1, 10), ('sha256:x' || d), ''][o_orderkey % 6 + 1] AS text
  FROM (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS d FROM orders))"""


def normalize_hash(spark, sf_dir):
    return _hash_texts(spark, sf_dir).select("o_orderkey", "text", h.normalize_hash("text").alias("normal"))


def decode_hash(spark, sf_dir):
    return _hash_texts(spark, sf_dir).select("o_orderkey", h.hex_text(h.hash_to_bytes("text")).alias("bytes"))


def encode_hash(spark, sf_dir):
    return _hash_texts(spark, sf_dir).select(
        "o_orderkey", h.hash_to_text(F.coalesce(h.hash_to_bytes("text"), F.lit(b"short"))).alias("encoded")
    )


def payload_hash(spark, sf_dir):
    configure(spark)
    docs = samples.table(spark, sf_dir, "documents")
    return docs.select("doc_id", h.payload_hash("text").alias("payload_hash"))


def payload_mismatch(spark, sf_dir):
    found = judged(spark, sf_dir).where(F.col("reject_kind") == i.PAYLOAD_HASH)
    return found.select("id", "partition", "offset", "reject_reason")


def _outcomes(spark, sf_dir):
    return i.outcomes(judged(spark, sf_dir))


def ingest_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("partition", "offset", "outcome", "reject_kind", "reject_reason")


def _new_events(spark, sf_dir):
    return i.first_deliveries(i.accepted(judged(spark, sf_dir)))


def ingest_accept(spark, sf_dir):
    e = i.as_events(_new_events(spark, sf_dir), AS_OF)
    return e.select(
        "id", micros("ts"), "actor_id", *hexed("payload_hash"), "payload_ref", "redacted", "legal_hold_initial",
        micros("ingested_at"),
    )


def ingest_dedup(spark, sf_dir):
    """Arriving copies against a store whose index already has every third event, added in five batches."""
    number = F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint")
    stored = chained(spark, sf_dir).where(number % 3 == 0)
    index = IdIndex(scratch_store(spark, "dedup"))
    for batch in range(5):
        with index.store.begin(spark, "ingest", batch) as tx:
            index.add(tx, stored.where(number % 5 == batch).select("id"))
    index.merge(spark)
    messages = i.accepted(judged(spark, sf_dir))
    return i.dedup_known(messages, index.known(messages)).select("id", "partition", "offset")


def ingest_chain(spark, sf_dir):
    """Accepted first deliveries, chained."""
    return build_chain(i.as_events(_new_events(spark, sf_dir), AS_OF)).select("id", "seg", "pos", *hexed("this_hash"))


def _late_rule():
    return F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 71 == 0


def late_events(spark, sf_dir):
    """Every 71st event arrives after its hour has been chained."""
    configure(spark)
    events = samples.audit_events(spark, sf_dir)
    sealed = build_chain(events.where(~_late_rule()))
    second = build_chain(events.where(_late_rule()), heads=segment_heads(sealed), batch="000000000001")
    return second.select("id", "seg", "pos", *hexed("prev_hash", "this_hash"))


def chain_extend(spark, sf_dir):
    """Second half of each hour continues the chain of the first half."""
    configure(spark)
    events = samples.audit_events(spark, sf_dir)
    early = F.minute("ts") < 30
    heads = segment_heads(build_chain(events.where(early)))
    return build_chain(events.where(~early), heads=heads, batch="1").select("id", "seg", "pos", *hexed("prev_hash", "this_hash"))


def dead_letters(spark, sf_dir):
    d = i.as_dead_letters(judged(spark, sf_dir), AS_OF)
    return d.select("topic", "partition", "offset", "key", F.octet_length("payload").alias("size"), "reason")


def dead_letters_recent(spark, sf_dir):
    # Rejected at distinct times, as in a running system: a copy right after its original.
    original = F.col("offset") % 1_000_000_000_000
    at = F.unix_micros("kafka_ts") + original * 2 + (F.col("offset") > original).cast("int")
    rejected = i.as_dead_letters(judged(spark, sf_dir), F.timestamp_micros(at))
    return recent(rejected, "rejected_at").select("partition", "offset", micros("rejected_at"), "reason")


def ingest_counters(spark, sf_dir):
    return m.ingest_counters(_outcomes(spark, sf_dir))


def reject_counters(spark, sf_dir):
    return m.reject_counters(_outcomes(spark, sf_dir))


def latency_histogram(spark, sf_dir):
    configure(spark)
    e = samples.table(spark, sf_dir, "events")
    b = m.latency_histogram(e, F.col("value").cast("decimal(18,2)"), "event_type")
    return b.select("event_type", "le", "observations", (F.col("total") * 100).cast("bigint").alias("total_cents"), "n")


def _sketches(spark, sf_dir):
    """New events' latencies, sketched in ten batches: an event's ``value`` is the seconds it took."""
    new = _new_events(spark, sf_dir).join(
        samples.table(spark, sf_dir, "events").select(F.col("event_id").alias("offset"), "value"), "offset"
    )
    took = F.timestamp_micros(F.unix_micros("kafka_ts") + (F.col("value").cast("decimal(18,2)") * 1_000_000).cast("bigint"))
    batches = [m.latency_sketches(new.where(F.col("offset") % 10 == b), took) for b in range(10)]
    return stored(reduce(lambda a, b: a.unionByName(b), batches), "latency"), new


def latency_ingest(spark, sf_dir):
    sketches, _ = _sketches(spark, sf_dir)
    return m.latency_buckets(sketches, "service").select("service", "le", "observations", "n", "total_us")


def latency_p99(spark, sf_dir):
    """Quantiles of merged sketches against exact ranks: off by less than a per cent."""
    sketches, new = _sketches(spark, sf_dir)
    shares = (0.5, 0.9, 0.99)
    asked = reduce(lambda a, b: a.unionByName(b), [m.latency_at(sketches, s, "service").withColumn("share", F.lit(s)) for s in shares])
    us = (F.col("value").cast("decimal(18,2)") * 1_000_000).cast("bigint")
    ranked = new.select(F.col("source_service").alias("service"), us.alias("us")).join(F.broadcast(asked), "service")  # a row per service and share
    ranks = ranked.groupBy("service", "share", "n").agg(
        F.count_if(F.col("us") < F.col("latency_us")).alias("below"), F.count_if(F.col("us") <= F.col("latency_us")).alias("up_to")
    )
    slack = F.lit(0.01) * F.col("n") + 1
    close = (F.col("below") <= F.col("share") * F.col("n") + slack) & (F.col("up_to") >= F.col("share") * F.col("n") - slack)
    return ranks.select("service", "n", F.round(F.col("share") * 100).cast("int").alias("per_cent"), close.alias("close"))


# --- redaction ---


def redaction_rule_match(spark, sf_dir):
    configure(spark)
    e = samples.audit_events(spark, sf_dir)
    pairs = e.select(F.col("source_service").alias("service"), "action")
    chosen = r.transforms_for(policy(), "service", "action")
    return pairs.distinct().select("service", "action", F.explode(chosen).alias("field", "transform"))


def redact_events(spark, sf_dir):
    configure(spark)
    e = samples.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("source_service"), F.col("event_type").alias("action"),
        F.col("props").cast("binary").alias("payload"),
    )
    d = r.redact(e, r.parse_policy(POLICY_TEXT))
    return d.select("event_id", _text("body").alias("body"), "redacted", "redact_error")


def redact_orders(spark, sf_dir):
    configure(spark)
    total = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    payload = F.concat(
        F.lit('{"total": '), total, F.lit(', "Priority": "'), F.col("o_orderpriority"),
        F.lit('", "customer": "cust_'), F.col("o_custkey").cast("string"), F.lit('"}'),
    )
    o = samples.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("orders").alias("source_service"),
        F.concat(F.lit("order."), F.col("o_orderstatus")).alias("action"), payload.cast("binary").alias("payload"),
    )
    d = r.redact(o, r.parse_policy(ORDER_POLICY_TEXT))
    return d.select("o_orderkey", _text("body").alias("body"), "redacted")


def mask_string(spark, sf_dir):
    configure(spark)
    docs = samples.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(t.mask("text"), 256).alias("masked_sha"), F.octet_length(t.mask("text")).alias("size"))


def mask_names(spark, sf_dir):
    configure(spark)
    return samples.table(spark, sf_dir, "customer").select("c_custkey", t.mask("c_name").alias("masked"))


def hash_field(spark, sf_dir):
    configure(spark)
    return samples.table(spark, sf_dir, "documents").select("doc_id", t.hash_text_field("text").alias("hashed"))


def drop_field(spark, sf_dir):
    """Native form for payloads that are maps already."""
    configure(spark)
    c = samples.table(spark, sf_dir, "customer").select(
        "c_custkey", F.create_map(F.lit("Name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("fields")
    )
    kept = r.redact_map("fields", F.create_map(F.lit("name"), F.lit(r.DROP)))
    return c.select("c_custkey", F.to_json(kept).alias("fields"))


_REDACT_ORDERS = """SELECT o_orderkey,
  CASE o_orderstatus
    WHEN 'F' THEN '{"Priority":"' || left(o_orderpriority, 1) || repeat('*', length(o_orderpriority) - 2) || right(o_orderpriority, 1)
      || '","customer":"sha256:' || sha256('"cust_' || o_custkey || '"') || '","total":'
      || regexp_replace(CAST(CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE) AS VARCHAR), '\\.0$', '') || '}'
    WHEN 'P' THEN '{"Priority":"' || o_orderpriority || '","customer":"cust_' || o_custkey || '"}'
    ELSE '{"total": ' || CAST(o_totalprice AS DECIMAL(14, 2)) || ', "Priority": "' || o_orderpriority
      || '", "customer": "cust_' || o_custkey || '"}' END AS body,
  o_orderstatus IN ('F', 'P') AS redacted
FROM orders"""

_MASK = """CASE WHEN octet_length(encode({c})) <= 2 THEN '*'
  ELSE chr(('0x' || hex(encode({c}))[1:2])::INTEGER) || repeat('*', octet_length(encode({c})) - 2)
    || chr(('0x' || right(hex(encode({c})), 2))::INTEGER) END"""


def _json_string_sql(c):
    out = c
    for raw, escaped in t._JSON_ESCAPES:
        out = f"replace({out}, chr({ord(raw)}), '{escaped}')"
    named = {ord(raw) for raw, _ in t._JSON_ESCAPES}
    for code in range(1, 0x20):
        if code not in named:
            out = f"replace({out}, chr({code}), '\\u{code:04x}')"
    return f"'\"' || {out} || '\"'"


_REJECTED = f"WITH {q.WIRE} SELECT {{}} FROM verdicts WHERE outcome = 'rejected'"
_NEW = f"""WITH {q.WIRE}, new AS (SELECT * FROM verdicts WHERE outcome = 'ingested')"""

# Chains of the sealed and of the late rows; rows after a head continue the sealed chain.
_LATE = q.chain_of(q.EV.replace("ev AS (", "all_ev AS (", 1) + """,
heads AS (SELECT seg, max((ts, id)) AS head FROM all_ev WHERE n % 71 <> 0 GROUP BY seg),
ev AS (
  SELECT e.* EXCLUDE (seg),
    CASE WHEN n % 71 = 0 AND head IS NOT NULL AND (ts, id) <= head THEN 'late-000000000001/' || e.seg ELSE e.seg END AS seg
  FROM all_ev e LEFT JOIN heads h ON e.seg = h.seg)""") + """
SELECT id, seg, pos, prev_hash, this_hash FROM ch WHERE n % 71 = 0"""

QUERIES = {
    "decode_envelope": (decode_envelope, f"""WITH {q.WIRE}
SELECT partition, "offset",
  CASE WHEN ok THEN id ELSE NULL END AS id, CASE WHEN ok THEN epoch_us(ts) END AS ts_us,
  CASE WHEN ok THEN event_type END AS source_service,
  CASE WHEN ok THEN CASE WHEN event_id % 97 = 0 THEN '' ELSE 'user_' || user_id END END AS actor_id,
  CASE WHEN ok THEN event_type END AS action, CASE WHEN ok THEN 'user' END AS target_type,
  CASE WHEN ok THEN CASE WHEN event_id % 89 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END END AS target_id,
  CASE WHEN NOT ok THEN NULL WHEN event_id % 79 = 0 THEN 'sha256:deadbeef'
    WHEN event_id % 83 = 0 THEN 'sha256:' || sha256(payload || 'x') ELSE 'sha256:' || sha256(payload) END AS payload_hash,
  CASE WHEN ok AND event_id % 79 <> 0 THEN payload END AS payload,
  CASE WHEN NOT ok THEN 'event: decode: malformed envelope' END AS error
FROM (SELECT *, event_id % 73 <> 0 AS ok FROM judged)"""),
    "validate_reasons": (validate_reasons, f"""WITH {q.WIRE}
SELECT CASE WHEN event_id % 97 = 0 THEN 'event: invalid: missing actor_id'
  WHEN event_id % 89 = 0 THEN 'event: invalid: missing target_id' END AS reason, count(*) AS messages
FROM judged WHERE event_id % 73 <> 0 GROUP BY 1"""),
    "parse_rfc3339": (parse_rfc3339, """WITH s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 5 AS shape, strftime(l_shipdate, '%Y-%m-%d') AS day,
    epoch_us(date_trunc('day', l_shipdate)) AS midnight FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  day || ['T10:20:30.123456789Z', 'T10:20:30+02:00', ' 10:20:30Z', 'T10:20:30', ''][shape + 1] AS text,
  CASE shape WHEN 0 THEN midnight + 37230123456 WHEN 1 THEN midnight + 30030000000 END AS ts_us,
  CASE shape WHEN 0 THEN (midnight + 37230123456) * 1000 + 789 WHEN 1 THEN (midnight + 30030000000) * 1000 END AS ts_ns
FROM s"""),
    "normalize_hash": (normalize_hash, f"""WITH {_HASH_TEXTS}
SELECT o_orderkey, text, CASE WHEN o_orderkey % 6 IN (1, 2) THEN 'sha256:' || text ELSE text END AS normal FROM texts"""),
    "decode_hash": (decode_hash, f"""WITH {_HASH_TEXTS}
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN d END AS bytes FROM texts"""),
    "encode_hash": (encode_hash, f"""WITH {_HASH_TEXTS}
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN 'sha256:' || d ELSE '' END AS encoded FROM texts"""),
    "payload_hash": (payload_hash, "SELECT doc_id, 'sha256:' || sha256(text) AS payload_hash FROM documents"),
    "payload_mismatch": (payload_mismatch, f"""WITH {q.WIRE}
SELECT id, partition, "offset", reason AS reject_reason FROM verdicts WHERE reject_kind = 'payload_hash'"""),
    "ingest_outcomes": (ingest_outcomes, f"""WITH {q.WIRE}
SELECT partition, "offset", outcome, reject_kind, reason AS reject_reason FROM verdicts"""),
    "ingest_accept": (ingest_accept, f"""{_NEW}
SELECT id, epoch_us(ts) AS ts_us, 'user_' || user_id AS actor_id, sha256(payload) AS payload_hash, id AS payload_ref,
  event_type IN ('click', 'purchase', 'view') AS redacted, false AS legal_hold_initial,
  epoch_us({q.AS_OF}) AS ingested_at_us FROM new"""),
    "ingest_dedup": (ingest_dedup, f"""{_NEW}
SELECT id, partition, "offset" FROM new WHERE event_id % 3 <> 0"""),
    "ingest_chain": (ingest_chain, q.chain_of(f"""{q.WIRE},
ev AS (SELECT id, ts, epoch_us(ts) * 1000 AS ts_ns, event_type AS source_service, 'user_' || user_id AS actor_id,
    event_type AS action, 'user' AS target_type, CAST(user_id AS VARCHAR) AS target_id, sha256(payload) AS ph,
    strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') || '/000000' AS seg
  FROM verdicts WHERE outcome = 'ingested')""") + " SELECT id, seg, pos, this_hash FROM ch"),
    "late_events": (late_events, _LATE),
    "chain_extend": (chain_extend, q.CHAIN + """
SELECT id, seg, pos, prev_hash, this_hash FROM ch WHERE minute(ts) >= 30"""),
    "dead_letters": (dead_letters, _REJECTED.format(
        "'audit.v1' AS topic, partition, \"offset\", 'key-' || event_id AS key, "
        "CASE WHEN event_id % 73 = 0 THEN length('not json ' || event_id) ELSE "
        "length('{\"id\": \"' || id || '\", \"ts\": \"2024-01-01T00:00:00.000000Z\", \"source_service\": \"' || event_type "
        "|| '\", \"actor_id\": \"' || CASE WHEN event_id % 97 = 0 THEN '' ELSE 'user_' || user_id END "
        "|| '\", \"action\": \"' || event_type || '\", \"target_type\": \"user\", \"target_id\": \"' "
        "|| CASE WHEN event_id % 89 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END || '\", \"payload_hash\": \"' "
        "|| CASE WHEN event_id % 79 = 0 THEN 'sha256:deadbeef' ELSE 'sha256:' || sha256(payload) END || '\"' "
        "|| CASE WHEN event_id % 79 = 0 THEN '' ELSE ', \"payload\": ' || payload END || '}') END AS size, reason")),
    "dead_letters_recent": (dead_letters_recent, f"""WITH {q.WIRE}, d AS (
  SELECT partition, "offset", epoch_us(ts) + event_id * 2 + CAST("offset" > event_id AS INTEGER) AS rejected_at_us, reason FROM verdicts WHERE outcome = 'rejected')
SELECT * FROM d ORDER BY rejected_at_us DESC LIMIT 100"""),
    "ingest_counters": (ingest_counters, f"""WITH {q.WIRE}
SELECT CASE WHEN reject_kind = 'decode' THEN 'unknown' ELSE event_type END AS service, outcome, count(*) AS messages
FROM verdicts GROUP BY 1, 2"""),
    "reject_counters": (reject_counters, f"""WITH {q.WIRE}
SELECT 'audit.v1' AS topic, CASE WHEN reject_kind = 'decode' THEN 'unknown' ELSE event_type END AS service,
  reject_kind AS reason, count(*) AS messages
FROM verdicts WHERE reject_kind IS NOT NULL GROUP BY 2, 3"""),
    "latency_histogram": (latency_histogram, f"""WITH e AS (SELECT event_type, CAST(value AS DECIMAL(18, 2)) AS v FROM events),
b AS (SELECT unnest([{', '.join(str(b) for b in m.BUCKETS)}]) AS bound,
    unnest([{', '.join(repr(str(b)) for b in m.BUCKETS)}]) AS le
  UNION ALL SELECT NULL, '+Inf'),
t AS (SELECT event_type, CAST(sum(v) * 100 AS BIGINT) AS total_cents, count(v) AS n FROM e GROUP BY 1)
SELECT event_type, le, count(v) FILTER (bound IS NULL OR v <= bound) AS observations, any_value(total_cents) AS total_cents,
  any_value(n) AS n FROM e JOIN t USING (event_type) CROSS JOIN b GROUP BY 1, 2"""),
    "latency_ingest": (latency_ingest, f"""WITH {q.WIRE}, e AS (
  SELECT event_type AS service, CAST(CAST(value AS DECIMAL(18, 2)) * 1000000 AS BIGINT) AS us FROM verdicts WHERE outcome = 'ingested'),
b AS (SELECT unnest([{', '.join(str(b) for b in m.BUCKETS)}]) AS bound,
    unnest([{', '.join(repr(str(b)) for b in m.BUCKETS)}]) AS le
  UNION ALL SELECT NULL, '+Inf')
SELECT service, le, count(*) FILTER (bound IS NULL OR us <= bound * 1000000) AS observations, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us
FROM e CROSS JOIN b GROUP BY 1, 2"""),
    "latency_p99": (latency_p99, f"""WITH {q.WIRE}
SELECT event_type AS service, count(*) AS n, per_cent, true AS close
FROM verdicts CROSS JOIN (SELECT unnest([50, 90, 99]) AS per_cent) WHERE outcome = 'ingested' GROUP BY 1, 3"""),
    "redaction_rule_match": (redaction_rule_match, """SELECT * FROM (VALUES
  ('click', 'click', 'k', 'hash'), ('purchase', 'purchase', 'k', 'mask'), ('purchase', 'purchase', 'other', 'drop'),
  ('view', 'view', 'k', 'drop'), ('view', 'view', 'K', 'hash'), ('signup', 'signup', 'k', 'none'))
  AS v(service, action, field, transform)
WHERE (service, action) IN (SELECT (event_type, event_type) FROM events)"""),
    "redact_events": (redact_events, f"""SELECT event_id, {q.REDACTED_K} AS body,
  event_type IN ('click', 'purchase', 'view') AS redacted, CAST(NULL AS VARCHAR) AS redact_error FROM events"""),
    "redact_orders": (redact_orders, _REDACT_ORDERS),
    "mask_string": (mask_string, f"""SELECT doc_id, sha256({_MASK.format(c='text')}) AS masked_sha,
  octet_length(encode({_MASK.format(c='text')})) AS size FROM documents"""),
    "mask_names": (mask_names, f"SELECT c_custkey, {_MASK.format(c='c_name')} AS masked FROM customer"),
    "hash_field": (hash_field, f"SELECT doc_id, 'sha256:' || sha256({_json_string_sql('text')}) AS hashed FROM documents"),
    "drop_field": (drop_field, """SELECT c_custkey, '{"segment":"' || c_mktsegment || '"}' AS fields FROM customer"""),
}
