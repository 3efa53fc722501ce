import hashlib
from datetime import datetime, timezone

from pyspark.sql import functions as F

from helpers import EVENT, ZERO, body, digest, event, events
from sealtrail.functions import hashing as h


def test_body_and_hash_match_the_plain_encoding(spark):
    rows = [
        event("evt-é", datetime(2026, 1, 2, 3, 4, 5, 678901, timezone.utc), actor="имя", payload=b"\x00\xff" * 16),
        event("b", datetime(1960, 1, 1, tzinfo=timezone.utc), target=("", "x" * 300)),
    ]
    df = spark.createDataFrame(rows, EVENT)
    got = df.select("*", h.canonical_body().alias("body"), h.event_hash(h.canonical_body(), h.zero_hash()).alias("h"))
    for row in got.collect():
        assert bytes(row["body"]) == body(row)
        assert bytes(row["h"]) == digest(row, ZERO)


def test_every_covered_field_changes_the_hash(spark):
    base = events(spark, 1)
    changed = [base.withColumn(c, F.lit("other")) for c in ("id", "source_service", "actor_id", "action", "target_type", "target_id")]
    changed.append(base.withColumn("payload_hash", F.lit(b"other")))
    changed.append(base.withColumn("ts_ns", F.col("ts_ns") + 1))
    hashes = set()
    for df in [base, *changed]:
        hashes.add(bytes(df.select(h.event_hash(h.canonical_body(), h.zero_hash())).first()[0]))
    assert len(hashes) == 9
    same = base.withColumn("payload_ref", F.lit("elsewhere")).withColumn("redacted", F.lit(True))
    assert bytes(same.select(h.event_hash(h.canonical_body(), h.zero_hash())).first()[0]) in hashes


def test_hash_text_forms(spark):
    good = hashlib.sha256(b"a").hexdigest()
    cases = {
        "": ("", None),
        good: ("sha256:" + good, good),
        "sha256:" + good: ("sha256:" + good, good),
        good.upper(): ("sha256:" + good.upper(), good),
        "sha256:deadbeef": ("sha256:deadbeef", None),
        "zz": ("zz", None),
        "sha256:" + "z" * 64: ("sha256:" + "z" * 64, None),
        "abc": ("abc", None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t STRING")
    for row in df.select("t", h.normalize_hash("t").alias("n"), h.hash_to_bytes("t").alias("b"), h.hash_format_error("t").alias("e")).collect():
        normal, raw = cases[row["t"]]
        assert row["n"] == normal
        assert (row["b"].hex() if row["b"] is not None else None) == raw
        assert (row["e"] is None) == (raw is not None)


def test_hash_to_text_takes_32_bytes_only(spark):
    df = spark.createDataFrame([(bytes(32),), (b"short",), (b"",)], "b BINARY")
    assert [r[0] for r in df.select(h.hash_to_text("b")).collect()] == [h.ZERO_HASH_TEXT, "", ""]


def test_payload_ok_is_byte_exact_and_case_sensitive(spark):
    payload = b'{ "b" : 1.00 }'
    digest_hex = hashlib.sha256(payload).hexdigest()
    rows = [(digest_hex, payload), ("sha256:" + digest_hex, payload), (digest_hex.upper(), payload), (digest_hex, b'{"b":1.0}')]
    df = spark.createDataFrame(rows, "h STRING, p BINARY")
    assert [r[0] for r in df.select(h.payload_ok("h", "p")).collect()] == [True, True, False, False]
