import hashlib
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sealtrail.functions import json_text, text as t
from sealtrail.operators.redact import mask_text

MOMENTS = {
    "2026-07-13T10:00:00Z": 1_783_936_800_000_000_000,
    "2026-07-13T10:00:00.123456789Z": 1_783_936_800_123_456_789,
    "2026-07-13T12:00:00.5+02:00": 1_783_936_800_500_000_000,
    "2026-07-13T10:00:00.1234567891234Z": 1_783_936_800_123_456_789,
    "1969-12-31T23:59:59.999999999Z": -1,
}
NO_MOMENTS = [
    "2026-07-13", "2026-07-13 10:00:00Z", "2026-07-13T10:00:00", "2026-07-13t10:00:00z", "2026-02-30T00:00:00Z",
    "2026-07-13T24:00:00Z", "2026-07-13T10:00:60Z", "2026-13-01T00:00:00Z", "", "x", "2026-07-13T10:00:00+24:00",
    "2026-07-13T10:00:00,5Z",
]


def test_rfc3339_native_and_scalar_agree(spark):
    df = spark.createDataFrame([(m,) for m in [*MOMENTS, *NO_MOMENTS]], "t STRING")
    got = {r["t"]: r for r in df.select("t", F.unix_micros(t.parse_rfc3339("t")).alias("us"), t.rfc3339_nanos("t").alias("ns")).collect()}
    for moment, ns in MOMENTS.items():
        assert t.nanos_of(moment) == ns
        assert got[moment]["ns"] == ns
        assert got[moment]["us"] == ns // 1000
    for moment in NO_MOMENTS:
        assert t.nanos_of(moment) is None, moment
        assert got[moment]["us"] is None, moment


def test_rfc3339_text_has_no_trailing_zeros(spark):
    rows = [(ns // 1000, ns) for ns in (1_783_936_800_000_000_000, 1_783_936_800_100_000_000, 1_783_936_800_123_456_789)]
    df = spark.createDataFrame(rows, "us BIGINT, ts_ns BIGINT").select(F.timestamp_micros("us").alias("ts"), "ts_ns")
    want = ["2026-07-13T10:00:00Z", "2026-07-13T10:00:00.1Z", "2026-07-13T10:00:00.123456789Z"]
    assert [r[0] for r in df.select(t.format_rfc3339()).collect()] == want
    assert [t.text_of(ns) for _, ns in rows] == want


MASKS = {"": "*", "a": "*", "ab": "*", "abc": "a*c", "123-45-6789": "1*********9", "é": "*", "xéy": "x**y"}


def test_mask(spark):
    df = spark.createDataFrame([(m,) for m in MASKS], "t STRING")
    assert {r[0]: r[1] for r in df.select("t", t.mask("t")).collect()} == MASKS
    assert {m: mask_text(m) for m in MASKS} == MASKS
    # Cut inside a character: each kept byte shows as the character with its code.
    assert mask_text("éa") == "Ã*a"
    assert spark.range(1).select(t.mask(F.lit("éa"))).first()[0] == "Ã*a"


TEXTS = ["plain", "<b>&\"\\/", "\x00\x01\x1f\b\f\n\r\t\x7f", "é  😀", "", "\\u003c"]


def test_json_string_native_and_python_agree(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "t STRING")
    for row in df.select("t", t.json_string("t").alias("j"), t.hash_text_field("t").alias("h")).collect():
        assert row["j"] == json_text.dumps(row["t"])
        assert json.loads(row["j"]) == row["t"]
        assert row["h"] == "sha256:" + hashlib.sha256(row["j"].encode()).hexdigest()


NUMBERS = {
    "1.00": "1", "0": "0", "-0.0": "-0", "1e21": "1e+21", "1e20": "100000000000000000000", "1e-6": "0.000001",
    "1e-7": "1e-7", "12345678901234567890": "12345678901234567000", "0.1": "0.1", "1.5e300": "1.5e+300",
}


def test_numbers_are_doubles():
    for raw, want in NUMBERS.items():
        assert json_text.dumps(json_text.loads(raw.encode())) == want
    for bad in (b"1e400", b"NaN", b"Infinity", b"01", b"[1,]", b'"\x01"', b""):
        with pytest.raises(ValueError):
            json_text.loads(bad)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12))
def test_dumps_round_trips(value):
    text = json_text.dumps(value)
    assert json_text.dumps(json_text.loads(text.encode("utf-8", "surrogatepass"))) == text


IDS = {
    "00000000-0000-4000-8000-000000000001": True, "00000000-0000-4000-8000-00000000000G": False, "e1": False,
    "urn:uuid:00000000-0000-4000-8000-000000000001": True, "{00000000-0000-4000-8000-000000000001}": True,
    "00000000000040008000000000000001": True, "": False,
}


def test_uuid_shapes(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "t STRING")
    assert {r[0]: r[1] for r in df.select("t", t.is_uuid("t")).collect()} == IDS
