import hashlib
import json

import pytest

from sealtrail.functions.envelope import EMPTY, MALFORMED, _quick, _walk, decode_one
from sealtrail.operators import ingest
from sealtrail.operators.redact import parse_policy
from sealtrail.schema import WIRE

GOOD = {
    "id": "msg-7", "ts": "2025-03-04T08:30:00Z", "source_service": "desk", "actor_id": "clerk",
    "action": "form.signed", "target_type": "form", "target_id": "form-12",
    "payload_hash": "sha256:" + "9f" * 32, "payload": {"amount": "100"},
}


def wire(spark, values):
    rows = [("audit.v1", 0, i, b"k", v, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, WIRE)


def message(**changes):
    members = {**GOOD, **changes}
    if "payload" in members and "payload_hash" not in changes:
        members["payload_hash"] = "sha256:" + hashlib.sha256(json.dumps(members["payload"]).encode()).hexdigest()
    return json.dumps({k: v for k, v in members.items() if v is not None}).encode()


def test_well_formed():
    out = decode_one(json.dumps(GOOD).encode())
    assert out["id"] == "msg-7" and out["target_id"] == "form-12" and "error" not in out
    assert out["payload"] == b'{"amount": "100"}'
    assert out["ts_ns"] == 1_741_077_000_000_000_000


@pytest.mark.parametrize("raw", [
    b"not json", b"[]", b"5", b'"x"', b'{"id": 5}', b'{"ts": "2026-07-13"}', b'{"ts": 5}', b'{"id": "a"} x',
    b'{"id": "a",}', b'{"payload": NaN}', b'{"redaction": 1}', b'{"id": "\x01"}', b"{", b'{"a" 1}', b"nullx",
    b'{"payload": 01}', b'{"ts": "2026-07-13T10:00:00\\u005a"}',
])
def test_malformed(raw):
    assert decode_one(raw) == {"error": MALFORMED}


def test_empty():
    assert decode_one(b"") == decode_one(None) == {"error": EMPTY}


@pytest.mark.parametrize("raw, payload", [
    (b'{"payload": { "b" : 1.00, "a":[1,  2] } }', b'{ "b" : 1.00, "a":[1,  2] }'),
    (b'{"payload": null}', b"null"),
    (b'{"payload": "\xff"}', b'"\xff"'),
    (b'{"payload": 1, "payload": 2}', b"2"),
    (b'{"PayLoad": 1}', b"1"),
    (b'{"p\\u0061yload":  1.0 }', b"1.0"),
    (b'{"x": {"payload": 3}, "payload": "\\"payload\\": 9"}', b'"\\"payload\\": 9"'),
    (b'{"payload": {"payload": {"payload": 1}}}', b'{"payload": {"payload": 1}}'),
    (b'{"payload": {}}', b"{}"),
])
def test_payload_bytes_are_exact(raw, payload):
    assert decode_one(raw)["payload"] == payload


def test_names_fold_nulls_skip_and_last_wins():
    out = decode_one(b'{"ID": "a", "id": null, "Actor_Id": "x", "actor_id": "y", "unknown": {"id": 5}}')
    assert (out["id"], out["actor_id"]) == ("a", "y")
    assert decode_one(b"null")["id"] == ""
    assert decode_one(b'{"ts": "0001-01-01T00:00:00Z"}').get("ts_ns") is None
    assert decode_one(b'{"id": "\xff\xe2\x82"}')["id"] == "���"


def test_quick_path_agrees_with_the_walk():
    for text in (json.dumps(GOOD), json.dumps({**GOOD, "actor_id": "имя"}, ensure_ascii=False), "{}", '{"id": "a", "payload": [1, {"z": "}"}]}'):
        quick = _quick(text)
        assert quick is not None
        assert {k: v for k, v in quick.items() if v is not None} == {k: v for k, v in _walk(text).items() if v is not None}


def test_first_missing_member_is_named(spark):
    values = [message(**{name: None}) for name in ingest.REQUIRED if name != "payload_hash"]
    values += [message(id="", ts=None), message(actor_id=" "), json.dumps({k: v for k, v in GOOD.items() if k != "payload_hash"}).encode()]
    got = ingest.decode(wire(spark, values)).select("offset", ingest.missing_field().alias("m")).orderBy("offset").collect()
    names = [f"event: invalid: missing {n}" for n in ingest.REQUIRED if n != "payload_hash"]
    assert [r["m"] for r in got] == [*names, "event: invalid: missing id", None, "event: invalid: missing payload_hash"]


POLICY = parse_policy('rules:\n  - service: "desk"\n    action: "*"\n    fields:\n      ssn: mask\n')


def judged(spark, values, policy=POLICY):
    return ingest.judge_messages(wire(spark, values), policy).orderBy("offset").collect()


def test_reasons_and_their_order(spark):
    hash_only = {**GOOD, "payload_hash": "ab" * 32}
    del hash_only["payload"]
    short = {**hash_only, "payload_hash": "sha256:deadbeef"}
    rows = judged(spark, [
        message(), b"", b"not json", message(id=None), message(payload_hash="sha256:deadbeef"),
        message(payload=[1, 2]), json.dumps(hash_only).encode(), json.dumps(short).encode(),
        message(payload={"ssn": "123-45-6789", "amount": "100"}),
        message(payload=[1, 2], source_service="other"),
    ])
    assert [r["reject_kind"] for r in rows] == [
        None, "decode", "decode", "decode", "payload_hash", "redaction", None, "payload_hash_format", None, None]
    assert rows[3]["reject_reason"] == "decode: event: invalid: missing id"
    assert rows[4]["reject_reason"] == "payload_hash mismatch"
    assert rows[7]["reject_reason"] == 'payload_hash format: event: hash "sha256:deadbeef" is 4 bytes, want 32'
    assert bytes(rows[8]["body"]) == b'{"amount":"100","ssn":"1*********9"}' and rows[8]["redacted"]
    assert bytes(rows[0]["body"]) == b'{"amount": "100"}' and not rows[0]["redacted"]


def test_events_keep_the_hash_of_the_original_payload(spark):
    payload = {"ssn": "123-45-6789"}
    df = ingest.judge_messages(wire(spark, [message(payload=payload)]), POLICY)
    df = ingest.accepted(df)
    e = ingest.as_events(df, None).first()
    assert bytes(e["payload_hash"]) == hashlib.sha256(json.dumps(payload).encode()).digest()
    assert e["redacted"] and e["payload_ref"] == "msg-7" and e["legal_hold_initial"] is False
    p = ingest.as_payloads(df, None).first()
    assert (p["retention_days"], p["storage_class"], bytes(p["body"])) == (2555, "STANDARD", b'{"ssn":"1*********9"}')


def test_hash_only_event_has_no_payload(spark):
    hash_only = {k: v for k, v in GOOD.items() if k != "payload"}
    df = ingest.accepted(ingest.judge_messages(wire(spark, [json.dumps(hash_only).encode()])))
    assert ingest.as_events(df, None).first()["payload_ref"] == ""
    assert ingest.as_payloads(df, None).count() == 0


def test_copies_of_one_id_are_one_event(spark):
    values = [message()] * 50 + [message(id="other")] + [b"not json"]
    outcome = ingest.outcomes(ingest.judge_messages(wire(spark, values)))
    counts = {r["outcome"]: r["count"] for r in outcome.groupBy("outcome").count().collect()}
    assert counts == {"ingested": 2, "duplicate": 49, "rejected": 1}
    first = outcome.where("outcome = 'ingested' AND id = 'msg-7'").first()
    assert first["offset"] == 0
    stored = outcome.where("id = 'msg-7'").select("id").limit(1)
    again = ingest.dedup(ingest.accepted(ingest.judge_messages(wire(spark, values))), stored)
    assert [r["id"] for r in again.collect()] == ["other"]
