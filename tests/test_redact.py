import hashlib
import random

from pyspark.sql import functions as F

from sealtrail.operators import redact as r

TEXT = """
# comment
rules:
  - service: "desk"
    action: "*"
    fields:
      ssn: mask
      email: hash
      card_number: drop
      UPPER: drop
  - service: '*'
    action: '*'
    fields:
      password: drop
      secret: mask
      ssn: drop
      keep: none
      odd: unknown
  - service: noaction
    fields:
      a: drop
"""
POLICY = r.parse_policy(TEXT)


def test_parse():
    assert [(x.service, x.action, list(x.fields)) for x in POLICY] == [
        ("desk", "*", ["ssn", "email", "card_number", "UPPER"]),
        ("*", "*", ["password", "secret", "ssn", "keep", "odd"]),
        ("noaction", "", ["a"]),
    ]
    assert r.parse_policy("") == [] == r.load_policy(None) == r.load_policy("/nonexistent/policy")
    assert r.parse_policy("a: drop\n- service: s\n a: mask\n a: drop")[0].fields == {"a": "mask"}


def bodies(spark, rows, policy=POLICY):
    df = spark.createDataFrame(rows, "n INT, source_service STRING, action STRING, payload BINARY")
    return {x["n"]: x for x in r.redact(df, policy).collect()}


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_transforms(spark):
    cases = [
        ("desk", b'{"ssn":"123-45-6789","amount":"100"}', b'{"amount":"100","ssn":"1*********9"}'),
        ("desk", b'{"SSN":"123-45-6789"}', b'{"SSN":"1*********9"}'),
        ("desk", b'{"email":"a<b@x"}', ('{"email":"%s"}' % sha('"a\\u003cb@x"')).encode()),
        ("desk", b'{"email": 5.0}', ('{"email":"%s"}' % sha("5")).encode()),
        ("desk", b'{"card_number":1,"z":[1.50,{"b":1,"a":2}]}', b'{"z":[1.5,{"a":2,"b":1}]}'),
        ("desk", b'{"upper":1, "UPPER":2}', b'{"upper":1, "UPPER":2}'),
        ("pay", b'{"ssn":"1","x":"<"}', b'{"x":"\\u003c"}'),
        ("pay", b'{"secret":42}', b'{"secret":"*"}'),
        ("pay", b'{"secret":null}', b'{"secret":"n**l"}'),
        ("pay", b'{"secret":""}', b'{"secret":""}'),
        ("pay", b'{"secret":{"b":1,"a":"x"}}', b'{"secret":"{*************}"}'),
        ("pay", b'{ "keep" : 1 , "odd": 2 }', b'{ "keep" : 1 , "odd": 2 }'),
        ("pay", b"null", b"null"),
        ("pay", b"", b""),
    ]
    got = bodies(spark, [(i, s, "a", b) for i, (s, b, _) in enumerate(cases)])
    for i, (_, raw, want) in enumerate(cases):
        assert bytes(got[i]["body"]) == want, raw
        assert got[i]["redacted"] == (raw != want), raw
        assert got[i]["redact_error"] is None


def test_errors_only_where_a_rule_matches(spark):
    only_desk = POLICY[:1]
    rows = [(0, "desk", "a", b"[1]"), (1, "pay", "a", b"[1]"), (2, "desk", "a", b"nope"), (3, "desk", "a", b'{"a":1e400}')]
    got = bodies(spark, rows, only_desk)
    assert [got[i]["redact_error"] is not None for i in range(4)] == [True, False, True, True]
    assert bytes(got[1]["body"]) == b"[1]"


def test_a_rule_without_fields_still_needs_an_object(spark):
    got = bodies(spark, [(0, "s", "", b"[1]"), (1, "s", "x", b"[1]")], [r.Rule("s")])
    assert got[0]["redact_error"] is not None and got[1]["redact_error"] is None


def test_no_policy_passes_bytes_through(spark):
    got = bodies(spark, [(0, "s", "a", b'{ "ssn" : 1 }')], [])
    assert bytes(got[0]["body"]) == b'{ "ssn" : 1 }' and not got[0]["redacted"]


def first_match(policy, service, action):
    """The resolution as a loop over the rules; None if no rule matches."""
    found, any_rule = {}, False
    for rule in policy:
        if rule.service in ("*", service) and rule.action in ("*", action):
            any_rule = True
            for name, transform in rule.fields.items():
                found.setdefault(name, transform)
    return found if any_rule else None


def test_the_first_rule_wins_in_code_and_in_the_table(spark):
    names = [("desk", "a"), ("pay", "b"), ("noaction", "a"), ("noaction", ""), ("*", "*"), (None, "a"), ("desk", None), (None, None)]
    policies = [POLICY, POLICY[:1], POLICY[::-1], [r.Rule("desk", "a"), r.Rule("*", "a", {"x": "mask"})], [r.Rule("pay", "*", {"x": "drop"})]]
    pairs = spark.createDataFrame(names, "service STRING, action STRING")
    for policy in policies:
        want = {n: first_match(policy, *n) for n in names}
        code = pairs.select("service", "action", r.transforms_for(policy, "service", "action").alias("m")).collect()
        assert {(x["service"], x["action"]): x["m"] for x in code} == want
        table = r.resolved(pairs, r.rule_table(spark, policy)).collect()
        assert {(x["service"], x["action"]): x["transforms"] for x in table} == {n: m for n, m in want.items() if m is not None}


def test_ten_thousand_rules(spark):
    rng = random.Random(4)
    pick = lambda kind, n: rng.choice(["*", *[f"{kind}{i}" for i in range(n)]])
    policy = [r.Rule(pick("s", 300), pick("a", 40), {pick("f", 30): rng.choice(["drop", "mask", "hash", "none"])}) for _ in range(10_000)]
    names = [(f"s{i}", f"a{i % 45}") for i in range(0, 320, 7)] + [(None, "a1")]
    df = spark.createDataFrame([(s, a, b'{"f1": "abc", "g": 1, "f2": "12"}') for s, a in names], "source_service STRING, action STRING, payload BINARY")
    got = r.with_transforms(df, policy).collect()
    assert len(got) == len(names) and all(x["_transforms"] == first_match(policy, x["source_service"], x["action"]) for x in got)
    for x in r.redact(df, policy).collect():
        want = r.redact_one(bytes(x["payload"]), first_match(policy, x["source_service"], x["action"]))
        assert (bytes(x["body"]), x["redacted"], x["redact_error"]) == want


def test_maps(spark):
    df = spark.createDataFrame([({"Name": "Ann", "ssn": "1234", "mail": "<a>", "keep": "x", "empty": ""},)], "m map<string,string>")
    how = F.create_map(*[F.lit(x) for x in ("name", "drop", "ssn", "mask", "mail", "hash", "empty", "mask")])
    assert df.select(r.redact_map("m", how).alias("m")).first()["m"] == {
        "ssn": "1**4", "mail": sha('"\\u003ca\\u003e"'), "keep": "x", "empty": ""}
