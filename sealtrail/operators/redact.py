"""Field-level redaction of JSON payloads by an ordered policy.

Rules are resolved natively per row, as generated code or, if they are many, from a table; only
bodies with a matching rule are looked at by the Arrow UDF, all others keep their exact bytes.
Payloads that are maps are redacted natively (:func:`redact_map`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealtrail.functions.hashing import _col
from sealtrail.functions.json_text import clean, dumps, loads
from sealtrail.functions.text import hash_text_field, mask
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.schema import RULES, flat

DROP, HASH, MASK, NONE = "drop", "hash", "mask", "none"


@dataclass
class Rule:
    service: str
    action: str = ""
    fields: dict[str, str] = field(default_factory=dict)


Policy = list[Rule]


def parse_policy(text: str) -> Policy:
    """Rules in order.  ``- service:`` opens a rule; ``action:`` and ``field: transform``
    lines belong to it.  Blank lines, comments and lines before the first rule are skipped."""
    policy: Policy = []
    for line in (raw.strip() for raw in text.split("\n")):
        name, colon, value = line.partition(":")
        name, value = name.strip(), value.strip()
        if not colon or line.startswith(("#", "rules:")):
            continue
        if line.startswith("- service:"):
            policy.append(Rule(_unquoted(value)))
        elif not policy or line.startswith("fields:"):
            continue
        elif line.startswith("action:"):
            policy[-1].action = _unquoted(value)
        else:
            policy[-1].fields.setdefault(name, value)
    return policy


def _unquoted(text: str) -> str:
    quoted = len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'"
    return text[1:-1] if quoted else text


def load_policy(path: str | None, spark: SparkSession | None = None) -> Policy:
    """Policy file; no path or no such file means no rules.

    With a session the path may name any file system Spark reads.
    """
    if not path:
        return []
    if spark is None:
        return parse_policy(Path(path).read_text()) if Path(path).exists() else []
    try:
        return parse_policy(spark.read.text(path, wholetext=True).first()[0])
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return []
        raise


def _matches(rule: Rule, service: Column, action: Column) -> Column:
    tests = [c == v for c, v in ((service, rule.service), (action, rule.action)) if v != "*"]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def transforms_for(policy: Policy, service: Column | str, action: Column | str) -> Column:
    """MAP<field, transform> that applies to a row; NULL if no rule matches at all.

    First match per field as one CASE per field name, so the whole resolution is
    generated code without a join.
    """
    service, action = _col(service), _col(action)
    if not policy:
        return F.lit(None).cast("map<string,string>")
    names = list(dict.fromkeys(n for rule in policy for n in rule.fields))
    entries = []
    for name in names:
        chosen = F.lit(None).cast("string")
        for rule in reversed(policy):
            if name in rule.fields:
                chosen = F.when(_matches(rule, service, action), rule.fields[name]).otherwise(chosen)
        entries.append(F.struct(F.lit(name).alias("key"), chosen.alias("value")))
    any_rule = reduce(lambda a, b: a | b, [_matches(r, service, action) for r in policy])
    if not entries:
        return F.when(any_rule, F.create_map().cast("map<string,string>"))
    resolved = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    return F.when(any_rule, resolved)


def rule_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """The policy as rows (schema RULES); a rule without fields is one row without field."""
    rows = [
        (number, rule.service, rule.action, name, transform)
        for number, rule in enumerate(policy) for name, transform in (rule.fields or {None: None}).items()
    ]
    return spark.createDataFrame(rows, RULES)


def resolved(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(service, action, transforms) of those ``pairs`` (service, action) that some rule matches.

    The same answer as :func:`transforms_for`, from a table of rules of any size: a rule can match
    a pair in four ways, exactly or with a wildcard for either side, so each pair looks up four keys,
    and for each field the first rule found counts.
    """
    star = F.lit("*")
    keys = F.array(*[F.struct(s.alias("rule_service"), a.alias("rule_action")) for s in (F.col("service"), star) for a in (F.col("action"), star)])
    asked = pairs.select("service", "action").distinct().select("service", "action", F.inline(F.array_distinct(keys)))
    named = rules.withColumnsRenamed({"service": "rule_service", "action": "rule_action"})
    found = asked.join(named, ["rule_service", "rule_action"])
    first = found.groupBy("service", "action", "field").agg(F.min_by("transform", "rule_ord").alias("transform"))
    entries = F.filter(F.collect_list(F.struct(F.col("field").alias("key"), F.col("transform").alias("value"))), lambda e: e["key"].isNotNull())
    return first.groupBy("service", "action").agg(F.map_from_entries(entries).alias("transforms"))


def with_transforms(df: DataFrame, policy: Policy, name: str = "_transforms") -> DataFrame:
    """``df`` with the map of transforms that applies to each row (by ``source_service`` and ``action``).

    A short policy becomes generated code; a long one a table that is joined, and broadcast only
    after its rows for the pairs at hand are counted.
    """
    if sum(len(rule.fields) + 1 for rule in policy) <= MOST_CASES:
        return df.withColumn(name, transforms_for(policy, "source_service", "action"))
    pairs = df.select(F.col("source_service").alias("service"), "action")
    table = resolved(pairs, rule_table(df.sparkSession, policy)).withColumnRenamed("transforms", name)
    table = broadcast_if_small(table.select(F.col("service").alias("_s"), F.col("action").alias("_a"), name))
    same = F.col("source_service").eqNullSafe(F.col("_s")) & F.col("action").eqNullSafe(F.col("_a"))
    return df.join(table, same, "left").drop("_s", "_a")


# Conditions up to which a policy is generated code.
MOST_CASES = 100

# --- bodies ---


def mask_text(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= 2:
        return "*"
    return chr(data[0]) + "*" * (len(data) - 2) + chr(data[-1])


def _transformed(transform: str, value):
    """(new value, whether it changed)"""
    if transform == HASH:
        return "sha256:" + hashlib.sha256(dumps(value).encode()).hexdigest(), True
    if transform == MASK:
        text = clean(value) if isinstance(value, str) else dumps(value)
        return (mask_text(text), True) if text else (value, False)
    return value, False


@lru_cache(maxsize=4096)
def _spec(text: str) -> dict[str, str]:
    return dict(line.split(":", 1) for line in text.split("\n")) if text else {}


def redact_one(body: bytes, transforms: dict[str, str]) -> tuple[bytes, bool, str | None]:
    """(body, changed, error) for one body that some rule applies to."""
    try:
        members = loads(body)
    except (ValueError, RecursionError):
        return body, False, "redaction: decode payload: malformed JSON"
    if members is None:
        return body, False, None
    if not isinstance(members, dict):
        return body, False, "redaction: decode payload: not a JSON object"
    changed = False
    for key in list(members):
        transform = transforms.get(key.lower())
        if transform == DROP:
            del members[key]
            changed = True
        elif transform is not None:
            members[key], touched = _transformed(transform, members[key])
            changed = changed or touched
    return (dumps(members).encode(), True, None) if changed else (body, False, None)


_RESULT = flat("body BINARY, changed BOOLEAN, error STRING")


@F.arrow_udf(_RESULT)
def _redact(body: pa.Array, spec: pa.Array) -> pa.Array:
    bodies, changes, errors = [], [], []
    for raw, text in zip(body.to_pylist(), spec.to_pylist()):
        if raw is None or text is None:
            result = (raw, False, None)
        else:
            result = redact_one(raw, _spec(text))
        bodies.append(result[0])
        changes.append(result[1])
        errors.append(result[2])
    return pa.StructArray.from_arrays(
        [pa.array(bodies, pa.binary()), pa.array(changes, pa.bool_()), pa.array(errors, pa.string())],
        names=["body", "changed", "error"],
    )


# Declared nondeterministic so that filters on its result do not evaluate it again.
_redact = _redact.asNondeterministic()


def redact_map(fields: Column | str, transforms: Column) -> Column:
    """A MAP<name, text> payload after the transforms (a map by lower-case name)."""
    of = lambda k: F.try_element_at(transforms, F.lower(k))
    kept = F.map_filter(_col(fields), lambda k, v: ~of(k).eqNullSafe(F.lit(DROP)))
    return F.transform_values(
        kept, lambda k, v: F.when(of(k) == HASH, hash_text_field(v)).when((of(k) == MASK) & (v != ""), mask(v)).otherwise(v)
    )


def redact(df: DataFrame, policy: Policy, payload: str = "payload", when: Column | None = None) -> DataFrame:
    """Add ``body``, ``redacted`` and ``redact_error``; ``payload`` keeps the original.

    ``when`` limits redaction to rows that are still of interest.
    """
    if not policy:
        return df.select(
            "*",
            F.col(payload).alias("body"),
            F.lit(False).alias("redacted"),
            F.lit(None).cast("string").alias("redact_error"),
        )
    lines = F.transform(F.map_entries("_transforms"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    applies = F.octet_length(payload) > 0
    if when is not None:
        applies = applies & when
    step = with_transforms(df, policy).withColumn("_spec", F.when(applies, F.array_join(lines, "\n")))
    # Rows without a rule send NULLs, not their bodies, to Python.
    sent = F.when(F.col("_spec").isNotNull(), F.col(payload))
    step = step.withColumn("_r", _redact(sent, F.col("_spec")))
    return step.select(
        *df.columns,
        F.when(F.col("_spec").isNull(), F.col(payload)).otherwise(F.col("_r.body")).alias("body"),
        F.coalesce("_r.changed", F.lit(False)).alias("redacted"),
        F.col("_r.error").alias("redact_error"),
    )
