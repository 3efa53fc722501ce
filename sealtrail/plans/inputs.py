"""Shared inputs of the registered queries.

Chaining is the expensive step, so the chained sample table is written once per session
and source directory, as a real store would hold it, and every reader query starts there.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealtrail.functions.hashing import hex_text
from sealtrail.operators.anchor import make_anchors
from sealtrail.operators.chain import build_chain
from sealtrail.operators.ingest import judge_messages
from sealtrail.operators.redact import Policy, parse_policy
from sealtrail.session import configure
from sealtrail.sources import samples
from sealtrail.sources.scratch import stored

AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)

POLICY_TEXT = """
rules:
  - service: click
    action: "*"
    fields:
      k: hash
  - service: purchase
    action: purchase
    fields:
      k: mask
      other: drop
  - service: view
    action: view
    fields:
      k: drop
  - service: "*"
    action: view
    fields:
      k: mask
      K: hash
  - service: "*"
    action: signup
    fields:
      k: none
"""

ORDER_POLICY_TEXT = """
rules:
  - service: orders
    action: order.F
    fields:
      customer: hash
      priority: mask
  - service: "*"
    action: order.P
    fields:
      total: drop
"""


def policy() -> Policy:
    return parse_policy(POLICY_TEXT)


_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = stored(make(), name)
    return _stored[key]


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` chained in hourly segments."""
    return _once(spark, sf_dir, "chained", lambda: build_chain(samples.audit_events(spark, sf_dir)))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily anchors of the chained events."""
    return _once(spark, sf_dir, "anchors", lambda: make_anchors(chained(spark, sf_dir), minutes=1440))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire messages of ``events`` with their verdicts."""
    return _once(
        spark, sf_dir, "judged", lambda: judge_messages(samples.wire_messages(spark, sf_dir), policy())
    )


def micros(column: str, name: str | None = None) -> Column:
    return F.unix_micros(column).alias(name or f"{column}_us")


def hexed(*columns: str) -> list[Column]:
    return [hex_text(c).alias(c) for c in columns]
