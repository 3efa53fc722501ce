"""Filters, keyset pages, lookups and views over the event table."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from sealtrail.functions.hashing import hash_to_text
from sealtrail.functions.text import format_rfc3339, is_uuid, nanos_of, text_of
from sealtrail.plans.joins import broadcast_if_small, present
from sealtrail.plans.ordering import with_position

# Page sizes.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


@dataclass(frozen=True)
class EventQuery:
    """Conjunction of filters; empty members do not filter.  The window is [from_, to)."""

    from_: datetime | None = None
    to: datetime | None = None
    service: str = ""
    actor: str = ""
    action: str = ""
    target_type: str = ""
    target_id: str = ""

    @classmethod
    def from_json(cls, text: str | bytes | None) -> "EventQuery":
        """Query object of an export.  Unusable times and non-text members are ignored;
        anything but a JSON object is a ValueError."""
        if not text:
            return cls()
        members = json.loads(text)
        if members is None:
            return cls()
        if not isinstance(members, dict):
            raise ValueError("query is not a JSON object")
        texts = {k: v for k, v in members.items() if isinstance(v, str)}
        names = ("service", "actor", "action", "target_type", "target_id")
        return cls(
            from_=_moment(texts.get("from", "")),
            to=_moment(texts.get("to", "")),
            **{n: texts.get(n, "") for n in names},
        )


def _moment(text: str) -> datetime | None:
    nanos = nanos_of(text)
    if nanos is None:
        return None
    seconds, rest = divmod(nanos // 1000, 1_000_000)
    return datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=rest)


def predicates(query: EventQuery, columns: list[str]) -> list[Column]:
    """Conjuncts that reach the Parquet scan.  The table is partitioned by ``event_date``,
    which Catalyst cannot derive from ``ts``, so bounds on it are added here."""
    found = []
    dated = "event_date" in columns
    if query.from_ is not None:
        bound = F.lit(query.from_).cast("timestamp")
        found.append(F.col("ts") >= bound)
        if dated:
            found.append(F.col("event_date") >= F.to_date(bound))
    if query.to is not None:
        bound = F.lit(query.to).cast("timestamp")
        found.append(F.col("ts") < bound)
        if dated:
            found.append(F.col("event_date") <= F.to_date(bound))
    for column, value in (
        ("source_service", query.service),
        ("actor_id", query.actor),
        ("action", query.action),
        ("target_type", query.target_type),
        ("target_id", query.target_id),
    ):
        if value:
            found.append(F.col(column) == value)
    return found


def search(events: DataFrame, query: EventQuery) -> DataFrame:
    """All matching events, unordered."""
    found = predicates(query, events.columns)
    return events.where(reduce(lambda a, b: a & b, found)) if found else events


# --- pages ---


def encode_cursor(ts_ns: int | None, id: str) -> str:
    return "" if ts_ns is None and not id else f"{text_of(ts_ns or 0)}|{id}"


def parse_cursor(text: str) -> tuple[int, str] | None:
    """(epoch nanoseconds, id); None for ''; ValueError for anything malformed."""
    if not text:
        return None
    moment, bar, id_ = text.partition("|")
    nanos = nanos_of(moment)
    if not bar or nanos is None:
        raise ValueError(f"invalid cursor {text!r}")
    return nanos, id_


def after_cursor(events: DataFrame, cursor: str) -> DataFrame:
    """Events strictly after (ts, id).  The first conjunct is implied by the second but,
    unlike it, is pushed into the scan."""
    at = parse_cursor(cursor)
    if at is None:
        return events
    moment = F.timestamp_micros(F.lit(at[0] // 1000))
    if "event_date" in events.columns:
        events = events.where(F.col("event_date") >= F.to_date(moment))
    return events.where(
        (F.col("ts") >= moment) & ((F.col("ts") > moment) | (F.col("id") > F.lit(at[1])))
    )


def page_rows(events: DataFrame, query: EventQuery, limit: int = DEFAULT_LIMIT, cursor: str = "") -> DataFrame:
    """The page's rows in (ts, id) order; limits outside 1..1000 mean 1000."""
    limit = limit if 0 < limit <= MAX_LIMIT else MAX_LIMIT
    return after_cursor(search(events, query), cursor).orderBy("ts", "id").limit(limit)


def page(
    events: DataFrame, query: EventQuery, limit: int = DEFAULT_LIMIT, cursor: str = ""
) -> tuple[DataFrame, str]:
    """The page, as a local table of at most 1000 rows, and the cursor of the next one ('' on the last page).

    One job: the row behind the page tells whether there is another.
    """
    limit = limit if 0 < limit <= MAX_LIMIT else MAX_LIMIT
    found = after_cursor(search(events, query), cursor).orderBy("ts", "id").limit(limit + 1)
    rows = found.toArrow()
    shown = events.sparkSession.createDataFrame(rows.slice(0, limit), found.schema)
    if rows.num_rows <= limit:
        return shown, ""
    return shown, encode_cursor(rows["ts_ns"][limit - 1].as_py(), rows["id"][limit - 1].as_py())


@dataclass(frozen=True)
class Zone:
    """What a data file holds: ``rows`` events from ``first`` to ``last``, both (microseconds, id)."""

    path: str
    rows: int
    first: tuple[int, str]
    last: tuple[int, str]


def seek(zones: list[Zone], start: int, stop: int) -> tuple[list[Zone], int]:
    """The files that rows ``start`` to ``stop`` (from 0, in (ts, id) order) can be in, and the rows before those files.

    Files may overlap.  A file's rows stand behind all files that end before it begins, and in
    front of all that begin after its end.
    """
    ends = sorted((z.last, z.rows) for z in zones)
    begins = sorted((z.first, z.rows) for z in zones)
    end_keys, begin_keys = [e[0] for e in ends], [b[0] for b in begins]
    ended = list(accumulate((e[1] for e in ends), initial=0))
    begun = list(accumulate((b[1] for b in begins), initial=0))
    kept, before = [], 0
    for zone in zones:
        least = ended[bisect_left(end_keys, zone.first)]
        most = begun[bisect_right(begin_keys, zone.last)]
        if most <= start:
            before += zone.rows
        elif least < stop:
            kept.append(zone)
    return kept, before


def page_at(files: Callable[[list[str]], DataFrame], zones: list[Zone], number: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Page ``number`` (from 1) of a search without filters; ``files`` reads the given data files.

    Only the files that can hold the page are read.  ``sum(z.rows for z in zones)`` is the total.
    """
    limit = limit if 0 < limit <= MAX_LIMIT else MAX_LIMIT
    start = (number - 1) * limit
    kept, before = seek(zones, start, start + limit)
    return files([z.path for z in kept]).orderBy("ts", "id").offset(start - before).limit(limit)


def assign_pages(events: DataFrame, query: EventQuery, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Add ``page`` (from 1) to every matching event: all pages in one job."""
    numbered = with_position(search(events, query))
    return numbered.withColumn("page", F.ceil(F.col("position") / F.lit(limit)).cast("bigint"))


# --- lookups and views ---


def get(events: DataFrame, id: str) -> DataFrame:
    """The event with this id; no row if there is none.

    A literal, so that files and row groups are skipped by their bounds and Bloom filters.
    """
    return events.where(F.col("id") == F.lit(id))


def lookup(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose id is listed in column ``id`` of ``ids``."""
    return events.join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi")


def missing_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed ids without an event; ids that are no UUID are never found."""
    wanted = ids.select("id").distinct()
    return wanted.join(present(wanted.where(is_uuid("id")), events, "id"), "id", "left_anti")


def event_view(events: DataFrame) -> DataFrame:
    """Reader's form: RFC 3339 text and prefixed hashes."""
    flags = [c for c in ("anchored", "legal_hold") if c in events.columns]
    return events.select(
        "id",
        format_rfc3339().alias("ts"),
        "source_service",
        "actor_id",
        "action",
        "target_type",
        "target_id",
        *flags,
        "redacted",
        "payload_ref",
        *[hash_to_text(c).alias(c) for c in ("payload_hash", "prev_hash", "this_hash")],
    )
