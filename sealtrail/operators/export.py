"""Regulator exports: event files in JSON or CSV plus a one-row manifest."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealtrail.functions.hashing import hash_to_text, zero_hash
from sealtrail.functions.text import format_rfc3339
from sealtrail.operators.anchor import Signer, signature
from sealtrail.operators.chain import OK, SEGMENT_MINUTES, verify_chain
from sealtrail.operators.ingest import RETENTION_DAYS
from sealtrail.operators.merkle import merkle_root
from sealtrail.operators.search import EventQuery, search
from sealtrail.schema import EXPORT_RUNS

# CSV columns in file order, manifest type, formats.
CSV_COLUMNS = (
    "id", "ts", "source_service", "actor_id", "action", "target_type", "target_id",
    "payload_hash", "prev_hash", "this_hash", "anchored", "legal_hold", "redacted", "payload_ref",
)
MANIFEST_TYPE = "audit-export-manifest"
FORMATS = ("JSON", "CSV")


def checked_format(text: str | None) -> str:
    """'' and NULL mean JSON; anything but JSON or CSV is a ValueError."""
    fmt = text or "JSON"
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {text!r}")
    return fmt


def requested_format(text: str | None) -> str:
    """A requester's format: upper-cased, anything unknown becomes JSON."""
    fmt = (text or "").upper()
    return fmt if fmt in FORMATS else "JSON"


def retention_for(requested: int | None, default: int | None = None) -> int:
    for days in (requested, default):
        if days and days > 0:
            return days
    return RETENTION_DAYS


def csv_rows(events: DataFrame) -> DataFrame:
    """The CSV form of each event: text only, fixed columns."""
    text = {"ts": format_rfc3339()}
    for name in ("payload_hash", "prev_hash", "this_hash"):
        text[name] = hash_to_text(name)
    for name in ("anchored", "legal_hold", "redacted"):
        text[name] = F.col(name).cast("string")
    return events.select(*[text.get(n, F.col(n)).alias(n) for n in CSV_COLUMNS])


def json_rows(events: DataFrame) -> DataFrame:
    """The JSON form: RFC 3339 text, hashes base64."""
    hashes = ("payload_hash", "prev_hash", "this_hash")
    return events.select(
        *[
            format_rfc3339().alias("ts") if n == "ts" else F.base64(n).alias(n) if n in hashes else F.col(n)
            for n in CSV_COLUMNS
        ]
    )


def manifest(
    exported: DataFrame,
    export_id: str,
    fmt: str = "JSON",
    generated_at: datetime | None = None,
    retention_days: int | None = None,
    signer: Signer | None = None,
    window_start: datetime | None = None,
    mode: str = "segmented",
    minutes: int = SEGMENT_MINUTES,
) -> DataFrame:
    """One row over the exported events.

    ``chain_root`` is the last hash if the exported set verifies as it stands, else the
    zero hash: a filter that drops events from the middle breaks links.  ``merkle_root``
    holds for any subset.  An anchor is named only for a set that verifies.
    """
    verified = verify_chain(exported, mode=mode, window_start=window_start, minutes=minutes)
    key = F.struct("ts", "id")
    facts = verified.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(F.struct("ts", "ts_ns")).alias("first"),
        F.max(F.struct("ts", "ts_ns")).alias("last"),
        F.max(key).alias("head"),
        (F.count_if(F.col("status") != OK) == 0).alias("intact"),
        F.max_by("this_hash", key).alias("last_hash"),
    )
    root = F.when(F.col("intact"), F.coalesce("last_hash", zero_hash())).otherwise(zero_hash())
    tree = merkle_root(exported, minutes=minutes).select(F.col("root").alias("tree"))
    # Two sides of exactly one row each.
    row = facts.withColumn("root", root).join(F.broadcast(tree), F.lit(True))
    row = row.withColumn("_signed", signature(F.when(F.col("intact"), F.col("root")), signer, required=False))
    return row.select(
        F.lit(MANIFEST_TYPE).alias("type"),
        F.lit(export_id).alias("export_id"),
        F.lit(checked_format(fmt)).alias("format"),
        format_rfc3339("first.ts", "first.ts_ns").alias("window_from"),
        format_rfc3339("last.ts", "last.ts_ns").alias("window_to"),
        "row_count",
        hash_to_text("root").alias("chain_root"),
        hash_to_text("tree").alias("merkle_root"),
        F.when(F.col("_signed.signature").isNotNull(), F.lit(f"anchor-{export_id}")).alias("anchor_id"),
        F.col("_signed.key_id").alias("kms_key_id"),
        F.lower(F.hex("_signed.signature")).alias("signature_hex"),
        F.when(F.col("_signed.signature").isNotNull(), F.col("head.id")).alias("last_event_id"),
        F.when(F.col("_signed.signature").isNotNull(), F.col("head.ts")).alias("last_event_ts"),
        F.lit(retention_for(retention_days)).alias("retention_days"),
        F.lit(generated_at).cast("timestamp").alias("generated_at"),
    )


def export_anchor(manifest_row: DataFrame) -> DataFrame:
    """The anchor row (schema ANCHORS) a signed manifest stands for; none if unsigned."""
    return manifest_row.where(F.col("anchor_id").isNotNull()).select(
        F.col("anchor_id").alias("id"),
        F.col("generated_at").alias("anchored_at"),
        F.unhex(F.substring("chain_root", 8, 64)).alias("root_hash"),
        "last_event_id",
        "last_event_ts",
        F.unhex("signature_hex").alias("signature"),
        F.col("kms_key_id").alias("key_id"),
        F.col("row_count").alias("event_count"),
    )


@dataclass(frozen=True)
class ExportJob:
    id: str
    query: str = ""
    format: str = "JSON"
    retention_days: int | None = None


def run_export(
    events: DataFrame,
    job: ExportJob,
    path: str,
    generated_at: datetime,
    signer: Signer | None = None,
    log: Callable[[DataFrame], None] | None = None,
    **options,
) -> DataFrame:
    """Write ``<path>/exports/<id>/events`` and ``…/manifest``; return the run's log row.

    Event files are written by all tasks, sorted by (ts, id) within and across files
    (``part-00000`` first).  A bad query or format gives a FAILED row and no files.  Any
    other failure is handed to ``log`` as a FAILED row (to append to the run log) and raised.
    """
    try:
        return _run_export(events, job, path, generated_at, signer, **options)
    except Exception:
        if log is not None:
            log(_run_row(events.sparkSession, job, retention_for(job.retention_days), "FAILED", generated_at))
        raise


def _run_export(
    events: DataFrame, job: ExportJob, path: str, generated_at: datetime, signer: Signer | None, **options
) -> DataFrame:
    spark = events.sparkSession
    base = f"{path.rstrip('/')}/exports/{job.id}"
    retention = retention_for(job.retention_days)
    try:
        query = EventQuery.from_json(job.query)
        fmt = checked_format(job.format)
    except ValueError:
        return _run_row(spark, job, retention, "FAILED", generated_at)
    exported = search(events, query)
    ordered = exported.repartitionByRange("ts", "id").sortWithinPartitions("ts", "id")
    writer_options = {"mode": "errorifexists"}
    if fmt == "CSV":
        csv_rows(ordered).write.option("header", True).option("escape", '"').csv(f"{base}/events", **writer_options)
    else:
        json_rows(ordered).write.json(f"{base}/events", **writer_options)
    row = manifest(
        exported, job.id, fmt, generated_at, retention, signer, window_start=query.from_, **options
    )
    row.write.json(f"{base}/manifest", ignoreNullFields=True, **writer_options)
    # The manifest as written: it is not computed a second time.
    written = spark.read.schema(row.schema).json(f"{base}/manifest")
    return _run_row(spark, job, retention, "COMPLETE", generated_at, base).drop("row_count", "chain_root", "anchor_id").join(
        F.broadcast(
            written.select(
                "row_count",
                F.unhex(F.substring("chain_root", 8, 64)).alias("chain_root"),
                "anchor_id",
            )
        ),
        F.lit(True),
    ).select(*_RUN_COLUMNS)


_RUN_COLUMNS = (
    "id", "query", "format", "retention_days", "status", "row_count", "payload_ref",
    "chain_root", "anchor_id", "created_at", "changed_at",
)


def _run_row(spark: SparkSession, job: ExportJob, retention: int, status: str, at: datetime, ref: str = "") -> DataFrame:
    row = (job.id, job.query, job.format, retention, status, 0, ref, None, None, at, at)
    return spark.createDataFrame([row], EXPORT_RUNS)


def pending_run(spark: SparkSession, job: ExportJob, at: datetime) -> DataFrame:
    """The log row of a job that has been asked for but not run."""
    return _run_row(spark, job, retention_for(job.retention_days), "PENDING", at)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest logged state of each export run; at equal times a finished state wins."""
    others = [c for c in runs.columns if c != "id"]
    recency = F.struct("changed_at", F.col("status") != "PENDING", "status")
    latest = runs.groupBy("id").agg(F.max_by(F.struct(*others), recency).alias("r"))
    return latest.select("id", "r.*")
