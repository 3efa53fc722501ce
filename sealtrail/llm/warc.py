"""Deterministic sharded WARC archives.

Records are dealt to shards by ranges of their ids and sorted within.  The ranges come from
a histogram of payload bytes over the ids, so they depend on the data alone, as do record
headers, digests and the places where a shard's files roll over (by compressed size): writing
a table again gives the same bytes under the same names.

A task writes its files under temporary names of its own attempt and returns what it wrote;
the manifest of the successful attempts is stored as a table, and only then are its files
renamed.  A task that is lost or repeated leaves files that no manifest names.  Readers go by
the manifest.

Of records with equal payloads of ``REVISIT_FROM`` bytes or more only the first is written in
full; the others are revisits of it.  Payloads are shuffled once: which rows are revisits is
found on ids and digests, and meets the payloads in the same range-partitioned sort.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sealtrail.sources.scratch import scratch_dir

REVISIT_FROM = 100
#: Payload bytes of a shard, compressed bytes at which a file is closed, ranges of the histogram.
SHARD_BYTES = 32 << 20
FILE_BYTES = 8 << 20
RANGES = 4096
#: Shards for records without an id.
UNNAMED = 64

#: Fixed values of the format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"

_MANIFEST = (
    "name string, temporary string, shard int, number int, records long, bytes long, sha256 string, "
    "first_id long, last_id long"
)


def _file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path within it; every worker opens its own."""
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _safe(url: str) -> str:
    """A URL as a header value: control characters and blanks percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record with regenerated headers and digests; ``refers_to`` makes it a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i, d: f"<urn:sealtrail:page:{'none' if i is None else i}:{d[:16]}>"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id, digest)),
        ("WARC-Date", _DATE),
        *([("WARC-Target-URI", _safe(url))] if url is not None else []),
        *([("Page-ID", str(page_id))] if page_id is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([
            ("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to)),
        ] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"\r\n".join([_VERSION, *[f"{k}: {v}".encode() for k, v in headers]])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; raises if its digests do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0].encode() != _VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not hold")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": digest, "record_type": "revisit" if revisit else "response",
        "refers_to": number("Refers-To-Page-ID"), "payload": None if revisit else payload,
    }


class _Shard:
    """Writes the files of one shard, one after the other, under temporary names."""

    def __init__(self, system: arrow_fs.FileSystem, folder: str, shard: int):
        self.system, self.folder, self.shard, self.number = system, folder, shard, 0
        self.out, self.done = None, []

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{self.shard:06d}-{self.number:04d}.warc.gz"
            self.out = self.system.open_output_stream(self.path, compression=None)
            self.size, self.records, self.sha, self.first = 0, 0, hashlib.sha256(), page_id
        packed = gzip.compress(raw, 6, mtime=0)
        self.out.write(packed)
        self.sha.update(packed)
        self.size, self.records, self.last = self.size + len(packed), self.records + 1, page_id
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.done.append((name, self.path, self.shard, self.number, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
            self.out, self.number = None, self.number + 1


def _shards(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (``id, bytes, digest, ...``) with a shard number by ranges of the id."""
    ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    unnamed = F.pmod(F.xxhash64("digest"), F.lit(UNNAMED)).cast("int")
    if ends["low"] is None:
        return rows.withColumn("shard", unnamed), UNNAMED
    width = (ends["high"] - ends["low"]) // RANGES + 1
    at = F.expr(f"cast((id - {ends['low']}L) div {width}L as int)")
    held = rows.where("id is not null").groupBy(at.alias("range")).agg(F.sum("bytes").alias("bytes"))
    sizes = {r["range"]: r["bytes"] for r in held.collect()}  # RANGES rows at most
    shard_of, shard, size = [], UNNAMED, 0
    for i in range(RANGES):
        shard_of.append(shard)
        size += sizes.get(i, 0) or 0
        if size >= SHARD_BYTES:
            shard, size = shard + 1, 0
    by_range = F.element_at(F.array(*[F.lit(s) for s in shard_of]), at + 1)
    return rows.withColumn("shard", F.when(F.col("id").isNull(), unnamed).otherwise(by_range)), shard + 1


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` to the new folder ``path``; gives the manifest.

    ``page_id`` is an integer, ``payload`` a string written as UTF-8 (null: empty).  Of equal
    payloads of 100 bytes or more the row with the smallest id is a response and others revisit
    it (rows that repeat that id are responses, too); shorter ones are all responses, as are
    rows without an id.  A null URL leaves its header out; control characters and blanks of
    one are percent-encoded.  Other columns are not archived; an empty table gives an empty
    manifest.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), text.alias("payload")).withColumns({
        "digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long"),
    })
    named = rows.where((F.col("bytes") >= REVISIT_FROM) & F.col("id").isNotNull()).select("id", "digest")
    firsts = named.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    marks = named.join(firsts, "digest").where("id > refers_to").select("id", "digest", "refers_to").distinct()

    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = rows.select("id", "digest", "url", "payload", "bytes", nothing("refers_to", "long")).unionByName(
        marks.select("id", "digest", nothing("url", "string"), nothing("payload", "binary"), nothing("bytes", "long"), "refers_to")
    )
    sharded, shards = _shards(both)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(path)
        folder = f"{root}/_temporary/{uuid.uuid4().hex}"
        system.create_dir(folder)
        open_, mark, done = None, None, []
        for batch in batches:
            for shard, i, digest, address, body, size, to in zip(*(batch[c] for c in batch.columns)):
                i = None if pd.isna(i) else int(i)
                if not pd.isna(to):  # sorted in front of the rows it speaks of
                    mark = (i, digest, int(to))
                    continue
                if open_ is None or open_.shard != shard:
                    if open_:
                        open_.close()
                        done += open_.done
                    open_ = _Shard(system, folder, int(shard))
                refers_to = mark[2] if mark and mark[:2] == (i, digest) else None
                open_.add(i, record(i, address, bytes(body), digest, int(size), refers_to))
        if open_:
            open_.close()
            done += open_.done
        columns = [c.split()[0] for c in _MANIFEST.split(", ")]
        out = pd.DataFrame(done, columns=columns)
        yield out.astype({"first_id": "Int64", "last_id": "Int64"})

    ordered = sharded.repartitionByRange(shards, "shard").sortWithinPartitions(
        "shard", "id", "digest", F.col("refers_to").asc_nulls_last(), "url"
    )
    columns = ordered.select("shard", "id", "digest", "url", "payload", "bytes", "refers_to")
    columns.mapInPandas(write, _MANIFEST).write.parquet(f"{path}/manifest")
    return _commit(spark, path)


def _commit(spark: SparkSession, path: str) -> DataFrame:
    """Rename the manifest's files to their names.  May be repeated after a failure."""

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(path)
        system.create_dir(f"{root}/data")
        for batch in batches:
            for name, temporary in zip(batch["name"], batch["temporary"]):
                there = system.get_file_info(temporary).type != arrow_fs.FileType.NotFound
                if there:
                    system.move(temporary, f"{root}/data/{name}")
                elif system.get_file_info(f"{root}/data/{name}").type == arrow_fs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield batch[["name"]]

    manifest = spark.read.parquet(f"{path}/manifest")
    manifest.mapInPandas(rename, "name string").write.mode("overwrite").parquet(f"{path}/committed")
    return manifest


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    With ``payloads`` also the responses' payloads (null for revisits).  Digests are checked.
    """
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    shape += ", payload binary" * payloads

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(path)
        for batch in batches:
            for name in batch["name"]:
                with system.open_input_stream(f"{root}/data/{name}", compression=None) as source:
                    raw = source.read()
                found = []
                while raw:
                    member = zlib.decompressobj(31)
                    found.append(parse(member.decompress(raw)))
                    raw = member.unused_data
                    if not payloads:
                        found[-1].pop("payload")
                yield pd.DataFrame(found).astype({"page_id": "Int64", "refers_to": "Int64"})

    names = spark.read.parquet(f"{path}/manifest").select("name")
    files = max(1, names.count())
    return names.repartition(min(files, 10_000), "name").mapInPandas(read, shape)


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
