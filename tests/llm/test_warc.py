import gzip
import hashlib
import uuid

import pyarrow.fs as fs
import pytest

from sealtrail.llm import warc as W
from sealtrail.sources.scratch import scratch_dir

LONG = "<p>é</p>" * 40
ROWS = [
    (5, "http://a/x y\r\nInjected: 1", LONG), (3, "http://b/", LONG), (9, None, LONG), (3, "http://b/", LONG), (1, "http://c/", "short"),
    (2, "http://c/", "short"), (7, "http://d/", None), (8, "", ""), (None, "http://e/", LONG), (6, "http://f/", "y" * 300_000), (10**15, "u", LONG),
]


def folder(spark):
    return f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"


def expected():
    out = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        same = [r[0] for r in ROWS if r[0] is not None and (r[2] or "").encode() == body]
        revisit = len(body) >= 100 and page is not None and page > min(same)
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=str)


def archive(path):
    system, root = W._file_system(path)
    return {f.base_name: system.open_input_stream(f.path, compression=None).read() for f in system.get_file_info(fs.FileSelector(f"{root}/data"))}


def test_round_trip_and_same_bytes_again(spark, table, monkeypatch):
    monkeypatch.setattr(W, "SHARD_BYTES", 1000)
    monkeypatch.setattr(W, "FILE_BYTES", 500)
    pages = table([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")
    one, two = folder(spark), folder(spark)
    manifest = W.write_warc(pages, one)
    W.write_warc(pages.repartition(5), two)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    read = W.read_warc(spark, one, payloads=True)
    assert sorted((tuple(r) for r in read.select(columns).collect()), key=str) == expected()
    by_id = {r.page_id: r for r in read.collect()}
    assert bytes(by_id[6].payload) == b"y" * 300_000 and by_id[5].payload is None and by_id[9].url is None
    assert by_id[5].url == "http://a/x%20y%0D%0AInjected:%201"
    files = archive(one)
    assert files == archive(two) and len(files) == manifest.count() > 2
    for row in manifest.collect():
        assert hashlib.sha256(files[row.name]).hexdigest() == row.sha256
        assert gzip.decompress(files[row.name]).count(b"WARC/1.1\r\n") == row.records
    W._commit(spark, one)  # again after a failure: nothing changes
    assert archive(one) == files


def test_damage_is_noticed():
    raw = W.record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None)
    assert W.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        W.parse(raw.replace(b"payload\r\n", b"paYload\r\n"))


def test_empty_table(spark, table):
    path = folder(spark)
    assert W.write_warc(table([], "page_id long, url string, html string"), path).count() == 0
    assert W.read_warc(spark, path).count() == 0
