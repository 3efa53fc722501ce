import base64
import csv
import glob
import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE, events
from sealtrail.operators import anchor, chain, export as x
from sealtrail.operators.retention import with_legal_hold, set_holds


@pytest.fixture(scope="module")
def flagged(spark):
    df = chain.build_chain(events(spark, 1203, step=timedelta(seconds=2), actor='u"1,\n\\x', payload=b"p" * 32))
    df = with_legal_hold(df, set_holds(spark, ["e0001"], True, BASE))
    df = anchor.with_anchored(df, anchor.make_anchors(df.where("id <= 'e0100'")))
    return spark.createDataFrame(df.collect(), df.schema).cache()


def files(path, suffix):
    return sorted(glob.glob(f"{path}/part-*.{suffix}"))


def test_csv_and_json_hold_the_same_rows(spark, flagged, tmp_path):
    rows = {}
    for fmt in x.FORMATS:
        run = x.run_export(flagged, x.ExportJob(f"exp-{fmt}", format=fmt, retention_days=100), str(tmp_path), BASE).first()
        assert (run["status"], run["row_count"], run["retention_days"]) == ("COMPLETE", 1203, 100)
        events_path = run["payload_ref"] + "/events"
        if fmt == "CSV":
            rows[fmt] = []
            for name in files(events_path, "csv"):
                with open(name, newline="") as f:
                    rows[fmt] += list(csv.DictReader(f))
        else:
            rows[fmt] = [json.loads(line) for name in files(events_path, "json") for line in open(name)]
    assert [r["id"] for r in rows["CSV"]] == [f"e{i:04d}" for i in range(1203)] == [r["id"] for r in rows["JSON"]]
    assert list(rows["CSV"][0]) == list(x.CSV_COLUMNS)
    c, j = rows["CSV"][1], rows["JSON"][1]
    assert c["actor_id"] == j["actor_id"] == 'u"1,\n\\x'
    assert (c["legal_hold"], c["anchored"], c["redacted"]) == ("true", "true", "false")
    assert (j["legal_hold"], j["anchored"], rows["JSON"][200]["anchored"]) == (True, True, False)
    assert "sha256:" + base64.b64decode(j["this_hash"]).hex() == c["this_hash"]
    assert c["ts"] == j["ts"] == "2026-07-13T10:00:02Z"


def test_manifest(spark, flagged):
    signer = anchor.hmac_signer(b"k", "key-1")
    m = x.manifest(flagged, "exp1", "CSV", BASE, signer=signer).first()
    last = flagged.orderBy(F.desc("ts")).first()
    assert (m["type"], m["row_count"], m["retention_days"]) == ("audit-export-manifest", 1203, 2555)
    assert (m["window_from"], m["window_to"]) == ("2026-07-13T10:00:00Z", "2026-07-13T10:40:04Z")
    assert m["chain_root"] == "sha256:" + bytes(last["this_hash"]).hex()
    row = x.export_anchor(x.manifest(flagged, "exp1", "CSV", BASE, signer=signer))
    assert anchor.check_anchors(row, flagged).first()["mismatch"] is False


def test_a_set_that_does_not_verify_has_the_zero_root(flagged):
    signer = anchor.hmac_signer(b"k", "key-1")
    for bad in (flagged.where("id <> 'e0005'"), flagged.withColumn("action", F.lit("y"))):
        m = x.manifest(bad, "exp1", "JSON", BASE, signer=signer)
        row = m.first()
        assert row["chain_root"] == "sha256:" + "0" * 64 and row["anchor_id"] is None
        assert row["merkle_root"] != row["chain_root"]
        assert x.export_anchor(m).count() == 0


def test_empty_export(spark, flagged, tmp_path):
    run = x.run_export(flagged, x.ExportJob("none", '{"service":"nobody"}'), str(tmp_path), BASE).first()
    assert (run["status"], run["row_count"], bytes(run["chain_root"])) == ("COMPLETE", 0, bytes(32))


def test_failed_runs_write_nothing(flagged, tmp_path):
    for job in (x.ExportJob("bad", format="XML"), x.ExportJob("bad", query="{")):
        assert x.run_export(flagged, job, str(tmp_path), BASE).first()["status"] == "FAILED"
    assert not (tmp_path / "exports").exists()


def test_an_artifact_is_never_overwritten(flagged, tmp_path):
    job = x.ExportJob("once", '{"to":"2026-07-13T10:00:10Z"}')
    x.run_export(flagged, job, str(tmp_path), BASE)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        x.run_export(flagged, job, str(tmp_path), BASE)


def test_defaults():
    assert [x.requested_format(f) for f in ("csv", "JSON", "xml", None, "")] == ["CSV", "JSON", "JSON", "JSON", "JSON"]
    assert [x.retention_for(*a) for a in ((5, 9), (0, 9), (-1, None), (None, 0))] == [5, 9, 2555, 2555]


def test_latest_state(spark):
    from sealtrail.schema import EXPORT_RUNS

    def run(id_, status, minutes, rows=0):
        return (id_, "", "JSON", 1, status, rows, "", None, None, BASE, BASE + timedelta(minutes=minutes))

    log = spark.createDataFrame([run("a", "PENDING", 0), run("a", "COMPLETE", 0, 7), run("b", "PENDING", 0), run("c", "PENDING", 0), run("c", "FAILED", 3)], EXPORT_RUNS)
    assert {r["id"]: (r["status"], r["row_count"]) for r in x.latest_runs(log).collect()} == {"a": ("COMPLETE", 7), "b": ("PENDING", 0), "c": ("FAILED", 0)}


def test_run_log_in_a_store(spark, flagged, tmp_path):
    from sealtrail.sources.tables import Store

    store = Store(str(tmp_path / "store"))
    job = x.ExportJob("exp9", '{"to":"2026-07-13T10:00:10Z"}', "CSV")
    for _ in range(2):  # asking twice for the same job adds nothing
        store.append(x.pending_run(spark, job, BASE), "export_runs", "exp9/PENDING")
    assert store.read(spark, "export_runs").count() == 1
    run = x.run_export(flagged, job, str(tmp_path), BASE + timedelta(minutes=1))
    store.append(run, "export_runs", "exp9/COMPLETE")
    assert store.read(spark, "export_runs").count() == 2
    latest = x.latest_runs(store.read(spark, "export_runs")).first()
    assert (latest["status"], latest["row_count"], latest["format"]) == ("COMPLETE", 5, "CSV")
    store.append(anchor.make_anchors(flagged), "anchors", "first")
    assert anchor.check_anchors(store.read(spark, "anchors"), flagged).where("mismatch").count() == 0
