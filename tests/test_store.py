"""The commit log, snapshots, compaction and the index of stored ids."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import BASE, events
from sealtrail.operators.chain import build_chain, verify_chain
from sealtrail.operators.ingest import dedup_known
from sealtrail.operators.sweep import sweep
from sealtrail.plans.joins import present
from sealtrail.sources import commits, id_index
from sealtrail.sources.commits import Folder, Log
from sealtrail.sources.files import put_new
from sealtrail.sources.id_index import FILTERS, RUNS, IdIndex
from sealtrail.sources.tables import SCHEMAS, Store
from sealtrail.streaming import committed


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"))


def holds(spark, *ids):
    return spark.createDataFrame([(i, True, BASE) for i in ids], "id string, hold boolean, changed_at timestamp")


def ids_in(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_log_folds_to_the_same_state_with_and_without_checkpoints(tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT", 4)
    log = Log(str(tmp_path))
    live: set[str] = set()
    for n in range(15):
        removed = sorted(live)[:1] if n % 3 == 2 else []
        log.append("w", n, [Folder("t", f"t/{n}", n, 1, 10, facts={"n": n})], removed)
        live = (live - set(removed)) | {f"t/{n}"}
    assert set(log.state().live) == live and log.latest() == 14
    assert [log.state(v).version for v in (0, 3, 7, 14)] == [0, 3, 7, 14]
    assert log.append("w", 14, [], []) is None and log.append("w", 3, [], []) is None  # committed before
    assert log.state().folders("t")[-1].facts == {"n": 14}
    with pytest.raises(RuntimeError):
        log.append("w", 15, [], ["t/none"])


def test_two_writers_get_different_versions(tmp_path, monkeypatch):
    one, two, state = Log(str(tmp_path)), Log(str(tmp_path)), Log.state
    raced = []

    def slow(self, version=None):
        found = state(self, version)
        if not raced:
            raced.append(True)
            two.append("two", 0, [Folder("t", "t/two", 0, 1, 1)], [])
        return found

    monkeypatch.setattr(Log, "state", slow)
    one.append("one", 0, [Folder("t", "t/one", 0, 1, 1)], [])
    assert sorted(f.version for f in one.state().live.values()) == [0, 1]


def test_a_file_is_whole_or_absent(tmp_path):
    assert put_new(f"{tmp_path}/a/x.json", b"1") and not put_new(f"{tmp_path}/a/x.json", b"2")
    assert (tmp_path / "a/x.json").read_bytes() == b"1" and len(list((tmp_path / "a").iterdir())) == 1


def test_snapshots_stay_as_they_were(spark, store):
    store.append(holds(spark, "a"), "legal_holds", "first")
    before = store.read(spark, "legal_holds")
    store.append(holds(spark, "b"), "legal_holds", "second")
    store.append(holds(spark, "b", "c"), "legal_holds", "second")  # the same key again
    assert ids_in(before) == ["a"] and ids_in(store.read(spark, "legal_holds")) == ["a", "b"]
    assert ids_in(store.read(spark, "legal_holds", version=0)) == ["a"]
    assert store.read(spark, "anchors").count() == 0


def test_a_transaction_is_seen_whole_or_not_at_all(spark, store):
    with pytest.raises(OSError):
        with store.begin(spark, "w", 0) as tx:
            tx.write(holds(spark, "a"), "legal_holds")
            raise OSError("disk")
    assert store.read(spark, "legal_holds").count() == 0
    with store.begin(spark, "w", 0) as tx:
        tx.write(holds(spark, "b"), "legal_holds")
        assert store.read(spark, "legal_holds").count() == 0 and ids_in(tx.read("legal_holds")) == ["b"]
    assert ids_in(store.read(spark, "legal_holds")) == ["b"]
    assert store.clean() == 1 and ids_in(store.read(spark, "legal_holds")) == ["b"]
    with store.begin(spark, "w", 0) as tx:
        assert tx.done and tx.write(holds(spark, "c"), "legal_holds") is None
    assert ids_in(store.read(spark, "legal_holds")) == ["b"]


def test_compaction_keeps_rows_hashes_and_results(spark, store):
    chained = build_chain(events(spark, 90).withColumn("event_date", F.to_date("ts")))
    chained = chained.withColumns({"legal_hold_initial": F.lit(False), "ingested_at": F.lit(BASE)}).cache()
    for batch in range(3):
        store.write_batch(chained.where(F.col("pos") % 3 == batch), "audit_events", batch)
    old = store.read(spark, "audit_events")
    rows = sorted(map(str, old.collect()))
    assert store.compact(spark, "audit_events") and not store.compact(spark, "audit_events")
    new = store.read(spark, "audit_events")
    assert len(store.log.state().folders("audit_events")) == 1
    assert sorted(map(str, new.collect())) == rows == sorted(map(str, old.collect()))
    assert verify_chain(new).where("status <> 'ok'").count() == 0
    assert sweep(new).first() == sweep(chained).first()
    assert len(new.inputFiles()) < len(old.inputFiles())
    store.clean(keep_versions=0)
    assert sorted(map(str, store.read(spark, "audit_events").collect())) == rows


# --- the index of ids ---


def some(spark, *numbers):
    return spark.createDataFrame([(f"id-{n}",) for n in numbers], "id string")


def index_of(store, **shape):
    return IdIndex(store, **{"first_bits": 4, "fanout_bits": 1, "bucket_bits": 5, **shape})


def add(spark, store, index, batch, numbers):
    with store.begin(spark, "ingest", batch) as tx:
        index.add(tx, some(spark, *numbers))


def test_the_index_knows_what_was_added(spark, store):
    index = index_of(store)
    assert index.known(some(spark, 1, 2)).count() == 0
    for batch in range(6):
        add(spark, store, index, batch, range(batch * 40, batch * 40 + 40 - batch))
        add(spark, store, index, batch, range(1000, 1040))  # a repeated batch adds nothing
        index.merge(spark)
    stored = {f"id-{n}" for batch in range(6) for n in range(batch * 40, batch * 40 + 40 - batch)}
    asked = some(spark, *range(0, 1100), *range(50))
    assert set(ids_in(index.known(asked))) == stored and index.known(asked).count() == len(stored)
    runs = store.log.state().folders(RUNS)
    levels = [r.facts["level"] for r in runs]
    assert max(levels) > 2 and all(levels.count(n) < 2 for n in levels) and sum(r.facts["rows"] for r in runs) == len(stored)
    # the largest run is cut into buckets, and ids from few of them open few
    assert index._bits(max(levels))[0] > 0
    assert ids_in(index.known(some(spark, 3))) == ["id-3"]
    assert ids_in(index.known(asked.where("id IS NULL"))) == []


def test_an_older_snapshot_knows_what_it_had(spark, store):
    index = index_of(store)
    add(spark, store, index, 0, range(10))
    state = store.log.state()
    add(spark, store, index, 1, range(10, 20))
    assert index.known(some(spark, *range(20)), state).count() == 10


def test_new_ids_open_no_runs_however_many_are_stored(spark, store, monkeypatch):
    """Bytes that a probe reads do not grow with the store."""
    index, opened = IdIndex(store, first_bits=7, bucket_bits=9), []
    open_ = Store.open

    def watched(self, spark_, table, paths, schema):
        found = open_(self, spark_, table, paths, schema)
        opened.append((table, sum(f.bytes for f in store.log.state().live.values() if f.table == table and any(p.startswith(f.path) for p in paths))))
        return found

    for batch in range(10):
        monkeypatch.setattr(Store, "open", watched)
        opened.append(("batch", batch))
        assert index.known(some(spark, *range(batch * 500, batch * 500 + 500))).count() == 0
        monkeypatch.setattr(Store, "open", open_)
        add(spark, store, index, batch, range(batch * 500, batch * 500 + 500))
        index.merge(spark)
    starts = [opened.index(("batch", b)) for b in range(10)] + [len(opened)]
    read = [sum(n for t, n in opened[i:j] if t == RUNS) for i, j in zip(starts, starts[1:])]
    # a filter errs about once in a thousand ids, whatever it holds
    assert sorted(read)[5] == 0 and max(read[5:]) <= 2 * max(read[:5]) + 1
    stored = sum(f.bytes for f in store.log.state().folders(RUNS))
    assert sum(f.bytes for f in store.log.state().folders(FILTERS)) < stored


def test_the_index_agrees_with_a_scan(spark, store):
    index = IdIndex(store)
    add(spark, store, index, 0, range(0, 5000, 3))
    asked = some(spark, *range(2000))
    table = some(spark, *range(0, 5000, 3))
    assert ids_in(index.known(asked)) == ids_in(present(asked, table, "id"))
    facts = json.loads(json.dumps(store.log.state().folders(RUNS)[0].facts))
    assert facts["rows"] == 1667


def test_a_probe_moves_hashes_and_the_ids_once(spark, store, monkeypatch):
    index, probes = IdIndex(store), []
    perhaps = IdIndex._perhaps
    add(spark, store, index, 0, range(0, 3000, 3))
    monkeypatch.setattr(IdIndex, "_perhaps", lambda *a: probes.append(perhaps(*a)) or probes[-1])
    asked = some(spark, *range(1000), *range(20)).unionByName(spark.createDataFrame([(None,)], "id string"))
    stored = sorted(f"id-{n}" for n in range(0, 1000, 3))
    assert sorted(ids_in(index.known(asked))) == stored
    monkeypatch.setattr(id_index, "_MOST_HITS", 0)  # as if there were more of them
    assert sorted(ids_in(index.known(asked))) == stored
    assert [p.columns for p in probes] == [["h", "level", "run", "bucket"]] * 2


def test_known_ids_go_before_the_messages_move(spark):
    rows = [("a", 0, 2), ("a", 0, 1), ("b", 0, 3), (None, 0, 4), (None, 0, 5)]
    messages = spark.createDataFrame([("t", p, o, i, "body") for i, p, o in rows], "topic string, partition int, offset long, id string, body string")
    new = dedup_known(messages, spark.createDataFrame([("b",), (None,)], "id string"))
    assert sorted((r["id"] or "", r["offset"]) for r in new.collect()) == [("", 4), ("a", 1)]
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("LeftAnti")  # the root is the semi-join


def test_a_large_file_is_read_by_many_tasks_and_each_row_once(spark, store, monkeypatch):
    store.append(holds(spark, *[f"id-{n}" for n in range(3000)]).coalesce(1), "legal_holds", "large")
    store.append(holds(spark, "small"), "legal_holds", "small")
    monkeypatch.setattr(committed, "PARTITION_BYTES", 4096)
    monkeypatch.setattr(committed, "BATCH_ROWS", 100)
    reader = committed.CommittedReader(store.root, "legal_holds", SCHEMAS["legal_holds"], -1)
    parts = [[r["id"] for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions({"version": -1}, reader.latestOffset())]
    assert len(parts) > 3 and max(map(len, parts)) < 1500
    assert sorted(i for part in parts for i in part) == sorted([*(f"id-{n}" for n in range(3000)), "small"])
