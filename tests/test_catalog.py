import threading
import time
from urllib.parse import quote

import pytest

from tidelog.catalog import STALE_MS, Catalog, now_ms
from tidelog.dataset import DatasetClient
from tidelog.errors import AlreadyExists, Cancelled, CatalogError, InvalidArgument, InvalidOptions, InvalidTerm, NotFound, ReadOnly, ScanError, VersionConflict
from tidelog.operators.scan import ScanFilter, ScanRequest
from tidelog.timeline import Cursor, Recorder, Timeline, TimelineOptions
from tidelog.types import Dataset, DatasetSchema, Field, Policies


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog.build(spark, {"root": f"file://{tmp_path}/catalog"})


SCHEMA = DatasetSchema((Field("id", "int64", False), Field("kind", "string"), Field("body", "json")))


def test_unknown_option(spark, tmp_path):
    with pytest.raises(InvalidOptions):
        Catalog.build(spark, {"root": str(tmp_path), "backend": "x"})
    with pytest.raises(InvalidOptions):
        Field("x", "decimal")


def test_dataset_versions(catalog):
    made = catalog.create_dataset(Dataset("events", SCHEMA, Policies(max_age_ms=5, indexes=("kind",))))
    assert made.version == 1 and made.created_ms > 0 and made.policies.indexes == ("kind",)
    with pytest.raises(AlreadyExists):
        catalog.create_dataset(Dataset("events", SCHEMA))
    new = catalog.update_dataset(made, 1)
    assert new.version == 2
    with pytest.raises(VersionConflict):
        catalog.update_dataset(made, 1)
    with pytest.raises(VersionConflict):
        catalog.delete_dataset("events", 1)
    catalog.create_dataset(Dataset("a", SCHEMA))
    assert [d.name for d in catalog.list_datasets()] == ["a", "events"]
    catalog.delete_dataset("events", 2)
    with pytest.raises(NotFound):
        catalog.get_dataset("events")
    assert catalog.create_dataset(Dataset("events", SCHEMA)).version == 4
    assert DatasetSchema.of(SCHEMA.struct()) == SCHEMA


def test_timelines_and_segments(catalog):
    a = catalog.create_timeline("a")
    assert a.value["timeline_id"] == 1 and catalog.get_or_create_timeline("b").value["timeline_id"] == 2
    assert [catalog.new_term("a").value["term"] for _ in range(3)] == [1, 2, 3]
    for start in (1, 21, 41):
        catalog.put_segment("a", start, [f"u{start}"])
    assert [catalog.segment_for("a", o) and catalog.segment_for("a", o)["start_offset"] for o in (0, 1, 20, 21, 99)] == [None, 1, 1, 21, 41]
    assert catalog.last_segment("a")["ensemble"] == ["u41"]
    assert catalog.change_ensemble("a", 40, ["x"])["start_offset"] == 41 and catalog.last_segment("a")["ensemble"] == ["x"]
    assert catalog.change_ensemble("a", 50, ["y"])["start_offset"] == 51
    with pytest.raises(AlreadyExists):
        catalog.put_segment("a", 51, [])
    catalog.delete_timeline("a", catalog.get_timeline("a").version)
    assert catalog.list_segments("a") == [] and [t["name"] for t in catalog.list_timelines()] == ["b"]


def test_segments_as_a_stream(spark, catalog, tmp_path):
    def starts():
        rows = catalog.subscribe_segments("a").select("start_offset")
        rows.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
        return sorted(r["start_offset"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    catalog.put_segment("a", 1, ["u1"])
    catalog.put_segment("b", 7, ["u1"])
    assert starts() == [1]
    catalog.put_segment("a", 21, ["u2"])
    assert starts() == [1, 21]


def test_timeline_log(spark, catalog, tmp_path):
    root = f"file://{tmp_path}/data"
    t = Timeline(catalog, root, "t")
    rows = spark.range(100).selectExpr("id", "CAST(concat('p', id) AS BINARY) AS payload", "CAST(CAST(id % 7 AS STRING) AS BINARY) AS key")
    assert t.append(rows, ["id"]) == (1, 101)
    assert t.record(b"last", key=b"3") == 101
    assert t.append(rows.limit(0), ["id"]) == (102, 102)
    got = t.fetch(95).collect()
    assert [r["off"] for r in got] == list(range(95, 102)) and bytes(got[0]["payload"]) == b"p94" and bytes(got[-1]["payload"]) == b"last"
    assert [r["off"] for r in t.fetch("earliest", limit=3).collect()] == [1, 2, 3]
    assert t.fetch("latest").count() == 0 and t.fetch_by_key(b"3", 2).collect()[0]["off"] == 4
    with pytest.raises(InvalidArgument):
        t.rows(20, 10)
    again = Timeline(catalog, root, "t")  # a newer term goes on after the last offset
    with pytest.raises(InvalidTerm):
        t.record(b"stale")
    assert again.record(b"x") == 102
    again.truncate(50)
    assert again.rows().count() == 50 and again.record(b"y") == 51
    reader = Timeline(catalog, root, "t", readonly=True)
    assert reader.rows().count() == 51
    with pytest.raises(ReadOnly):
        reader.record(b"z")
    kept = Timeline(catalog, root, "t", TimelineOptions(compaction=True))
    assert kept.retained().count() == 7 + 1  # one for each key, and the one without
    kept.drop()
    with pytest.raises(NotFound):
        Timeline(catalog, root, "t", readonly=True)


def test_takeover_between_manifest_and_commit(spark, catalog, tmp_path):
    """The old writer's manifest is there when a new term begins: its rows are nobody's, and the new writer goes on."""
    root = f"file://{tmp_path}/data"
    old = Timeline(catalog, root, "t")
    assert old.record(b"first") == 1
    put, taken = catalog.store.put, []

    def between(kind, *args):
        done = put(kind, *args)
        if kind == "manifests" and not taken:
            taken.append(Timeline(catalog, root, "t"))
        return done

    catalog.store.put = between
    with pytest.raises(InvalidTerm):
        old.record(b"stale")
    catalog.store.put = put
    payloads = lambda: [bytes(r["payload"]) for r in Timeline(catalog, root, "t", readonly=True).fetch().collect()]
    assert payloads() == [b"first"]
    assert taken[0].record(b"second") == 2 and payloads() == [b"first", b"second"]
    # A manifest that its writer left behind when it died does not count either, now or after later appends.
    put("manifests", f"t/{3:019d}-{taken[0].term}-dead", {"start": 3, "end": 9, "term": taken[0].term, "path": f"{root}/nowhere"}, None)
    assert payloads() == [b"first", b"second"]
    assert Timeline(catalog, root, "t").record(b"third") == 3 and payloads() == [b"first", b"second", b"third"]


def test_truncation_within_an_append(spark, catalog, tmp_path):
    t = Timeline(catalog, f"file://{tmp_path}/data", "t")
    t.append(spark.range(10).selectExpr("id", "CAST(CAST(id AS STRING) AS BINARY) AS payload"), ["id"])
    t.truncate(4)
    assert t.append(spark.range(3).selectExpr("id", "CAST('n' AS BINARY) AS payload"), ["id"]) == (5, 8)
    assert [(r["off"], r["term"]) for r in t.fetch().collect()] == [(o, 1) for o in (1, 2, 3, 4)] + [(o, 2) for o in (5, 6, 7)]
    t.truncate(0)
    assert t.rows().count() == 0 and t.record(b"x") == 1


def test_numbers_of_equal_rows(spark, catalog, tmp_path):
    t = Timeline(catalog, f"file://{tmp_path}/data", "t")
    assert t.append(spark.range(1000).selectExpr("1 AS a", "CAST(CAST(id % 3 AS STRING) AS BINARY) AS payload"), ["a"]) == (1, 1001)
    assert [r["off"] for r in t.fetch().collect()] == list(range(1, 1001))


def test_abandoned_lock(spark, catalog, tmp_path):
    store = catalog.store
    store.put("x", "k", {"n": 1}, None)
    lock = store._path("locks", quote(store._path("x", "k", f"{2:012d}.json").toString(), safe=""))
    store._write(lock, "somebody", False)
    with pytest.raises(VersionConflict):
        store.put("x", "k", {"n": 2}, 1)
    store.fs.setTimes(lock, now_ms() - 10 * STALE_MS, -1)
    assert store.put("x", "k", {"n": 2}, 1).version == 2 and store.latest("x", "k").value == {"n": 2}


def test_recorder(catalog, tmp_path):
    t = Timeline(catalog, f"file://{tmp_path}/data", "t")
    r = Recorder(t, linger=0.2)
    offsets = [f.result(60) for f in [r.record(b"%d" % i) for i in range(300)]]
    assert offsets == list(range(1, 301)) and len(t._manifests()) <= 4
    r.close()
    with pytest.raises(Cancelled):
        r.record(b"late")
    slow = Recorder(t, linger=30)
    waiting = slow.record(b"soon")
    slow.close()  # does not wait for more
    assert waiting.result(60) == 301
    for bad in ([], [None], [(None, None, None)]):
        with pytest.raises(InvalidArgument):
            t.record_batch(bad)
    with pytest.raises(InvalidTerm):
        t.record_batch([(b"x", None, None)], term=t.term - 1)
    assert t.rows().count() == 301


def test_recorder_that_is_not_drained(catalog, tmp_path):
    t = Timeline(catalog, f"file://{tmp_path}/data", "t")
    gate, append = threading.Event(), t.record_batch
    t.record_batch = lambda events, term=None: gate.wait(60) and append(events, term)
    r = Recorder(t, max_batch=1, linger=0)
    first, second = r.record(b"a"), r.record(b"b")
    time.sleep(0.2)
    closer = threading.Thread(target=r.close, args=(False,))
    closer.start()
    with pytest.raises(Cancelled):
        second.result(60)
    gate.set()
    closer.join()
    assert first.result(60) == 1 and t.rows().count() == 1


def test_cursor(spark, catalog, tmp_path):
    t = Timeline(catalog, f"file://{tmp_path}/data", "t")
    t.append(spark.range(20).selectExpr("id", "CAST('x' AS BINARY) AS payload"), ["id"])
    c = Cursor(t, 4, limit=5, piece=3)
    assert [e["off"] for e in c] == [4, 5, 6, 7, 8] and c.position == 9
    began = time.monotonic()
    assert [e["off"] for e in Cursor(t, 18, timeout=0.5, poll=0.1)] == [18, 19, 20] and time.monotonic() - began >= 0.5
    rows, failures = t.rows, iter([True, True, False, False, False])
    t.rows = lambda *a: 1 / 0 if next(failures) else rows(*a)
    assert [e["off"] for e in Cursor(t, 19, poll=0.01)] == [19, 20]
    t.rows = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        list(Cursor(t, 1, poll=0.01))


def test_event_log_source(spark, catalog, tmp_path):
    from tidelog.sources import EventLogSource

    t = Timeline(catalog, f"file://{tmp_path}/data", "s")
    t.append(spark.range(50).selectExpr("id", "CAST('x' AS BINARY) AS payload"), ["id"])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventLogSource)
    rows = spark.read.format("eventlog").option("path", f"{tmp_path}/data/log/{t.timeline_id}/" + t._manifests()[0]["path"].rpartition("/")[2]).load()
    assert rows.count() == 50 and rows.where("off >= 10 AND off < 13").count() == 3


def test_committed_events_as_a_batch_and_as_a_stream(spark, catalog, tmp_path):
    from tidelog.sources import EventLogSource

    t = Timeline(catalog, f"file://{tmp_path}/data", "s")
    batch = lambda n: [(b"%d" % n, None, None)] * 5
    t.record_batch(batch(1))
    spark.dataSource.register(EventLogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"catalog": catalog.store.root, "timeline": "s"}
    seen = lambda: sorted((r["off"], bytes(r["payload"])) for r in spark.read.format("eventlog").options(**options).load().collect())
    assert seen() == [(o, b"1") for o in range(1, 6)]

    def streamed():
        rows = spark.readStream.format("eventlog").options(**options).load().select("off", "payload")
        rows.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
        return sorted((r["off"], bytes(r["payload"])) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert streamed() == seen()
    again = Timeline(catalog, f"file://{tmp_path}/data", "s")
    catalog.store.put("manifests", f"s/{6:019d}-{t.term}-dead", {"start": 6, "end": 11, "term": t.term, "path": t._manifests()[0]["path"]}, None)
    again.record_batch(batch(2))
    assert seen() == [(o, b"1" if o < 6 else b"2") for o in range(1, 11)] == streamed()
    again.truncate(3)
    again.record_batch(batch(3))
    assert seen() == [(o, b"1" if o < 4 else b"3") for o in range(1, 9)]
    assert spark.read.format("eventlog").options(catalog=catalog.store.root, timeline="none").load().count() == 0
    again.close()
    with pytest.raises(ReadOnly):
        again.record(b"late")


def test_ensemble_of_a_new_timeline(catalog, tmp_path):
    for i in range(3):
        catalog.register_unit(f"u{i}", zone=f"z{i}")
    catalog.register_unit("u2", zone="z2", status="READONLY")
    assert [u["address"] for u in catalog.list_units(writable=True)] == ["u0", "u1"]
    Timeline(catalog, f"file://{tmp_path}/d", "t", TimelineOptions(replication_factor=2))
    assert sorted(catalog.last_segment("t")["ensemble"]) == ["u0", "u1"]
    catalog.unregister_unit("u0", "z0")
    assert [u["address"] for u in catalog.list_units()] == ["u1", "u2"]


def test_dataset_client(spark, catalog, tmp_path):
    catalog.create_dataset(Dataset("d", SCHEMA))
    d = DatasetClient(catalog, f"file://{tmp_path}/data", "d")
    assert d.read_all().count() == 0 and d.next_offset == 0
    rows = spark.range(30).selectExpr("id", "CAST(id % 3 AS STRING) AS kind")
    assert d.write(rows) == (0, 30) and d.write(rows.selectExpr("id + 30 AS id", "kind")) == (30, 60)
    assert [r["_offset"] for r in d.rows().orderBy("_offset").collect()] == list(range(60))
    assert d.rows(1).count() == 30
    request = ScanRequest("d", ("id",), (ScanFilter("kind", "eq", b"1"), ScanFilter("id", "gt_eq", b"10")), 3, order=("id",))
    assert [r["id"] for r in d.scan(request).collect()] == [10, 13, 16]
    for bad in (ScanRequest("x"), ScanRequest("d", ("no",)), ScanRequest("d", (), (ScanFilter("id", "like", b"1"),))):
        with pytest.raises(ScanError):
            d.scan(bad)
    with pytest.raises(CatalogError):
        d.write(spark.range(1).selectExpr("'x' AS kind"))
    with pytest.raises(CatalogError):
        d.write(spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS id"))


def test_interleaved_writers(spark, catalog, tmp_path):
    """B commits while A is numbering, and while a compaction runs: nothing is lost, and no offset is given twice."""
    catalog.create_dataset(Dataset("d", SCHEMA, Policies(indexes=("kind",))))
    a, b = (DatasetClient(catalog, f"file://{tmp_path}/data", "d") for _ in range(2))
    rows = lambda n, kind: spark.range(n).selectExpr("id", f"'{kind}' AS kind")
    part, done = a._part, []

    def between(path):
        if not done:
            done.append(b.write(rows(10, "b")))
        return part(path)

    a._part = between
    assert a.write(rows(5, "a")) == (10, 15) and done == [(0, 10)]
    assert [(r["_offset"], r["kind"]) for r in a.rows().orderBy("_offset").collect()] == [(o, "b" if o < 10 else "a") for o in range(15)]
    done.clear()
    assert a.run_action(catalog.submit_action("compact", "d", {})["id"])["status"] == "succeeded"
    assert done == [(15, 25)] and a.rows().count() == 25 and a.next_offset == 25
    done.clear()
    assert a.run_action(catalog.submit_action("offload", "d", {"to": f"file://{tmp_path}/cold"})["id"])["status"] == "succeeded"
    assert a.rows().count() == 35 and sorted(r["_offset"] for r in a.rows().collect()) == list(range(35))
    with pytest.raises(VersionConflict):
        a._commit(a._snapshot(1), [], 0)
    assert a.index_names == ["kind"]
    one = a.scan(ScanRequest("d", ("id",), (ScanFilter("kind", "eq", b"b"),)))
    assert one.count() == 30 and len(a._holding(a._snapshot()["parts"], (ScanFilter("kind", "eq", b"zz"),))) == 0


def test_actions(spark, catalog, tmp_path):
    catalog.create_dataset(Dataset("d", SCHEMA))
    d = DatasetClient(catalog, f"file://{tmp_path}/data", "d")
    d.write(spark.range(30).selectExpr("id", "CAST(id % 3 AS STRING) AS kind"))
    run = lambda kind, **p: d.run_action(catalog.submit_action(kind, "d", p)["id"])
    assert run("refresh", by="kind")["status"] == "succeeded"
    d.write(spark.range(5).selectExpr("id + 100 AS id", "'2' AS kind"))
    assert {r["kind"]: r["n"] for r in spark.read.parquet(run("refresh", by="kind")["message"]).collect()} == {"0": 10, "1": 10, "2": 15}
    assert run("optimize", by="id")["status"] == "succeeded" and d.rows().count() == 35
    assert run("compact", key="kind")["status"] == "succeeded" and d.rows().count() == 3
    assert run("unload", to=f"{tmp_path}/out", format="json")["status"] == "succeeded" and spark.read.json(f"{tmp_path}/out").count() == 3
    assert run("offload", to=f"file://{tmp_path}/cold")["status"] == "succeeded" and d.rows().count() == 3
    assert run("vacuum", keep="0")["message"].endswith("folders") and d.rows().count() == 3
    assert run("unload")["status"] == "failed"
    assert len(catalog.list_actions("d")) == 8 and catalog.list_actions("x") == []
    with pytest.raises(CatalogError):
        catalog.submit_action("fly", "d")


def test_shell(spark, capsys, tmp_path):
    from tidelog import shell

    assert list(shell.lines(spark.sql("SELECT 1.0D AS a, CAST(NULL AS INT) AS b, 'x' AS c"))) == ["1\tNULL\tx"]
    config = tmp_path / "c.toml"
    config.write_text("backend = 1")
    with pytest.raises(InvalidOptions):
        shell.load_options(str(config))
