"""Roll-ups, set operators, companions and progress on small rows."""

import hashlib

from pyspark.sql import functions as F

from replicalog.operators import events, guards, reconcile, resolve, retention, status
from replicalog.plans import sync
from replicalog.sources import listing
from replicalog.streaming import streams
from replicalog.streaming.progress import ScanProgress, observed, scan_runs

from .test_core import CATALOG, EVENT, event, row, table  # noqa: F401


def rows(d):
    return sorted((tuple(r) for r in d.collect()), key=str)


def test_scan_progress_grows_while_it_runs(spark, tmp_path):
    kinds = spark.range(90).selectExpr("CAST(id % 3 = 0 AS int) type", "CASE WHEN id % 2 = 0 THEN 'added' WHEN id % 5 = 0 THEN 'deleted' END kind")
    for k in range(3):
        kinds.limit(30 * (k + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener, seen = ScanProgress(), []
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(kinds.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = observed(source, "f").writeStream.foreachBatch(lambda d, n: (d.count(), seen.append(listener.rows()))[0:0]).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    (got,) = [r for r in scan_runs(spark, listener, spark.createDataFrame([("f",)], "folder string")).collect()]
    assert got.walked == 180 and got.changed == sum(1 for n in (30, 60, 90) for i in range(n) if i % 2 == 0 or i % 5 == 0) and got.hash_total == sum(1 for n in (30, 60, 90) for i in range(n) if i % 2 == 0 and i % 3)
    assert got.finished >= got.started and got.error is None
    never = scan_runs(spark, listener, spark.createDataFrame([("f",), ("never",)], "folder string"))
    assert {(r.folder, r.walked) for r in never.collect()} == {("f", 180), ("never", None)}
    assert any(r and 0 < r[0][3] < 180 for r in seen)


def test_rebuild_gives_new_numbers_an_id_and_a_warning(spark, tmp_path):
    (tmp_path / "r/d").mkdir(parents=True)
    (tmp_path / "r/d/x").write_bytes(b"abc")
    old = spark.createDataFrame([row("1", "d/x", {"1": 7, "2": 3}, seq=99)], CATALOG)
    a, b = (sync.rebuild_folder(spark, str(tmp_path / "r"), "f", old, None, "1", 50) for _ in range(2))
    assert {(r.name, r.version["1"], r.sequence, tuple(r.blocks)) for r in a.catalog.collect()} == {("d", 1, 1, ()), ("d/x", 1, 2, (hashlib.sha256(b"abc").hexdigest(),))}
    assert a.index_id != b.index_id and len(a.index_id) == 32
    assert [(r.folder, r.category, r.severity, r.ts_s) for r in a.events.collect()] == [("f", "system", 1, 50)]
    assert [(r.folder, r.reason, r.severity) for r in resolve.system_events(spark, "node started", 0, 9).collect()] == [("", "node started", 0)]


def test_peers_and_sharing(spark):
    folders = spark.createDataFrame([("all", []), ("some", ["2"]), ("both", ["2", "3"]), ("lonely", ["3"])], "id string, peers array<string>")
    peers = spark.createDataFrame([("2", "a"), ("3", "b")], "peer string, name string")
    advertised = spark.createDataFrame([("2", "all"), ("2", "some"), ("3", "all")], "peer string, folder string")
    assert {r[0] for r in rows(status.peers_all(folders, peers)) if r[1]} == {"all", "both"}
    got = {r.id: (r.known, r.shared, r.not_shared) for r in status.sharing_status(folders, peers, advertised).collect()}
    assert got == {"all": (2, 2, False), "some": (1, 1, False), "both": (2, 0, True), "lonely": (1, 0, True)}
    assert {r.id for r in reconcile.advertised_folders(folders, "3").collect()} == {"all", "both", "lonely"}
    assert {r.id for r in reconcile.shared_folders(folders, advertised, "2").collect()} == {"all", "some"}
    tries = spark.createDataFrame([("2", 100, True, 1), ("2", 500, True, 0), ("3", 10, False, 0)], "peer string, ts long, ok boolean, folders_synced int")
    assert {(r.peer, r.connected, r.last_sync) for r in status.peer_status(tries, peers, 600).collect()} == {("2", True, 100), ("3", False, None)}
    assert {(r.peer, r.connected) for r in status.peer_status(tries, peers, 620).collect()} == {("2", False), ("3", False)}


def test_runs_and_transfers(spark):
    t = spark.createDataFrame([("f", "s1", 5, 7, 1, 10), ("f", "s2", 1, 0, 0, 30), ("g", "s1", 0, 2, 1, 20)], "folder string, session string, up long, down long, files long, finished long")
    assert rows(status.transfer_stats(t)) == [("f", 6, 7, 1, 2, 30), ("g", 0, 2, 1, 1, 20)]
    runs = spark.createDataFrame([("f", 10, 20, "bad"), ("f", 30, 40, None)], "folder string, started long, finished long, error string")
    assert rows(status.last_run(runs, spark.createDataFrame([("f",), ("g",)], "folder string"), "folder")) == [("f", 30, 40, None), ("g", None, None, None)]
    one = spark.createDataFrame([("f", 3, 1, 10), ("g", 4, 0, 20)], "folder string, live_files long, conflicts long, last_sync long")
    assert status.node_status(one).first().asDict() == {"folders": 2, "live_files": 7, "conflicts": 1, "last_sync": 20}


def test_guards_and_conditions(spark, table):
    c = table(*[row("1", f"n{i}", {"1": 1}) for i in range(10)], *[row("2", f"n{i}", {"1": 1, "2": 1}) for i in range(6)], *[row("2", f"n{i}", {"1": 1}) for i in range(6, 10)])
    markers = spark.createDataFrame([("f", "2", "i", 3)], "folder string, peer string, index_id string, max_seq long")
    assert guards.mass_change(c, markers, "1", "2").where("alarm").count() == 1
    assert guards.mass_change(c, markers.where("peer = '9'"), "1", "2").where("alarm").count() == 0
    was = spark.createDataFrame([("f", "a"), ("f", "b")], "folder string, key string")
    assert [r.key for r in guards.clear_conditions(was, was.where("key = 'a'"), ["folder", "key"]).collect()] == ["b"]


def test_conflicts_side_by_side(spark, table):
    copy = "a.sync-conflict-20260818-080000-1.txt"
    c = table(row("1", "a.txt", {"1": 3, "2": 1}), row("1", copy, {"2": 5}))
    data = spark.createDataFrame([("f", "a.txt", b"one"), ("f", copy, b"\x00two")], "folder string, name string, content binary")
    names = spark.createDataFrame([("1", "attic"), ("2", "nas")], "device string, name string")
    got = status.compare_conflicts(c, data, "1", names).first()
    assert got.name == "a.txt" and not got.identical and got.file.sha256 == hashlib.sha256(b"one").hexdigest() and got.file.preview == "one" and got.copy.preview.startswith("[binary] 00")
    assert got.copy.produced_by == "nas" and "attic" in got.file.produced_by
    same = spark.createDataFrame([("f", "a.txt", b"x"), ("f", copy, b"x")], "folder string, name string, content binary")
    assert status.compare_conflicts(c, same, "1").first().identical


def test_archives_and_logs(spark, tmp_path):
    (tmp_path / "v/p.txt/2023-11-14").mkdir(parents=True)
    (tmp_path / "v/p.txt/2023-11-14/17").write_bytes(b"abc")
    got = listing.read_archive(spark, str(tmp_path / "v"), "f", "staggered")
    assert [(r.path, r.size, r.archive_path) for r in retention.list_versions(got).collect()] == [("p.txt", 3, "p.txt/2023-11-14/17")]
    left, freed = retention.clean_archive(got)
    assert left.count() == 0 and rows(freed) == [("f", 1, 3)]
    log = spark.createDataFrame([event(1, 10), event(2, 10, severity=0), event(3, 95 * 86400, severity=0)], EVENT)
    assert {r.id for r in events.auto_archive(log, 0, 100 * 86400).collect()} == {1, 3}
    store = streams.Versions(spark, f"{tmp_path}/log")
    run = streams.retention_stream(store, EVENT, 1, lambda: 100 * 86400)
    run(log, 0)
    run(log.limit(0), 1)
    assert {r.id for r in store.latest(EVENT).collect()} == {1}
    events.append_events(log.withColumn("ts", F.timestamp_seconds("ts_s")), f"{tmp_path}/events")
    assert {r.id for r in events.read_events(spark, f"{tmp_path}/events").collect()} == {1, 2, 3}
