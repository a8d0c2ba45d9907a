"""Snapshots of listings as a source: none lost, none twice, over restarts."""

from replicalog.operators import diff
from replicalog.sources import snapshots as snap
from replicalog.sources.walk import walk


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    root, store, out = tmp_path / "root", f"file://{tmp_path}/store", f"{tmp_path}/out"
    (root / "a b").mkdir(parents=True)

    def take(number, *files):
        for f in files:
            (root / f).write_bytes(b"1")
        return snap.write_snapshot(spark, [walk(spark, str(root), "f"), walk(spark, str(root / "a b"), "g")], store, number)

    def drain():
        q = snap.snapshots(spark, store, stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").start()
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None

    assert take(0, "x")
    drain()
    assert take(1, "a b/y") and not take(1, "never") and take(2, "z")
    drain()
    drain()
    got = sorted((r.snapshot, r.folder, r.name) for r in spark.read.parquet(out).collect())
    base = [("f", "a b"), ("f", "x")]
    want = [(0, *r) for r in base] + [(1, *r) for r in [*base, ("f", "a b/y"), ("g", "y")]] + [(2, *r) for r in [*base, ("f", "a b/y"), ("f", "never"), ("f", "z"), ("g", "y")]]
    assert got == sorted(want)
    assert sorted((r.snapshot, r.folder, r.name) for r in snap.snapshots(spark, store).collect()) == sorted(want)
    one = snap.snapshots(spark, store).where("folder = 'g' AND snapshot = 2")
    assert [r.name for r in one.collect()] == ["y"] and one.rdd.getNumPartitions() == 1
    # A snapshot goes through the diff as any listing does.
    nothing = spark.createDataFrame([], "folder string, name string, type int, size long, modified_s long, modified_ns int, deleted boolean")
    changes = diff.scan_diff(snap.snapshots(spark, store).where("snapshot = 1").drop("incomplete", "snapshot"), nothing)
    assert {(r.folder, r.name, r.kind) for r in changes.collect()} == {(f, n, "added") for _, f, n in want if _ == 1}


def test_incomplete_folders_are_told(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root/x").write_bytes(b"1")
    with open(str(tmp_path / "root").encode() + b"/bad\xff", "wb") as f:
        f.write(b"1")
    assert snap.write_snapshot(spark, [walk(spark, str(tmp_path / "root"), "f")], str(tmp_path / "s"), 5)
    assert [(r.name, r.incomplete, r.snapshot) for r in snap.snapshots(spark, str(tmp_path / "s")).collect()] == [("x", True, 5)]
