"""Walks that prune and survive, and reads of what changed alone."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from replicalog.functions import rules
from replicalog.operators import diff
from replicalog.plans import sync
from replicalog.sources import changed, listing, walk

from .test_core import CATALOG


@pytest.fixture
def compiled(spark):
    def make(*lines):
        return rules.compile_rules(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "folder string, ord int, line string"))

    return make


def names(found):
    return {r.name for r in found.entries.collect()}


def test_a_walk_prunes_and_survives(spark, tmp_path, monkeypatch, compiled):
    root, log = tmp_path / "root", tmp_path / "entered"
    for d in ("kept/deep", "forbidden/x", "cache/a/b", "kept/.sfx-tmp/y"):
        (root / d).mkdir(parents=True)
        (root / d / "file.txt").write_bytes(b"abc")
    for i in range(6):
        (root / f"kept/n{i}").write_bytes(b"1")
    (root / "kept/vanishing").write_bytes(b"1")
    (root / "kept/skip.tmp").write_bytes(b"1")
    plain_names, plain_asked = walk.names_in, walk.asked
    failed, said = walk._failed, str(log)

    def names_in(at, top):
        with open(said, "a") as f:
            f.write(at + "\n")
        if at.endswith("/forbidden"):
            yield failed(at, PermissionError(13, "Permission denied"))
        else:
            yield from plain_names(at, top)

    def asked(row):
        if row[0].endswith("/vanishing") and os.path.exists(row[0]):
            os.remove(row[0])
        return plain_asked(row)

    monkeypatch.setattr(walk, "names_in", names_in)
    monkeypatch.setattr(walk, "asked", asked)
    found = walk.walk(spark, str(root), "f", compiled("cache/", "*.tmp"))
    got = {r.name: (r.type, r.ignored, r.rule) for r in found.entries.collect()}
    assert got == {
        "kept": (1, False, None), "forbidden": (1, False, None), "cache": (1, True, "cache/"), "kept/deep": (1, False, None), "kept/deep/file.txt": (0, False, None),
        "kept/skip.tmp": (0, True, "*.tmp"), **{f"kept/n{i}": (0, False, None) for i in range(6)},
    }
    assert [tuple(r) for r in found.errors.collect()] == [("f", "forbidden", "PermissionError: Permission denied")]
    entered = {os.path.relpath(x, root) for x in log.read_text().split()}
    assert entered == {".", "kept", "kept/deep", "forbidden"}
    assert [r.folder for r in found.incomplete().collect()] == ["f"]
    with pytest.raises(OSError, match="incomplete: forbidden"):
        listing.read_listing(spark, str(root), "f")


def test_nothing_is_deleted_in_an_incomplete_folder(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    for d in ("a", "b"):
        (root / d).mkdir(parents=True)
        (root / d / "x").write_bytes(b"abc")
    nothing = spark.createDataFrame([], CATALOG)
    first = sync.scan_folder(spark, str(root), "f", nothing, None, "1")
    before = spark.createDataFrame(first.catalog.collect(), CATALOG)
    assert before.where("NOT deleted").count() == 4 and first.errors.count() == 0
    plain, failed = walk.names_in, walk._failed

    def names_in(at, top):
        yield from [failed(at, PermissionError(13, "no"))] if at.endswith("/a") else plain(at, top)

    (root / "b/x").unlink()
    (root / "b/new").write_bytes(b"z")
    with monkeypatch.context() as m:
        m.setattr(walk, "names_in", names_in)
        again = sync.scan_folder(spark, str(root), "f", before, None, "1")
        assert {(r.name, r.kind) for r in again.changes.collect()} == {("b/new", "added")}
        assert {(r.name, r.error) for r in again.errors.collect()} == {("a", "PermissionError: no")}
    whole = sync.scan_folder(spark, str(root), "f", before, None, "1")
    assert {(r.name, r.kind) for r in whole.changes.collect()} == {("b/new", "added"), ("b/x", "deleted")}


def test_a_root_that_is_not_there_deletes_nothing(spark, tmp_path):
    catalog = spark.createDataFrame([("f", "1", "x", 1, 1, 0, 0, 0, False, False, {"1": 1}, 1, 0, [])], CATALOG)
    got = sync.scan_folder(spark, f"{tmp_path}/unmounted", "f", catalog, None, "1")
    assert got.changes.count() == 0 and got.errors.count() == 1 and got.catalog.where("deleted").count() == 0


def test_odd_names_and_links(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "100% ü\nline").write_bytes(b"1")
    (root / "loop").symlink_to(root)
    (root / "broken").symlink_to("nowhere")
    os.mkfifo(root / "pipe")
    with open(os.fsencode(root) + b"/bad\xff", "wb") as f:
        f.write(b"1")
    found = walk.walk(spark, f"file://{root}", "f")
    assert names(found) == {"100% ü\nline", "loop", "broken", "pipe"}
    assert [r.error for r in found.errors.collect()] == ["the name is not UTF-8"]


def test_one_large_directory_is_many_tasks_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "SLICE", 100)
    root = tmp_path / "root"
    root.mkdir()
    for i in range(3000):
        (root / f"f{i}").touch()
    found = walk.walk(spark, str(root), "f")
    sizes = [r["count"] for r in found.entries.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 4 and max(sizes) < 1000


def test_reserved_entries_only_when_asked(spark, tmp_path):
    (tmp_path / "root/.sfx-tmp").mkdir(parents=True)
    (tmp_path / "root/.sfx-tmp/.sfx-0011.part").write_bytes(b"1")
    os.utime(tmp_path / "root/.sfx-tmp/.sfx-0011.part", (1000, 1000))
    assert names(walk.walk(spark, f"{tmp_path}/root", "f")) == set()
    old = listing.stale_temporaries(listing.read_listing(spark, f"{tmp_path}/root", "f", reserved=True), 5000, 3600)
    assert [r.name for r in old.collect()] == [".sfx-tmp/.sfx-0011.part"]
    assert listing.stale_temporaries(listing.read_listing(spark, f"{tmp_path}/root", "f", reserved=True), 2000, 3600).count() == 0


def made(root, sizes, seed=1):
    rng, out = random.Random(seed), {}
    for name, n in sizes.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        out[name] = rng.randbytes(n)
        (root / name).write_bytes(out[name])
    return out


STEP = 128 << 10


def hashes(data):
    return [hashlib.sha256(data[i : i + STEP]).hexdigest() for i in range(0, len(data), STEP)]


def test_bytes_read_are_the_bytes_changed(spark, tmp_path):
    """Unchanged files are not opened: they are gone by then, and a directory stands where one was."""
    root = tmp_path / "root"
    sizes = {"big.bin": 900_001, "d/small": 5, "exact": STEP, "empty": 0, "same/1": 70_000, "same/2": 10}
    data = made(root, sizes)
    nothing = spark.createDataFrame([], CATALOG)
    before = spark.createDataFrame(sync.scan_folder(spark, str(root), "f", nothing, None, "1").catalog.collect(), CATALOG)
    assert {r.name: r.blocks for r in before.where("type = 0").collect()} == {n: hashes(x) for n, x in data.items()}
    data |= made(root, {"big.bin": 777_777, "d/new 100% ü": 3, "empty": 0}, seed=2)
    os.utime(root / "empty", (5, 5))
    changes = diff.scan_diff(walk.walk(spark, str(root), "f").entries, before)
    (root / "same/1").unlink()
    (root / "same/2").unlink()
    (root / "same/2").mkdir()
    rows = changed.packed(changed.ranges(changes, str(root), 2 * STEP), 300_000, 1000)
    read = changed.read_hashes(rows)
    plan = read._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "content" not in plan
    assert sum(r.read for r in read.collect()) == 777_777 + 3
    done, errors = changed.hash_changed(changes, str(root), 300_000, 2 * STEP)
    assert errors.count() == 0
    assert {r.name: (r.kind, r.blocks) for r in done.where("now.type = 0").collect()} == {"big.bin": ("modified", hashes(data["big.bin"])), "d/new 100% ü": ("added", hashes(data["d/new 100% ü"])), "empty": ("modified", [])}


def test_tasks_are_even(spark, tmp_path):
    rng = random.Random(4)
    files = [("f", f"n{i}", rng.choice([10, 5_000, 200_000, 9_000_000])) for i in range(400)] + [("f", "huge", 80_000_000)]
    changes = spark.createDataFrame(files, "folder string, name string, size long").selectExpr("folder", "name", "'added' kind", "named_struct('type', 0, 'size', size) now").repartition(7, "name")
    rows = changed.packed(changed.ranges(changes, "/r", 8 * STEP), 20_000_000, 10_000)
    loads = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.col("length") + 10_000).alias("n")).collect()]
    total = sum(n for *_, n in files)
    assert rows.agg(F.sum("length")).first()[0] == total and len(loads) >= total // 20_000_000
    assert max(loads) < 20_000_000 + 2 * 8 * STEP and min(loads) > 20_000_000 - 4 * 8 * STEP
    assert rows.where("name = 'huge'").groupBy(F.spark_partition_id()).count().count() >= 4


def test_files_that_went_or_shrank_or_cannot_be_read(spark, tmp_path):
    root = tmp_path / "root"
    made(root, {"gone": 300_000, "shrank": 300_000, "odd": 10, "fine": 300_000})
    changes = diff.scan_diff(walk.walk(spark, str(root), "f").entries, spark.createDataFrame([], CATALOG))
    (root / "gone").unlink()
    (root / "shrank").write_bytes(b"1" * 150_000)
    (root / "odd").unlink()
    (root / "odd").mkdir()
    done, errors = changed.hash_changed(changes, str(root), 200_000, STEP)
    assert [r.name for r in done.collect()] == ["fine"]
    assert [(r.name, r.error) for r in errors.collect()] == [("odd", "IsADirectoryError: Is a directory")]
    assert changed.hash_changed(changes.limit(0), str(root))[0].count() == 0
