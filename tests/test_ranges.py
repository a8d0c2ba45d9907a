"""The table in key ranges: what a batch touches, what a reader opens."""

import random

import pytest
from pyspark.sql import functions as F

from replicalog.sources.ranges import RangeTable
from replicalog.streaming import streams

from .test_core import CATALOG, row

SMALL = "folder string, replica string, name string, sequence long, size long"


def contents(table, batch=None):
    return {(r.folder, r.replica, r.name): (r.sequence, r.size) for r in table.read(batch).collect()}


def files(table):
    return {r.low: (r.base, tuple(d.path for d in r.deltas)) for r in table.ranges()}


def scanned(df):
    """Rows that the files of a plan gave, and files opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, rows, opened = plan.collectLeaves(), 0, 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "BroadcastQueryStageExec" or leaf.getClass().getSimpleName() == "ShuffleQueryStageExec":
            leaf = leaf.plan().collectLeaves().apply(0)
        m = leaf.metrics()
        if m.contains("numFiles"):
            rows += m.apply("numOutputRows").value()
            opened += m.apply("numFiles").value()
    return rows, opened


def test_against_a_dictionary(spark, tmp_path):
    rng, want, history = random.Random(8), {}, {}
    table = RangeTable(spark, f"file://{tmp_path}/t", SMALL, range_rows=60)
    pairs = [("f", "1"), ("f", "2"), ("g", "1")]
    for n in range(7):
        names = rng.sample(range(150), 12 if n else 110)
        rows = {(*rng.choice(pairs), f"d{i % 7}/n{i}"): (1000 * n + k, rng.randint(0, 9)) for k, i in enumerate(names)}
        full = [("f", "2")] if n in (3, 5) else []
        want = {k: v for k, v in want.items() if k[:2] not in full} | rows
        df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], SMALL)
        replaced = spark.createDataFrame(full, "folder string, replica string") if full else None
        table.upsert(df, n, replaced)
        history[n] = dict(want)
        assert contents(table) == want
        before = files(table)
        table.upsert(df, n, replaced)
        assert files(table) == before
    assert contents(table, 4) == history[3]
    some = rng.choice(sorted(want))
    assert [tuple(r)[3:] for r in table.get(*some).collect()] == [want[some]] and table.get("f", "1", "none").count() == 0
    for value in (0, 3000, 5500, 6005, 9999):
        assert {(r.folder, r.replica, r.name) for r in table.after(value).collect()} == {k for k, (s, _) in want.items() if s > value}
    ranges = table.ranges()
    assert len(ranges) > 1 and [r.low for r in ranges] == sorted(r.low for r in ranges)
    table.vacuum(1)
    assert contents(table) == want and table.batches() == [6]
    with pytest.raises(ValueError, match="comes after"):
        table.upsert(df, 2)


def test_untouched_ranges_keep_their_files(spark, tmp_path):
    table = RangeTable(spark, str(tmp_path / "t"), SMALL, range_rows=100)
    table.upsert(spark.range(1000).selectExpr("'f' folder", "'1' replica", "format_string('n%04d', id) name", "id sequence", "id size"), 0)
    first = files(table)
    assert len(first) >= 8
    # A few rows become a delta of one range.
    table.upsert(spark.createDataFrame([("f", "1", "n0500", 2000, 7), ("f", "1", "n0500x", 2001, 7)], SMALL), 1)
    second = files(table)
    changed = [k for k in first if first[k] != second[k]]
    assert len(changed) == 1 and second[changed[0]][0] == first[changed[0]][0] and len(second[changed[0]][1]) == 1
    # Many rows have the range rewritten, and no other.
    table.upsert(spark.range(60).selectExpr("'f' folder", "'1' replica", "format_string('n0500-%03d', id) name", "id + 3000 sequence", "1L size"), 2)
    third = files(table)
    gone = set(second) - set(third) | {k for k in second if k in third and second[k] != third[k]}
    assert gone == set(changed) and len(third) >= len(second)
    assert table.read().count() == 1061 and table.get("f", "1", "n0500").first().size == 7


def test_a_batch_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    table = RangeTable(spark, str(tmp_path / "t"), SMALL, range_rows=100)
    table.upsert(spark.createDataFrame([("f", "1", "a", 1, 1)], SMALL), 0)
    with monkeypatch.context() as m:
        m.setattr(RangeTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.upsert(spark.createDataFrame([("f", "1", "a", 2, 2)], SMALL), 1)
    assert contents(table) == {("f", "1", "a"): (1, 1)}
    table.upsert(spark.createDataFrame([("f", "1", "a", 3, 3)], SMALL), 1)
    assert contents(table) == {("f", "1", "a"): (3, 3)}


def test_odd_keys_and_empty_batches(spark, tmp_path):
    table = RangeTable(spark, str(tmp_path / "t"), SMALL, range_rows=2)
    rows = [(None, "1", "a", 1, 1), ("f", None, None, 2, 1), ("f", "1", "é/ü", 3, 1), ("f", "1", "a=b/%41", 4, 1), ("f", "1", "", 5, 1)]
    table.upsert(spark.createDataFrame([], SMALL), 0)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame(rows, SMALL), 1)
    table.upsert(spark.createDataFrame([(None, "1", "a", 6, 2), ("f", None, None, 7, 2)], SMALL), 2)
    assert contents(table)[None, "1", "a"] == (6, 2) and contents(table)["f", None, None] == (7, 2) and table.read().count() == 5
    assert table.get("f", "1", "é/ü").count() == 1 and table.get("f", "1", "").count() == 1


def test_look_ups_among_a_million_open_little(spark, tmp_path):
    table = RangeTable(spark, str(tmp_path / "t"), SMALL, range_rows=100_000)
    table.upsert(spark.range(1_000_000).selectExpr("concat('f', id % 4) folder", "'1' replica", "sha2(string(id), 256) name", "id sequence", "id size"), 0)
    table.upsert(spark.createDataFrame([("f1", "1", f"new{i}", 2_000_000 + i, 0) for i in range(100)], SMALL), 1)
    name = spark.range(1).selectExpr("sha2('77777', 256) name").first()[0]
    found = table.get("f1", "1", name)
    assert [r.size for r in found.collect()] == [77777]
    rows, opened = scanned(found)
    assert opened <= 3 and rows <= 110_000
    # A name that is nowhere: the Bloom filters leave nothing to read.
    assert scanned(table.get("f3", "1", name[::-1]))[0] == 0
    late = table.after(1_999_999)
    rows, opened = scanned(late)
    assert late.count() == 100 and rows <= 200 and opened <= 2
    assert table.after(999_990).count() == 109


def test_stream_of_messages(spark, tmp_path):
    table = RangeTable(spark, str(tmp_path / "t"), CATALOG, range_rows=3)
    put = streams.upsert_catalog(table)
    batch = lambda rows, update: spark.createDataFrame(rows, CATALOG).withColumn("is_update", F.lit(update))
    put(batch([row("2", "a", {"2": 1}), row("2", "b", {"2": 1}), row("3", "b", {"3": 1})], False), 0)
    put(batch([row("2", "b", {"2": 2}), row("2", "c", {"2": 1})], True), 1)
    put(batch([row("2", "b", {"2": 2}), row("2", "c", {"2": 1})], True), 1)
    assert {(r.replica, r.name): r.version[r.replica] for r in table.read().collect()} == {("2", "a"): 1, ("2", "b"): 2, ("2", "c"): 1, ("3", "b"): 1}
    put(batch([row("2", "z", {"2": 3})], False), 2)
    assert {(r.replica, r.name) for r in table.read().collect()} == {("2", "z"), ("3", "b")}
