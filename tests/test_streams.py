"""Streams give what their batch twins give, over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from replicalog.operators import events
from replicalog.streaming import streams

from .test_core import CATALOG, EVENT, event, row


def drained(stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


@pytest.fixture
def log(spark, tmp_path):
    draw = random.Random(5)
    rows = [event(i, i * 60 + draw.randint(0, 50), path=f"p{draw.randint(0, 3)}", category=draw.choice(["error", "peer"]), reason=draw.choice(["peer offline: a", "b"])) for i in range(80)]
    d = spark.createDataFrame(rows, EVENT)
    d.where("id < 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    d.where("id >= 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return d, f"{tmp_path}/log"


def test_alert_throttle(spark, log, tmp_path):
    d, path = log
    stream = streams.throttle_alerts_stream(spark.readStream.schema(EVENT).parquet(path), 900)
    got = drained(stream, "append", tmp_path, "alerts")
    assert {r.id for r in got.collect()} == {r.id for r in events.throttle_alerts(d, 900).collect()}


def test_problem_throttle(spark, log, tmp_path):
    d, path = log
    cleared = lambda x: x.withColumn("reason", F.when(F.col("id") % 5 != 0, F.col("reason")))
    got = drained(streams.throttle_problems_stream(cleared(spark.readStream.schema(EVENT).parquet(path))), "append", tmp_path, "problems")
    want = events.throttle_by_reason(cleared(d))
    assert {(r.id, r.is_resolve) for r in got.collect()} == {(r.id, r.is_resolve) for r in want.collect()}


def test_peer_states(spark, log, tmp_path):
    d, path = log
    attempts = lambda x: x.select(F.col("path").alias("peer"), "id", F.col("ts_s").alias("ts"), (F.col("id") % 4 == 0).alias("ok"), F.when(F.col("id") % 4 != 0, F.col("reason")).alias("error"))
    got = drained(streams.peer_state_stream(attempts(spark.readStream.schema(EVENT).parquet(path))), "append", tmp_path, "states")
    backoff = {r.id: (r.failures, r.wait_s) for r in events.peer_backoff(attempts(d)).collect()}
    changes = {r.id: r.change for r in events.peer_transitions(attempts(d)).collect()}
    rows = {r.id: r for r in got.collect()}
    assert {i: (r.failures, r.wait_s) for i, r in rows.items()} == backoff
    assert {i: r.change for i, r in rows.items() if r.change} == changes


def test_debounce_and_feed(spark, tmp_path):
    rows = [("f", f"p{i % 3}" if i % 7 else ".sfx-tmp/x", 1_000_000 * 100 + i * 50_000) for i in range(40)]
    d = spark.createDataFrame(rows, "folder string, path string, us long").select("folder", "path", F.timestamp_micros("us").alias("ts"))
    d.coalesce(1).write.parquet(f"{tmp_path}/changes")
    got = drained(streams.debounce(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/changes")), "complete", tmp_path, "batches").collect()
    want = {}
    for f, p, us in rows:
        if not p.startswith(".sfx"):
            want.setdefault(us // 250_000, set()).add(p)
    assert sorted(r.paths for r in got) == sorted(sorted(v) for v in want.values())
    log = spark.createDataFrame([event(1, 1), event(2, 2, severity=0)], EVENT)
    log.write.parquet(f"{tmp_path}/log")
    feed = drained(streams.event_feed(spark, f"{tmp_path}/log", EVENT, events.Filter(min_severity=1)), "append", tmp_path, "feed")
    assert [r.id for r in feed.collect()] == [1]


def test_catalog_upkeep(spark, tmp_path):
    table = streams.Versions(spark, f"{tmp_path}/catalog")
    put = streams.maintain_catalog(table, CATALOG)
    batch = lambda rows, update: spark.createDataFrame(rows, CATALOG).withColumn("is_update", F.lit(update))
    put(batch([row("2", "a", {"2": 1}), row("2", "b", {"2": 1})], False), 0)
    put(batch([row("2", "b", {"2": 2}), row("2", "c", {"2": 1})], True), 1)
    put(batch([row("2", "b", {"2": 2}), row("2", "c", {"2": 1})], True), 1)
    assert {r.name: r.version["2"] for r in table.latest(CATALOG).collect()} == {"a": 1, "b": 2, "c": 1}
    put(batch([row("2", "z", {"2": 3})], False), 2)
    assert [r.name for r in table.latest(CATALOG).collect()] == ["z"]
    out = []
    run = streams.scan_diff_stream(table, CATALOG, "2", lambda d, n: out.extend(r.kind for r in d.collect()))
    run(spark.createDataFrame([("f", "new", 0, 1, 1, 0, 0)], "folder string, name string, type int, size long, modified_s long, modified_ns int, mode int"), 0)
    assert sorted(out) == ["added", "deleted"]
    counts = []
    streams.open_conditions_stream(lambda d, n: counts.extend((r.folder, r.open_conditions) for r in d.collect()), lambda: spark.createDataFrame([event(1, 1)], EVENT))(spark.createDataFrame([event(1, 1)], EVENT), 0)
    assert counts == [("f", 1)]
