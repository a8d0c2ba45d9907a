"""Golden cases of the catalog, vectors, rules, plans and the event log."""

import base64
import hashlib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replicalog.functions import content, paths, rules, vectors
from replicalog.operators import blocks, catalog, diff, events, guards, reconcile, resolve, retention, status
from replicalog.plans import sync
from replicalog.sources import declarations, listing, messages
from replicalog.streaming import streams

CATALOG = (
    "folder string, replica string, name string, size long, modified_s long, modified_ns int, mode int, type int, deleted boolean, invalid boolean, "
    "version map<string, bigint>, sequence long, block_size int, blocks array<string>"
)


def row(replica, name, version, size=5, t=100, ns=0, deleted=False, h="a", kind=0, seq=1):
    return ("f", replica, name, 0 if deleted else size, 0 if deleted else t, ns, 0, kind, deleted, False, version, seq, 0, [] if deleted or not h else [h])


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), CATALOG)


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items()) or "x int"
    d = spark.createDataFrame([tuple(v for v, _ in values.values()) or (1,)], schema)
    return d.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


MAP = "map<string, bigint>"
vector = st.dictionaries(st.sampled_from(["1", "2", "100", "11535086261826064642"]), st.integers(1, 5), max_size=4)


@pytest.mark.parametrize(("a", "b", "want"), [({"1": 3}, {"1": 5}, -1), ({"1": 5}, {"1": 3}, 1), ({"1": 3}, {"1": 3}, 0), ({"1": 4}, {"2": 1}, 2), ({"1": 4, "2": 3}, {"1": 4, "2": 2}, 1), ({}, {}, 0), (None, {"1": 1}, -1)])
def test_compare(spark, a, b, want):
    assert one(spark, vectors.compare("a", "b"), a=(a, MAP), b=(b, MAP)).c0 == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(vector, vector), min_size=6, max_size=6))
def test_vector_laws(spark, pairs):
    d = spark.createDataFrame([(a, b) for a, b in pairs], f"a {MAP}, b {MAP}")
    m = vectors.merge("a", "b")
    rows = d.select("a", "b", vectors.compare("a", "b").alias("x"), vectors.compare("b", "a").alias("y"), m.alias("m"), vectors.compare(m, "a").alias("up"), vectors.canonical("a").alias("ca"), vectors.canonical("b").alias("cb"), vectors.to_json("a").alias("j"), vectors.compare(vectors.bump("a", "2"), "a").alias("bumped"))
    for r in rows.collect():
        assert r.y == {0: 0, 1: -1, -1: 1, 2: 2}[r.x] and r.up in (0, 1) and r.bumped == 1
        assert r.m == {k: max(r.a.get(k, 0), r.b.get(k, 0)) for k in {*r.a, *r.b}}
        assert (r.ca == r.cb) == (r.a == r.b) == (r.x == 0)
        assert json.loads(r.j) == r.a and list(json.loads(r.j)) == sorted(r.a, key=int)


def test_dominance_inside_lambdas(spark):
    """The form in which comparisons stay right when nested."""
    d = spark.createDataFrame([([{"1": 1}, {"1": 1, "2": 1}, {"3": 1}],)], f"vs array<{MAP}>")
    got = d.select(F.transform("vs", lambda x: F.exists("vs", lambda y: vectors.dominates(y, x))).alias("r")).first().r
    assert got == [True, False, False]


def test_vector_text(spark):
    big = "11535086261826064642"
    r = one(spark, vectors.to_json("v"), vectors.canonical("v"), vectors.device_id("b"), vectors.device_id(F.lit(b"").cast("binary")), v=({"100": 1, "2": 4, "1": 2, big: 255}, MAP), b=(bytes(range(1, 10)), "binary"))
    assert r.c0 == '{"1":2,"2":4,"100":1,"11535086261826064642":255}'
    assert r.c1 == "1:2|2:4|64:1|a014dbd6f1a19102:ff|"
    assert r.c2 == str(0x0102030405060708) and r.c3 == "0"


def test_block_sizes_and_hashes(spark):
    k, m = 1 << 10, 1 << 20
    for size, want in [(0, 128 * k), (250 * m, 128 * k), (500 * m, 256 * k), (m * k, m), (2 * m * k, 2 * m), (4 * m * k, 4 * m), (8 * m * k, 8 * m), (16 * m * k, 16 * m), (64 * m * k, 16 * m)]:
        assert one(spark, content.block_size("n"), n=(size, "long")).c0 == want
    data = bytes(i % 251 for i in range(1000))
    r = one(spark, content.block_hashes("b", 300), content.block_hashes(F.lit(b"").cast("binary"), 300), content.unflatten(content.flatten(content.block_hashes("b", 300))), content.preview("b"), content.preview(F.lit(b"plain\ntext")), b=(data, "binary"))
    assert r.c0 == [hashlib.sha256(data[i : i + 300]).hexdigest() for i in range(0, 1000, 300)] == r.c2
    assert r.c1 == [] and r.c3.startswith("[binary] 000102") and r.c4 == "plain\ntext"
    offset, size = content.block_range("n", "s", "i")
    assert one(spark, offset, size, n=(1000, "long"), s=(300, "int"), i=(3, "int"))[:] == (900, 100)
    assert one(spark, size, n=(1000, "long"), s=(300, "int"), i=(4, "int")).c0 == 0


def test_names(spark):
    c = lambda f, name: one(spark, f("n"), n=(name, "string")).c0
    copy = one(spark, paths.conflict_name("n", "t", "1"), n=("a.d/doc.txt", "string"), t=(1787040000, "long")).c0
    assert copy == "a.d/doc.sync-conflict-20260818-080000-1.txt"
    assert c(paths.conflict_stem, copy) == "a.d/doc" and c(paths.conflict_original, copy) == "a.d/doc.txt"
    assert c(paths.conflict_original, "x.sync-conflict-20260818-080000-1.sync-conflict-20260818-080000-2") == "x.sync-conflict-20260818-080000-1"
    assert c(paths.ancestors, "a/b/c") == ["a", "a/b"] and c(paths.ancestors, "a") == [] and c(paths.parent, "a") == "."
    assert [c(paths.is_confined, x) for x in ("a/b", "a/../b", "../a", "a/../../b", "/a", "./a", "a\\..\\..\\b", "")] == [True, True, False, False, False, True, False, False]
    assert [c(paths.is_reserved, x) for x in (".sfx-tmp/a", "a/.sfx-1.part", "a.sfx-b")] == [True, True, False]
    assert c(paths.problem, "open: Permission denied") == "permission denied — check PUID/PGID ownership"
    assert c(paths.problem, "odd " * 60) == "cannot apply: " + ("odd " * 60)[:140]


def test_ignore_rules(spark):
    lines = ["# c", "", "*.tmp", ".venv/", "*.log", "!important.log", "thumbs.db", "*_cache", "/top", "foo*.bak", "deep/dir"]
    r = rules.compile_rules(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "folder string, ord int, line string"))
    cases = {
        ("a/b/file.TMP", 0): True, ("note.tmp.bak", 0): True, ("note.tmp", 0): True, (".venv/x", 0): True, ("src/.venv/x", 0): False, (".venv", 0): True, ("a.log", 0): True, ("important.log", 0): False,
        ("a/important.log", 0): False, ("x/thumbs.db", 0): True, ("a_cache", 0): True, ("a_cache", 1): False, ("top", 1): True, ("top/x", 0): True, ("in/top", 0): False, ("y.bak", 0): True, ("deep/dir/x", 0): True,
    }
    d = spark.createDataFrame([("f", n, t, w) for (n, t), w in cases.items()], "folder string, name string, type int, want boolean")
    for x in rules.with_rules(d, r).collect():
        assert x.ignored == x.want, x.name
    pruned = rules.prune_ignored_dirs(d, r).select("name").collect()
    assert ".venv/x" not in {x.name for x in pruned} and ".venv" in {x.name for x in pruned}


def test_scan_diff(spark, table):
    c = table(row("1", "same", {"1": 1}), row("1", "old", {"1": 1}), row("1", "gone", {"1": 1}), row("1", "dead", {"1": 2}, deleted=True), row("1", "skip.tmp", {"1": 1}), row("1", "d", {"1": 1}, kind=1))
    seen = spark.createDataFrame([("f", n, t, s, m, 0, 0) for n, t, s, m in [("same", 0, 5, 100), ("old", 0, 6, 100), ("dead", 0, 5, 9), ("new", 0, 1, 1), ("skip.tmp", 0, 5, 100), ("d", 1, 0, 0), ("e", 1, 0, 0), (".sfx-tmp/x", 0, 1, 1)]], "folder string, name string, type int, size long, modified_s long, modified_ns int, mode int")
    r = rules.compile_rules(spark.createDataFrame([("f", 1, "*.tmp")], "folder string, ord int, line string"))
    got = {x.name: x.kind for x in diff.scan_diff(seen, c, r).collect()}
    assert got == {"old": "modified", "gone": "deleted", "dead": "modified", "new": "added", "skip.tmp": "skipped", "e": "added"}
    bad = spark.createDataFrame([("f",)], "folder string")
    assert "deleted" not in {x.kind for x in diff.scan_diff(seen, c, r, bad).collect()}
    texts = spark.createDataFrame([("f", n, b"abc") for n in ("old", "new")], "folder string, name string, content binary")
    after = {x.name: x for x in sync.scan(seen, texts, c, r, "1")[1].collect()}
    assert after["old"].version == {"1": 2} and after["old"].blocks == [hashlib.sha256(b"abc").hexdigest()]
    assert after["gone"].deleted and after["gone"].size == 0 and after["new"].version == {"1": 1} and after["dead"].deleted
    assert len({x.sequence for x in after.values() if x.sequence > 1}) == 4


def test_winners(spark, table):
    c = table(
        row("1", "newer", {"1": 1}, t=10), row("2", "newer", {"2": 1}, t=11, h="b"), row("1", "tie", {"1": 1}), row("2", "tie", {"2": 1}, h="b"), row("1", "ns", {"1": 1}, ns=2), row("2", "ns", {"2": 1}, ns=1, h="b"),
        row("1", "alike", {"1": 1}), row("2", "alike", {"2": 1}, t=999), row("1", "gone", {"1": 1}), row("2", "gone", {"1": 1, "2": 1}, deleted=True), row("1", "edit", {"1": 2}), row("2", "edit", {"2": 1}, deleted=True),
        row("1", "three", {"1": 1}, t=50), row("2", "three", {"2": 1}, t=10, h="b"), row("3", "three", {"1": 1, "3": 1}, t=20, h="c"),
    )
    pulls = {x.name: (x.reason, x.winner_replica) for x in reconcile.need_pulls(c, "1").collect()}
    assert pulls == {"newer": ("conflict", "2"), "tie": ("conflict", "2"), "gone": ("delete", "2"), "three": ("newer", "3")}
    other = {x.name for x in reconcile.need_pulls(c.where("replica <> '3'"), "2").collect()}
    assert "newer" not in other and "tie" not in other and "ns" in other
    assert {x.name for x in reconcile.pending_deletions(c, "1").collect()} == {"gone"}
    up = {x.name: x.lacking for x in reconcile.pending_uploads(c, "1", spark.createDataFrame([("2",)], "peer string")).collect()}
    assert up == {"edit": 1, "gone": 1}


def test_moves(spark, table):
    c = table(
        row("1", "a", {"1": 1}, h="x"), row("2", "a", {"1": 1, "2": 1}, deleted=True), row("2", "b", {"2": 1}, h="x"),
        row("1", "c1", {"1": 1}, h="y"), row("2", "c1", {"1": 1, "2": 1}, deleted=True), row("2", "c2", {"2": 1}, h="y"), row("2", "c3", {"2": 1}, h="y"),
        row("1", "d", {"1": 1}, h="z"), row("2", "d", {"1": 1, "2": 1}, deleted=True), row("2", "e", {"2": 1}, h="z"), row("1", "e", {"1": 9}, deleted=True),
    )
    moves = reconcile.plan_moves(c, "1", "2")
    assert {(x.from_name, x.to_name) for x in moves.collect()} == {("a", "b"), ("d", "e")}
    assert {x.from_name: x.problem for x in reconcile.validate_moves(moves, c, "1", "2").collect()} == {"a": None, "d": "target exists"}
    folders = spark.createDataFrame([("f", "conflict-copy", False, 25, 0)], "id string, conflict string, versioned boolean, max_delete_pct int, max_delete_files int")
    markers = spark.createDataFrame([("f", "2", "i", 1)], "folder string, peer string, index_id string, max_seq long")
    p = sync.plan(c, folders, markers, "1", "2")
    after = {x.name: x for x in sync.apply_plan(c, p, "1", "2").where("replica = '1'").collect()}
    assert after["a"].deleted and after["b"].blocks == ["x"] and after["b"].version == {"2": 1} and after["c1"].deleted and after["c2"].blocks == ["y"]
    assert reconcile.need_pulls(sync.apply_plan(c, p, "1", "2"), "1").count() == 0


def test_conflict_copies(spark, table):
    c = table(row("1", "a.txt", {"1": 1}, t=1787040000), row("2", "a.txt", {"2": 1}, t=1887040000, h="b"))
    folders = spark.createDataFrame([("f", "conflict-copy", False)], "id string, conflict string, versioned boolean")
    plan = reconcile.overwrite_plan(c, "1", folders)
    assert plan.first().copy_name == "a.sync-conflict-20260818-080000-1.txt"
    copy = reconcile.conflict_copies(plan, c, "1").first()
    assert copy.version == {"1": 1} and copy.blocks == [] and copy.name == plan.first().copy_name


@pytest.mark.parametrize(("case", "want"), [((1000, 50, 25, 0), False), ((1000, 150, 25, 0), False), ((1000, 300, 25, 0), True), ((1000, 150, 10, 0), True), ((1000, 250, 99, 200), True), ((0, 500, 25, 0), False)])
def test_deletion_guard(spark, case, want):
    live, dels, pct, files = map(F.lit, case)
    assert one(spark, guards.tripped(live, dels, pct, files)).c0 is want


def test_case_collisions(spark, table):
    c = table(row("1", "Foo.txt", {"1": 1}), row("1", "foo.txt", {"1": 1}), row("1", "d/A", {"1": 1}), row("1", "D/a", {"1": 1}), row("1", "b", {"1": 1}), row("1", "B", {"1": 1}, deleted=True))
    assert {(x.dir, x.names) for x in guards.case_collisions(c, "1").collect()} == {(".", "Foo.txt / foo.txt"), ("d", "D/a / d/A")}


def test_catalog_writes(spark, table, tmp_path):
    c = table(*(row("1", f"n{i}", {"1": 1}, seq=i + 1) for i in range(5)))
    assert catalog.max_sequence(c).first().max_sequence == 5
    gone = c.where("name = 'n2'").withColumns({"deleted": F.lit(True), "sequence": F.lit(None).cast("long")})
    after = catalog.put(c, gone)
    assert [(x.name, x.sequence) for x in catalog.list_after(after, 5).collect()] == [("n2", 6)]
    catalog.write_catalog(after, f"{tmp_path}/c")
    assert catalog.read_catalog(spark, f"{tmp_path}/c").count() == 4 and catalog.read_catalog(spark, f"{tmp_path}/c", True).count() == 5
    assert catalog.delete_entries(after, gone.select("name")).count() == 4
    m = spark.createDataFrame([("f", "2", "a", 1)], "folder string, peer string, index_id string, max_seq long")
    assert catalog.get_marker(catalog.set_marker(m, m.withColumn("max_seq", F.lit(9).cast("long"))), "f", "2").first().max_seq == 9


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_sequences_of_many_rows(spark, adaptive):
    """More rows than Spark samples for its ranges: none is lost, and each gets a number of its own."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        d = spark.range(500_000).select(
            F.when(F.col("id") % 3 == 0, "f").otherwise("g").alias("folder"), F.lit("1").alias("replica"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(None).cast("long").alias("sequence")
        )
        last = spark.createDataFrame([("f", "1", 10)], "folder string, replica string, max_sequence long")
        got = catalog.numbered(d.repartition(7), last)
        w = got.groupBy("folder").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("k"), F.min("sequence").alias("a"), F.max("sequence").alias("b")).orderBy("folder").collect()
        assert [tuple(r) for r in w] == [("f", 166_667, 166_667, 11, 166_677), ("g", 333_333, 333_333, 1, 333_333)]
        from pyspark.sql.window import Window

        before = F.lag("name").over(Window.partitionBy("folder", F.floor(F.col("sequence") / 1000)).orderBy("sequence"))
        assert got.withColumn("before", before).where("before >= name").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


EVENT = "id long, ts_s long, folder string, path string, category string, severity int, reason string, resolution int, ack_by string, ack_ts long, linked string, peer_id string"


def event(i, t, path="p", category="error", severity=1, resolution=0, reason="r", folder="f", peer="0"):
    return (i, t, folder, path, category, severity, reason, resolution, "", None, "", peer)


def test_event_states(spark):
    e = spark.createDataFrame([event(1, 10), event(2, 20, severity=0)], EVENT)
    act = lambda *a, **k: events.action(spark, *a, **k)
    state = lambda log, actions: {r.id: r.resolution for r in events.fold_state(log, actions).collect()}
    nothing = act("acknowledge", 1, "me", 1).limit(0)
    assert state(e, nothing) == {1: 0, 2: 0}
    acked = act("acknowledge", 1, "me", 30, id=1)
    assert state(e, acked) == {1: 1, 2: 0} and events.fold_state(e, acked).where("id = 1").first().ack_by == "me"
    again = e.unionByName(spark.createDataFrame([event(3, 40)], EVENT))
    assert state(again, acked) == {1: 0, 2: 0, 3: 0}
    condition = ("f", "p", "error")
    assert state(again, acked.unionByName(act("resolve", 2, "me", 50, condition=condition))) == {1: 2, 2: 0, 3: 2}
    assert state(again, act("auto_resolve", 2, "system", 50, condition=condition)) == {1: 3, 2: 0, 3: 3}
    assert state(again, act("acknowledge", 2, "me", 50, condition=condition)) == {1: 1, 2: 1, 3: 1}
    assert state(again, acked.unionByName(act("resolve", 2, "me", 35, id=1))) == {1: 2, 2: 0, 3: 0}
    assert state(again, act("acknowledge", 1, "me", 50, id=3).unionByName(act("reopen", 2, "me", 60, condition=condition))) == {1: 0, 2: 0, 3: 0}


def test_fold_against_a_plain_loop(spark):
    import random

    draw = random.Random(7)
    rows = [event(i, draw.randint(0, 60), path=f"p{draw.randint(0, 3)}", severity=draw.randint(0, 2), resolution=draw.choice([0, 0, 0, 1, 2])) for i in range(1, 60)]
    acts = [(k, draw.choice(["acknowledge", "reopen", "resolve"]), draw.randint(1, 59), "", "", "", "x", draw.randint(0, 80)) for k in range(60)]
    acts += [(k, draw.choice(["acknowledge", "reopen", "resolve", "auto_resolve"]), None, "f", f"p{draw.randint(0, 3)}", "error", "x", draw.randint(0, 80)) for k in range(60, 90)]
    want = {}
    for i, born, _, path, _, severity, _, r, *_ in rows:
        steps = [(t, 1, k, kind, target is None) for k, kind, target, _, p, _, _, t in acts if t >= born and (target == i or (target is None and p == path))]
        steps += [(t, 0, j, "recorded", True) for j, t, _, p, *_ in rows if j > i and p == path and t >= born]
        for _, _, _, kind, whole in sorted(steps):
            if kind == "acknowledge" and r == 0:
                r = 1
            elif kind in ("reopen", "recorded") and r == 1:
                r = 0
            elif kind == "resolve" and (not whole or (r == 0 and severity)):
                r = 2
            elif kind == "auto_resolve" and r == 0 and severity:
                r = 3
        want[i] = r
    got = events.fold_state(spark.createDataFrame(rows, EVENT), spark.createDataFrame(acts, events.ACTION))
    assert {r.id: r.resolution for r in got.collect()} == want


def test_event_filters(spark):
    e = spark.createDataFrame([event(i, i, path=f"p{i}", severity=min(i, 1)) for i in range(5)] + [event(10, 9, folder="peers", path="nas", category="peer", peer="7"), event(11, 9, peer="7"), event(12, 9, peer="3")], EVENT)
    ids = lambda **k: [r.id for r in events.query_events(e, events.Filter(**k)).collect()]
    assert ids(limit=2) == [12, 11] and len(ids(limit=1, open_only=True)) == 7
    assert ids(peer="7", peer_name="nas") == [11, 10] and ids(self_only=True, peer="7") == [4, 3, 2, 1, 0]
    assert events.count_open(e).where("folder = 'peers'").first().open_conditions == 1
    r = events.archive_preview(e, 6, False, 10).first()
    assert (r.deleted, r.deleted_open, r.kept_open) == (1, 0, 3)
    assert events.archive_events(e, 6, True, 10).count() == 4


def test_alert_cooldown(spark):
    e = spark.createDataFrame([event(1, 0), event(2, 600), event(3, 899), event(4, 900), event(5, 1700), event(6, 1800), event(7, 0, category="applied", severity=0), event(8, 5, category="peer", reason="peer offline: x")], EVENT)
    assert {r.id for r in events.throttle_alerts(e, 900).collect()} == {1, 4, 6, 8}


def test_backoff(spark):
    rows = [(i, "p", i, False, "e") for i in range(1, 31)] + [(31, "p", 31, True, None), (32, "p", 32, False, "e")]
    got = {r.id: r for r in events.peer_backoff(spark.createDataFrame(rows, "id long, peer string, ts long, ok boolean, error string")).collect()}
    assert [got[i].wait_s for i in (1, 2, 30, 31, 32)] == [5, 10, 300, 0, 5] and got[31].recovered


def test_blocks(spark):
    texts = spark.createDataFrame([("f", "a", b"x" * 25), ("f", "b", b"")], "folder string, name string, content binary")
    b = blocks.explode_blocks(texts, "content", 10)
    assert blocks.manifest(b).first().n_blocks == 3
    got = spark.createDataFrame([("f", "a", 0, b"x" * 10), ("f", "a", 1, b"y" * 10), ("f", "a", 9, b"x")], "folder string, name string, idx int, data binary")
    seen = blocks.verify_blocks(got, b)
    assert {r.idx: r.ok for r in seen.collect()} == {0: True, 1: False, 9: False} and blocks.complete_files(b, seen).count() == 0
    asked = spark.createDataFrame([("f", "a", 20, 5), ("f", "a", 20, 10), ("f", "z", 0, 1)], "folder string, name string, offset long, size long")
    assert sorted(r.code for r in blocks.read_blocks(texts, asked).collect()) == [0, 2, 2]


def test_retention(spark):
    rows = [("f", "simple", "p", 1, 100 + i, i) for i in range(5)] + [("f", "staggered", "q", 1, i * 43200, i) for i in range(4)] + [("f", "trashcan", "r", 1, i, i) for i in range(2)]
    a = spark.createDataFrame(rows, "folder string, strategy string, path string, size long, modified_s long, stamp long")
    kept = {(r.path, r.stamp) for r in retention.prune_keep(a, 1).collect()}
    assert kept == {("p", 4), ("q", 1), ("q", 3), ("r", 1)}
    assert retention.prune_keep(a, 0).count() == 10 and retention.prune_age(a, 0, 10**9).count() == 11 and retention.prune_age(a, 1, 86400 + 104).count() == 4
    with pytest.raises(ValueError, match="unknown"):
        retention.archive_rows(a, "odd")


def test_messages_and_listing(spark, tmp_path):
    h = hashlib.sha256(b"abc").digest()
    text = {"folder": "f", "files": [{"name": "a", "size": 3, "version": {"11535086261826064642": 2}, "blocks": [base64.b64encode(h).decode()]}, {"name": "b", "deleted": True}], "update": True}
    (tmp_path / "m.json").write_text(json.dumps(text))
    rows = {r.name: r for r in messages.read_index_messages(spark, f"{tmp_path}/m.json", "2").collect()}
    assert rows["a"].blocks == [h.hex()] and rows["a"].version == {"11535086261826064642": 2} and rows["b"].deleted and rows["b"].is_update
    (tmp_path / "root/d/e").mkdir(parents=True)
    (tmp_path / "root/d/e/x.txt").write_bytes(b"abc")
    (tmp_path / "root/y").write_bytes(b"1")
    seen = listing.read_listing(spark, f"{tmp_path}/root", "f")
    assert {(r.name, r.type, r.size) for r in seen.collect()} == {("d", 1, 0), ("d/e", 1, 0), ("d/e/x.txt", 0, 3), ("y", 0, 1)}
    assert {(r.name, bytes(r.content)) for r in listing.read_content(spark, f"{tmp_path}/root", seen).collect()} == {("d/e/x.txt", b"abc"), ("y", b"1")}
    big = spark.createDataFrame([("f", "x", f"file://{tmp_path}/root/d/e/x.txt", 3)], "folder string, name string, path string, size long")
    assert listing.hash_ranges(listing.block_ranges(big)).first().hash == h.hex()


def test_listing_is_complete(spark, tmp_path, monkeypatch):
    """Empty files, empty directories, links and large files: a scan of what a catalog holds finds no change."""
    root = tmp_path / "root"
    (root / "emptydir").mkdir(parents=True)
    (root / "d/e f").mkdir(parents=True)
    (root / "empty.txt").write_bytes(b"")
    (root / "d/e f/100% ü.bin").write_bytes(b"x" * 5000)
    (root / "link").symlink_to(root / "d")
    (root / "broken").symlink_to("nowhere")
    monkeypatch.setattr(listing, "MOST_BYTES", 1000)
    seen = listing.read_listing(spark, f"file://{root}", "f")
    rows = {r.name: r for r in seen.collect()}
    assert {n: (r.type, r.size) for n, r in rows.items()} == {"emptydir": (1, 0), "d": (1, 0), "d/e f": (1, 0), "empty.txt": (0, 0), "d/e f/100% ü.bin": (0, 5000), "link": (2, 0), "broken": (2, 0)}
    assert rows["empty.txt"].mode == (root / "empty.txt").stat().st_mode & 0o7777 and rows["empty.txt"].modified_s == (root / "empty.txt").stat().st_mtime_ns // 10**9
    nothing = spark.createDataFrame([], CATALOG)
    changes, after = sync.scan(seen, listing.read_content(spark, str(root), seen), nothing, None, "1")
    assert {r.name: r.kind for r in changes.collect()} == {n: "added" for n in rows} and after.count() == 7
    assert diff.scan_diff(listing.read_listing(spark, str(root), "f"), after).count() == 0


def test_restores_and_resolutions(spark, table):
    copy = "a.sync-conflict-20260818-080000-1.txt"
    c = table(row("1", "a.txt", {"1": 1}), row("1", copy, {"1": 1}), row("1", "b", {"1": 4}, deleted=True), row("1", "gone", {"1": 1}), row("2", "gone", {"1": 1, "2": 1}, deleted=True))
    gone, actions, n = resolve.resolve_all_conflicts(c, "1", 50)
    assert [(r.name, r.deleted, r.version) for r in gone.collect()] == [(copy, True, {"1": 2})] and n.first().resolved == 1
    assert {(r.kind, r.path, r.category) for r in actions.collect()} == {("resolve", "a.txt", "conflict"), ("resolve", copy, "conflict")}
    what = "folder string, path string, source string, from_copy boolean, size long, modified_s long, modified_ns int, mode int, block_size int, blocks array<string>"
    chosen = spark.createDataFrame([("f", "a.txt", copy, True, 7, 9, 0, 0, 131072, ["h"]), ("f", "b", "b/17", False, 3, 8, 0, 0, 131072, ["k"]), ("f", "../x", "x", False, 3, 8, 0, 0, 131072, ["k"])], what)
    back, rows, actions = resolve.restore_entries(c, chosen, "1", 60)
    assert {(r.name, r.deleted, r.version["1"]) for r in back.collect()} == {("a.txt", False, 2), ("b", False, 5), (copy, True, 2)}
    assert {(r.path, r.reason) for r in rows.collect()} == {("a.txt", f"restored from conflict copy {copy}"), ("b", "restored from archived version b/17")} and actions.count() == 2
    dead, rows, clear = resolve.apply_pending_deletions(c, "1", "f", 70)
    assert [(r.name, r.deleted) for r in dead.collect()] == [("gone", True)] and rows.first().reason == "deleted (remote)" and clear.first().category == "error"


def test_peers_by_id_or_name(spark):
    peers = spark.createDataFrame([("11535086261826064642", "NAS"), ("7", "Attic")], "peer string, name string")
    refs = spark.createDataFrame([("nas",), ("7",), ("0",), ("8",), ("Home",), ("5",), ("attic ",)], "ref string")
    got = {r.ref: (r.peer, r.is_self) for r in status.resolve_peers(refs, peers, "5", "home").collect()}
    assert got == {"nas": ("11535086261826064642", False), "7": ("7", False), "0": (None, False), "8": (None, False), "Home": (None, True), "5": (None, True), "attic ": (None, False)}


def test_offline_reasons(spark):
    c = lambda text: one(spark, events.offline_reason("e"), e=(text, "string")).c0
    assert c("remote: Certificate does not VERIFY").startswith("TLS fingerprint mismatch") and c("tls: bad record").startswith("TLS handshake failed") and c("no Route") == "no Route"


def test_problem_text_is_cut_by_bytes(spark):
    got = one(spark, paths.problem("n"), n=("é" * 100, "string")).c0
    assert got == "cannot apply: " + "é" * 70


def test_latest_rows_of_a_batch(spark):
    rows = [("f", "2", "a", 1, True), ("f", "2", "a", 3, True), ("f", "2", "a", 2, True), ("g", "2", "x", 5, False), ("g", "2", "old", 4, True), ("g", "2", "new", 6, True), ("g", "2", "x", 7, True)]
    got = streams.latest_rows(spark.createDataFrame(rows, "folder string, replica string, name string, sequence long, is_update boolean"))
    assert {(r.name, r.sequence) for r in got.collect()} == {("a", 3), ("x", 7), ("new", 6)}


def test_scan_hashes_files_too_large_for_one_value(spark, tmp_path, monkeypatch):
    data = random.Random(3).randbytes(300_000)
    (tmp_path / "root/a b").mkdir(parents=True)
    (tmp_path / "root/a b/big 100%.bin").write_bytes(data)
    (tmp_path / "root/small").write_bytes(b"abc")
    monkeypatch.setattr(listing, "MOST_BYTES", 1000)
    seen = listing.read_listing(spark, f"{tmp_path}/root", "f")
    contents = listing.read_content(spark, f"{tmp_path}/root", seen)
    nothing = spark.createDataFrame([], CATALOG)
    got = {r.name: r for r in diff.rebuild_catalog(seen, contents, None, "1", nothing).collect()}
    step = 128 << 10
    assert set(got) == {"a b", "a b/big 100%.bin", "small"}
    assert got["a b/big 100%.bin"].blocks == [hashlib.sha256(data[i : i + step]).hexdigest() for i in range(0, len(data), step)]
    assert got["a b/big 100%.bin"].block_size == step and got["small"].blocks == [hashlib.sha256(b"abc").hexdigest()]


def test_declarations(spark):
    f = spark.createDataFrame([("n", "a", "A", "/mnt/user/a", "newest", "simple"), ("n", "a", "", "rel", "odd", "odd"), ("n", "c", "C", "/etc", None, None)], "node string, id string, name string, path string, conflict string, versioning string")
    p = spark.createDataFrame([("n", "p", "P", ["h:1"], "ab" * 32), ("n", "q", "Q", [], "xyz"), ("n", "r", "R", [" "], None)], "node string, id string, name string, addresses array<string>, fingerprint string")
    got = {(r.id, r.violation) for r in declarations.check_declarations(f, p).collect()}
    assert got == {
        ("a", "missing folder name"), ("a", "relative path"), ("a", "unknown conflict policy"), ("a", "unknown versioning type"), ("a", "duplicate folder id"), ("c", "path outside the share"),
        ("q", "no address"), ("q", "malformed fingerprint"), ("r", "empty address"),
    }


def test_attention(spark, table):
    copy = "a.sync-conflict-20260818-080000-1.txt"
    c = table(row("1", "a.txt", {"1": 1}), row("2", "a.txt", {"1": 1}), row("1", copy, {"1": 1}), row("1", "up", {"1": 1}), row("2", "pull", {"2": 1}, size=9))
    e = spark.createDataFrame([event(1, 1, path="a.txt", category="conflict", reason="old"), event(2, 2, path="a.txt", category="conflict", reason="new"), event(3, 3, path="ghost", category="conflict")], EVENT)
    got = {r.name: r for r in status.attention(c, e, "1", spark.createDataFrame([("2",)], "peer string")).collect()}
    assert set(got) == {copy, "up", "pull", "ghost"} and got[copy].reason == "new" and got[copy].conflict_of == "a.txt" and got["pull"].size == 9 and got["up"].pending_up
    assert {r.path for r in events.stale_conflicts(e, c, "1").collect()} == {"ghost"}
