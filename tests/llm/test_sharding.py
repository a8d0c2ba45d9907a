import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from replicalog.llm import sharding

from .brute import odd_docs


def totals(held, moves, shards):
    at = [0] * shards
    for slot, shard, b in held:
        at[moves.get(slot, shard)] += b
    return at


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(1, 7), st.integers(0, 3))
def test_moves_level_the_shards_as_far_as_slots_allow(sizes, shards, fewer):
    held = [(i, i % max(shards - fewer, 1), b) for i, b in enumerate(sizes)]
    at = totals(held, sharding.moved(held, shards), shards)
    # What a shard has beyond a fair share is at most its last slot; slots beyond the share stand alone.
    left, rest = shards, sum(sizes)
    alone = 0
    for b in sorted(sizes, reverse=True):
        if left == 1 or b * left <= rest:
            break
        rest, left, alone = rest - b, left - 1, alone + 1
    largest = max([b for b in sorted(sizes, reverse=True)[alone:]], default=0)
    assert sorted(at)[: len(at) - alone][-1] <= rest / left + largest
    assert sum(at) == sum(sizes)


def test_a_further_shard_takes_slots_and_no_others_move():
    held = [(i, i % 4, 10 + i % 3) for i in range(4000)]
    level = {s: t for s, t in sharding.moved(held, 4).items()}
    held = [(s, level.get(s, t), b) for s, t, b in held]
    moves = sharding.moved(held, 5, [4])
    assert set(moves.values()) == {4} and abs(len(moves) - 800) < 100
    at = totals(held, moves, 5)
    assert max(at) - min(at) < 40


def check(rows, docs):
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    places, slots, at = defaultdict(list), {}, [0] * sharding.SHARDS
    for r in rows:
        places[r.shard].append(r.slot)
        assert slots.setdefault(r.virtual_slot, r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
        at[r.shard] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return at


def test_query_against_its_law(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    at = check(sharding.shard(docs).collect(), docs.collect())
    assert max(at) - min(at) < 0.01 * sum(at) / len(at)


def test_odd_rows_repeats_and_clashing_columns(spark):
    docs = odd_docs(spark)
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("NULL doc_id", "text", "lang", "source", "n_chars", "w"))
    docs = docs.selectExpr("*", "7 shard", "'x' slot", "1 virtual_slot", "2 place", "'y' law")
    check(sharding.shard(docs).collect(), docs.collect())
    assert sharding.shard(docs.limit(0)).collect() == []


def test_one_long_document_stands_alone(spark):
    docs = spark.createDataFrame([(i, "x" * (100_000 if i == 3 else 100)) for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    at = check(rows, docs.collect())
    own = next(r.shard for r in rows if r.doc_id == 3)
    others = [b for s, b in enumerate(at) if s != own]
    assert max(others) - min(others) <= 300 and at[own] < 101_000


def test_versions_of_the_map_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    first = sharding.first_map(spark, 3, 12)
    sharding.save_map(first, path)
    used = spark.createDataFrame([(s, 100 if s % 3 == 0 else 1, 1) for s in range(12)], "virtual_slot int, bytes long, rows long")
    edits = sharding.rebalanced(sharding.load_map(spark, path), used, 3)
    sharding.save_map(edits, path)
    sharding.save_map(edits, path)
    stored = sharding.load_map(spark, path)
    assert stored.count() == 12 + edits.count() and {r.version for r in edits.collect()} == {2}
    assert {tuple(r) for r in sharding.map_at(stored, 1).collect()} == {(s, s % 3) for s in range(12)}
    moved = {tuple(r) for r in edits.select("slot", "shard").collect()}
    assert moved < {tuple(r) for r in sharding.map_at(stored).collect()}
