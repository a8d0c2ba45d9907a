import random

import numpy as np

from replicalog.llm import graph, ngram_join

from . import brute


def corpus(seed, n=160):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 5)))
    hot = [word() for _ in range(30)]
    texts = []
    for k in range(n):
        kind = k % 8
        if kind < 3 or not texts:
            w = [word() for _ in range(draw.randint(1, 80))]
            texts.append(" ".join(hot + w if kind == 1 else w))
        elif kind == 3:
            texts.append(draw.choice(texts))
        else:
            w = draw.choice(texts).split()
            for _ in range(draw.randint(0, max(1, len(w) // 20))):
                w[draw.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if kind == 7 else " \n".join(w))
    return dict(enumerate(texts))


def check(spark, texts, **more):
    got = ngram_join.joined(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), **more).collect()
    want = brute.components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_slices_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GATHER", 500)
    check(spark, corpus(2), slice_size=400)


def test_near_copies_of_one_text(spark):
    """Copies of one base, each with its own edits: linked with the base, mostly not with each other."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for k in range(90):
        w = list(base)
        for _ in range(k % 4):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        texts[k + 5] = " ".join(w)
    check(spark, texts, slice_size=2000)


def test_search_alone():
    for seed in range(30):
        draw = np.random.default_rng(seed)
        sets = []
        for _ in range(60):
            s = sets[draw.integers(len(sets))] if sets and draw.random() < 0.7 else draw.integers(0, 10**9, draw.integers(1, 60))
            s = np.unique(np.concatenate([s[draw.random(len(s)) > 0.07], draw.integers(0, 10**9, draw.integers(0, 4))]))
            sets.append(s if len(s) else np.array([1]))
        sets.sort(key=len, reverse=True)
        for side in (None, draw.random(60) < 0.5):
            want, got = ngram_join.Forest(60), ngram_join.Forest(60)
            for a in range(60):
                for b in range(a + 1, 60):
                    n = len(np.intersect1d(sets[a], sets[b]))
                    if (side is None or side[a] != side[b]) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        want.join(a, b)
            for a, b in ngram_join.linked(sets, side):
                got.join(a, b)
            assert [want.root(i) for i in range(60)] == [got.root(i) for i in range(60)]


def test_all_pairs_and_repeated_rows(spark):
    texts = corpus(4, 60)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found, members = ngram_join.pairs(docs, slice_size=300)
    sets = {i: brute.shingle_sets(t) for i, t in texts.items()}
    rep = {i: min(j for j in texts if sets[j] == s) if s else i for i, s in sets.items()}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in found.collect()} == want and {tuple(r) for r in members.collect()} == set(rep.items())
    rows = [(7, "one two three four five six", "a"), (7, "one two three four five six", "a"), (8, "one two three four five six", "b"), (9, "own", "c")]
    once = ngram_join.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string, __lost string"))
    assert sorted(map(tuple, once.collect())) == [rows[0], rows[3]]


def test_odd_rows(spark):
    docs = brute.odd_docs(spark)
    docs = docs.unionByName(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars", "w")).unionByName(docs.where("doc_id = 4"))
    got = ngram_join.joined(docs).collect()
    assert len(got) == 2 * len(brute.ODD_TEXTS) + 1
    want = brute.components(dict(enumerate(brute.ODD_TEXTS)))
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert ngram_join.joined(spark.createDataFrame([], docs.schema)).count() == 0
    assert ngram_join.first_of_groups(docs).columns == docs.columns


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (None, 3), (200, 100), (100, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 100}


def test_hashes_are_shuffled_in_four_bytes():
    """However wide a range is, in order, and equal where the hashes are."""
    draw = np.random.default_rng(5)
    for buckets in (16, 204, 10**5, 10**6):
        width = -(-(1 << 48) // buckets)
        token = np.sort(draw.integers(3 * width, 4 * width, 1000).astype(np.uint64))
        got = ngram_join.offsets_of(token, width)
        assert got.dtype == np.uint32 and (np.diff(got.astype(np.int64)) >= 0).all()
        assert len(np.unique(got)) > 990 and (got == ngram_join.offsets_of(token.copy(), width)).all()


def test_sets_are_not_shuffled_to_learn_their_slices(spark, monkeypatch):
    """Rows of a search meet in their slice by one shuffle; beyond the bound, by joins, results are the same."""
    sets = spark.createDataFrame([(i, list(range(i // 4 * 100, i // 4 * 100 + 50))) for i in range(40)], "doc_id long, s array<long>").repartition(3)
    members = spark.createDataFrame([(i, i // 4, 1) for i in range(40)], "node long, block long, slices int")
    sides = []
    kept = ngram_join.searched
    monkeypatch.setattr(ngram_join, "searched", lambda rows, every=False: (sides.append(rows), kept(rows, every))[1])
    roots = lambda: {r.node: r.root for r in graph.components(ngram_join.links(sets, members, 1000)).collect()}
    assert roots() == {i: i // 4 * 4 for i in range(40)}
    assert "BroadcastHashJoin" in (plan := sides[0]._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 5)
    assert roots() == {i: i // 4 * 4 for i in range(40)}
