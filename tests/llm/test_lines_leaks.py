import functools
import random

from replicalog.llm import decontaminate, line_dedup

from . import brute


def prose(draw, n):
    return " ".join("".join(draw.choices(["ka", "ro", "mi", "te", "su", "ne"], k=draw.randint(1, 4))) for _ in range(n))


def test_line_dedup_drops_all_but_the_first(spark):
    draw = random.Random(2)
    passage, short = prose(draw, 55), "Share this page"
    varied = [f"user 10{i} logged in from host{i} at gate nine with key {i}a" for i in range(4)]
    edited = passage.split()
    edited[30] = "zzz"
    rows = [(i, f"{prose(draw, 20)}\n{passage}\n{prose(draw, 9)}\nHi {i % 3}") for i in range(5)]
    rows += [(10 + i, f"{varied[i]}\n{prose(draw, 30)}") for i in range(4)]
    rows += [(20, " ".join(edited) + "\n" + prose(draw, 12)), (30, "own\nown\nown words here are mine alone and nobody has them\n" * 2)]
    rows += [(40 + i, short + "\n" + prose(draw, 11)) for i in range(10)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, gone string")
    got = {(r.doc_id, r.line): r for r in line_dedup.dropped(docs).collect()}
    assert {k for k in got if k[0] < 10} == {(i, 1) for i in range(1, 5)}
    assert {k for k in got if 10 <= k[0] < 20} == {(11, 0), (12, 0), (13, 0)}
    assert (20, 0) in got and (20, 1) not in got and not any(k[0] == 30 for k in got)
    assert {k for k in got if k[0] >= 40} == {(40 + i, 0) for i in range(1, 10)}
    cleaned = {r.doc_id: r for r in line_dedup.clean(docs).collect()}
    assert cleaned[0].text == rows[0][1] and cleaned[30].text == dict(rows)[30]
    assert cleaned[3].text == "\n".join(x for k, x in enumerate(rows[3][1].split("\n")) if k != 1)
    assert line_dedup.clean(docs).columns == docs.columns


def test_line_dedup_families_of_one_leaf(spark):
    """Two families of equal weight and a hot exact line share head and length; each is generalised on its own."""
    draw = random.Random(9)
    head = "at this place"
    a, b, hot = (f"{head} {prose(draw, 11)}" for _ in range(3))
    edit = lambda t, i: " ".join(f"own{chr(97 + i)}" if p in (5, 9) else w for p, w in enumerate(t.split()))
    rows = [(i, edit(a, i)) for i in range(4)] + [(10 + i, edit(b, i)) for i in range(4)]
    apart = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1, 2, 3, 11, 12, 13}
    assert {r.doc_id for r in line_dedup.dropped(apart).collect()} == want
    mixed = spark.createDataFrame(rows + [(100 + i, hot) for i in range(30)] + [(200, f"{head} {prose(draw, 11)}")], "doc_id long, text string")
    got = line_dedup.dropped(mixed).collect()
    assert {r.doc_id for r in got} == want | set(range(101, 130)) and len({r.template for r in got}) == 3


def test_line_dedup_rows_of_one_id_and_shuffled_joins(spark, monkeypatch):
    """Each row loses its own lines; with nothing broadcast the result is the same."""
    draw = random.Random(13)
    line, own, other = prose(draw, 20), prose(draw, 12), prose(draw, 12)
    rows = [(1, f"first\n{line}", "g"), (2, f"{line}\n{own}", "g"), (2, f"{other}\nown2", "g"), (None, f"{line}\n{other} x", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone string")
    want = {(1, f"first\n{line}", "g"), (2, own, "g"), (2, f"{other}\nown2", "g"), (None, f"{other} x", "g")}
    assert {tuple(r) for r in line_dedup.clean(docs).collect()} == want
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 0)
    assert {tuple(r) for r in line_dedup.clean(docs).collect()} == want


def test_line_dedup_odd_rows(spark):
    docs = brute.odd_docs(spark)
    assert line_dedup.dropped(docs).count() == 0
    assert line_dedup.clean(docs).count() == len(brute.ODD_TEXTS)
    twice = docs.unionByName(docs.selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "w"))
    want = {i + 100 for i, t in enumerate(brute.ODD_TEXTS) if any(len(x.split()) >= 8 for x in (t or "").split("\n"))}
    assert {r.doc_id for r in line_dedup.dropped(twice).collect()} == want
    empty = spark.createDataFrame([], docs.schema)
    assert line_dedup.dropped(empty).count() == 0 and line_dedup.clean(empty).count() == 0


def test_leaks(spark):
    draw = random.Random(4)
    plain = prose(draw, 40)
    sums = "a train leaves at 9 with 9 wagons and 40 seats in each so the seats are"
    rows = [(1, prose(draw, 60)), (2, prose(draw, 30) + " " + plain.upper() + "! " + prose(draw, 10)), (3, "note: A train leaves at 7 with 7 wagons and 55 seats in each so the seats are"), (4, "A train leaves at 7 with 8 wagons and 55 seats in each so the seats are"), (5, None), (6, ""), (7, " ".join(plain.split()[:9])), (8, "say one two three four five six now")]
    rows += [(9, plain + "\n" + sums)] * 2
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, plain, 0), (2, sums, 0), (3, "one two three four five six", 0), (4, None, 0), (5, "one two", 0), (1, plain, 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(2, 1): "copied", (9, 1): "copied", (9, 2): "copied", (3, 2): "reparameterised", (8, 3): "copied"}
    empty = spark.createDataFrame([], docs.schema)
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, spark.createDataFrame([], bench.schema)).count() == 0
    assert decontaminate.leaks(brute.odd_docs(spark), bench).count() == 0


UPPER_NAME = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;)]\x20)(\p{Lu}\p{Ll}+)"


def canonical(text):
    """Words, and their canonical forms, by a loop over words."""
    import regex

    t = regex.sub(UPPER_NAME, "\x02\\1", text).lower()
    t = regex.sub(r"(?<=[0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])", " ", t)
    raw, canon = regex.findall(r"[\p{L}\p{N}\x02]+", t), []
    for w in raw:
        canon.append("NAME" if w[0] == "\x02" else "NUM" if w.isdigit() else "UNIT" if canon and canon[-1] == "NUM" and w in decontaminate.UNITS else w)
    return raw, canon


def literal(c):
    return not c.isupper()


@functools.cache
def places_of(item):
    """The windows of an item by which it is looked up, each at its first place."""
    x, xc = canonical(item)
    size = decontaminate.SEED
    key = lambda i: tuple(xc[i : i + size]) if 2 * sum(map(literal, xc[i : i + size])) >= size else ("raw", *x[i : i + size])
    return {key(q): q for q in range(len(x) - size, -1, -1)} if len(x) >= decontaminate.SHORTEST else {}


@functools.cache
def looked_up(item, texts):
    """Of these windows, those that are not common among the texts."""
    places = places_of(item)
    held = {k: sum(k in places_of(t) for t in set(texts)) for k in places}
    most = max(decontaminate.COMMON, min(held.values(), default=0))
    return {k: q for k, q in places.items() if held[k] <= most}


def leaks_by_hand(doc, item, texts=()):
    """Every alignment that shares a window, compared word by word; ``texts``: all items, for what is common."""
    (d, dc), (x, xc) = canonical(doc), canonical(item)
    n, size = len(x), decontaminate.SEED
    w = decontaminate.WINDOW if n >= 16 else n // 2 if n >= 10 else n
    share = 0.5 if n >= 32 else 0.7 if n >= 16 else 0.8 if n > 8 else 1
    places = looked_up(item, texts)
    aligned = set()
    for i in range(len(d) - size + 1):
        key = tuple(dc[i : i + size]) if 2 * sum(map(literal, dc[i : i + size])) >= size else ("raw", *d[i : i + size])
        if key in places:
            aligned.add(i - places[key])
    covered, best, run = set(), 0, 0
    for offset in aligned:
        same = [0 <= p + offset < len(d) and dc[p + offset] == xc[p] for p in range(n)]
        pairs = {(x[p], d[p + offset]) for p in range(n) if same[p] and not literal(xc[p])}
        if len(pairs) > len({a for a, _ in pairs}) or sum(a != b for a, b in pairs) > sum(same[p] and literal(xc[p]) for p in range(n)):
            continue
        covered |= {p for q in range(n - w + 1) if all(same[q : q + w]) for p in range(q, q + w)}
        best = max(best, sum(same))
        run = max(run, max(map(len, "".join("1" if s else "0" for s in same).split("0"))))
    return max(best, len(covered)) >= share * n or run >= decontaminate.RUN


def test_leaks_against_brute_force(spark):
    """Whole, cut, edited and re-parameterised copies; numbers, names, units; repeated ids with different texts."""
    draw = random.Random(6)
    items = []
    for i in range(16):
        w = prose(draw, draw.randint(6, 60)).split()
        for _ in range(draw.randint(0, 6)):
            w[draw.randrange(len(w))] = draw.choice(["7", "42", "7 km", "3 kg", "12 miles"])
        items.append((i // 2, " ".join(w) + (" said Alice to Bob" if i % 4 == 0 else "")))
    items.append((90, " ".join(str(draw.randint(0, 99)) for _ in range(18))))
    docs = []
    for k in range(150):
        w = draw.choice(items)[1].split()
        for _ in range(draw.choice([0, 0, 1, 1, 2, 5])):
            w[draw.randrange(len(w))] = prose(draw, 1)
        if k % 3 == 0:
            new = {c: str(draw.randint(100, 999)) for c in w if c.isdigit()}
            w = [new.get(c, c) if draw.random() < 0.9 else "555" if c.isdigit() else c for c in w]
        if k % 4 == 0:
            w = w[draw.randint(0, len(w) // 2) :]
        if k % 7 == 0:
            w.insert(len(w) // 2, prose(draw, 9))
        docs.append((k // 2 if k % 10 == 0 else k, f"{prose(draw, 15)} {' '.join(w)} {prose(draw, 15)}"))
    docs += [(500 + k, " ".join(str(draw.randint(0, 99)) for _ in range(30))) for k in range(10)]
    from collections import Counter

    want = Counter((d, i) for d, t in docs for i, x in items if leaks_by_hand(t, x))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == want
    # The same by a shuffle of windows, as beyond the bound of what is broadcast.
    again = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert len(want) > 60 and any(r.kind == "reparameterised" for r in got) and not any(d >= 500 for d, _ in want)


def test_leaks_with_one_edit_or_in_part(spark):
    draw = random.Random(8)
    short, long = prose(draw, 15).split(), prose(draw, 59).split()
    edits = [(k, " ".join([prose(draw, 10), *short[:k], "zzz", *short[k + 1 :], prose(draw, 10)])) for k in range(15)]
    parts = [(100 + k, " ".join([prose(draw, 10), *long[k : k + 32], prose(draw, 10)])) for k in (0, 10, 27)]
    docs = spark.createDataFrame([*edits, *parts, (200, "x\nTwo Words!\ny"), (201, "these two words here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long)), (3, "two words"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(k, 1) for k in range(15)} | {(100, 2), (110, 2), (127, 2), (200, 3)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {201}


def changed(words, at):
    return " ".join("zz" + "abcdefghij"[k % 10] if k in at else w for k, w in enumerate(words))


def test_changed_words_are_found_wherever_they_stand(spark):
    """As many words as n > 4 * e + 3 allows, spread evenly or at random: all found."""
    draw = random.Random(12)
    items, docs = [], []
    for i, (n, e) in enumerate([(9, 1), (14, 2), (30, 3), (30, 6), (40, 5), (40, 9), (60, 14)]):
        item = prose(draw, n).split()
        items.append((i, " ".join(item)))
        even = {(k + 1) * (n + 1) // (e + 1) - 1 for k in range(e)}
        for at in [even, *(set(draw.sample(range(n), e)) for _ in range(12))]:
            docs.append((1000 * i + len(docs), f"{prose(draw, 12)} {changed(item, at)} {prose(draw, 12)}"))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(k, k // 1000) for k, _ in docs}


def test_a_form_that_all_items_share_names_no_candidates(spark):
    draw = random.Random(13)
    form = prose(draw, 16)
    items = [(i, f"{form} {prose(draw, 24)}") for i in range(100)] + [(500 + i, form) for i in range(2)]
    docs = [(i, f"{prose(draw, 20)} {form} {prose(draw, 20)}") for i in range(40)] + [(90, f"x {items[7][1]} y"), (91, f"{form} {prose(draw, 3)} {' '.join(items[8][1].split()[17:])}")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    texts = tuple(t for _, t in items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(*frames).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if leaks_by_hand(t, x, texts)}
    assert {(90, 7), (91, 8)} <= got and {(d, i) for d, i in got if i < 500} == {(90, 7), (91, 8)}
    lined = decontaminate.alignments(frames[0], decontaminate.seeds(decontaminate.tokens(frames[1], "item_id", decontaminate.ITEM).dropDuplicates(decontaminate.ITEM)))
    assert lined.where("item_id < 500").count() <= 2 * len(docs)


def test_clean_tells_rows_of_one_id_apart(spark):
    draw = random.Random(9)
    item = prose(draw, 30)
    docs = spark.createDataFrame([(1, item, "a"), (1, "other text", "b"), (None, item, "c")], "doc_id long, text string, __id string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {tuple(r) for r in decontaminate.clean(docs, bench).collect()} == {(1, "other text", "b"), (None, item, "c")}


def test_words_are_split_at_runs_of_other_characters(spark):
    texts = {1: "Ab, Cd  12km (x)", 2: "a . b", 3: "\n\n12", 4: "!?x", 5: " . ", 6: "", 7: None, 8: "\t"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.raw, r.canon) for r in decontaminate.tokens(docs, "doc_id", decontaminate.DOC).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == (["ab", "\x02cd", "12", "km", "x"], ["ab", "\x01name", "\x01num", "\x01unit", "x"])
    assert got[2] == (["a", "b"], ["a", "b"]) and got[3] == (["12"], ["\x01num"]) and got[4] == (["x"], ["x"])


def test_common_forms_lose_no_leak(spark):
    """Leaks by windows that more than COMMON items share: by 20 words in a row, by the share of the item, by a few
    more words beside a form, by two forms at different distances; against every alignment compared by hand."""
    draw = random.Random(21)
    long, half, one, two = prose(draw, 24), prose(draw, 16), prose(draw, 10), prose(draw, 11)
    items = [(i, f"{long} {prose(draw, 30)}") for i in range(40)] + [(100 + i, f"{half} {prose(draw, 24)}") for i in range(40)]
    items += [(200 + i, f"{one} {prose(draw, 6)} {two} {prose(draw, 6)}") for i in range(40)] + [(300 + i, f"{one} {prose(draw, 6)}") for i in range(40)]
    own = [t.split() for _, t in items]
    docs = [f"{prose(draw, 9)} {long} {prose(draw, 40)}", f"{prose(draw, 9)} {half} {prose(draw, 40)}", f"{two} {prose(draw, 3)} {one} {prose(draw, 40)}"]
    for k in (41, 50, 60, 125, 130):
        docs += [" ".join(w if p < 16 or p % (2 + j) else prose(draw, 1) for p, w in enumerate(own[k])) for j in range(2)]
    rows = list(enumerate(docs))
    want = {(d, i) for d, t in rows for i, x in items if leaks_by_hand(t, x)}
    hidden = want - {(d, i) for d, t in rows for i, x in items if leaks_by_hand(t, x, tuple(t for _, t in items))}
    assert {(0, i) for i in range(40)} <= hidden and {(2, 200 + i) for i in range(40)} <= hidden and any(100 <= i < 200 for _, i in hidden)
    assert not any(d == 1 and 100 <= i < 200 for d, i in want)
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.longest_run for r in got if r.doc_id == 0 and r.item_id < 40} == {24}
    again = decontaminate.leaks(*frames, most=0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_repeated_windows_of_an_item_count_at_each_place(spark):
    """The second place of a window is the only one by which the copy is aligned."""
    again = "ka ro mi te"
    item = f"{again} su ne lo pa {again} " + " ".join(f"w{'abcdefgh'[k]}x" for k in range(8))
    doc = f"zz {again} " + " ".join(f"w{'abcdefgh'[k]}x" if k % 4 != 3 else "qq" for k in range(8))
    docs = spark.createDataFrame([(1, "su ne lo zz " + doc[3:].replace("wcx", "rr")), (2, "su ne lo " + doc)], "doc_id long, text string")
    lined = decontaminate.alignments(docs, decontaminate.seeds(decontaminate.tokens(spark.createDataFrame([(1, item)], "item_id long, text string"), "item_id", decontaminate.ITEM)))
    assert {(r.doc_id, r.offset) for r in lined.collect()} >= {(1, 4), (1, -4), (2, 4), (2, -4)}


def families_by_hand(texts):
    """Components of all pairs of masked lines of one leaf that agree, as sets of lines."""
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for a in texts:
        for b in texts:
            x, y = a.split(), b.split()
            if len(x) == len(y) and x[: line_dedup.DEPTH] == y[: line_dedup.DEPTH] and sum(map(str.__eq__, x, y)) >= line_dedup.SIMILAR * len(x):
                up[root(a)] = root(b)
    found = {}
    for t in texts:
        found.setdefault(root(t), set()).add(t)
    return {frozenset(f) for f in found.values() if len(f) > 1}


def linked_families(spark, texts):
    from pyspark.sql import functions as F

    from replicalog.llm.graph import components

    lines = spark.createDataFrame([(t, 1 + len(texts) - k) for k, t in enumerate(texts)], "m string, docs long")
    distinct = lines.selectExpr(f"{line_dedup._HEAD} AS leaf", "xxhash64(m) AS mh", f"{line_dedup._COUNT} AS n", "docs", "m")
    links = components(line_dedup._links(distinct)).join(distinct, F.col("node") == F.col("mh"))
    return {frozenset(r.f) for r in links.groupBy("root").agg(F.collect_set("m").alias("f")).collect()}


def test_no_link_is_lost_to_heavier_lines(spark):
    """Heavier lines that share parts of two lines head all that these have in common; random families with shared words."""
    w = [f"w{chr(97 + k)}" for k in range(17)]
    a, b = list(w), list(w)
    a[3], b[4] = "ax", "bx"
    heavy = []
    for k in range(14):  # each shares a few places with both lines, and all places are shared with some
        h = [x if p < 3 or (p - 3 - k) % 14 < 6 else f"h{chr(97 + k)}{chr(97 + p)}" for p, x in enumerate(w)]
        heavy.append(" ".join(h))
    texts = [*heavy, " ".join(a), " ".join(b)]
    want = families_by_hand(texts)
    assert frozenset(texts[-2:]) in want or any(set(texts[-2:]) <= f for f in want)
    assert linked_families(spark, texts) == want
    draw = random.Random(31)
    texts = []
    while len(texts) < 220:
        x = draw.choice(texts).split() if texts and draw.random() < 0.8 else ["at", "this", "place", *(draw.choice("abcdefgh") for _ in range(draw.choice([1, 2, 5, 7, 9, 12])))]
        for _ in range(draw.randint(1, 4)):
            x[draw.randrange(3, len(x))] = draw.choice("abcdefghijklmnop")
        if " ".join(x) not in texts:
            texts.append(" ".join(x))
    want = families_by_hand(texts)
    assert len(want) > 3 and linked_families(spark, texts) == want


def test_the_pipeline_drops_what_a_common_form_leaks(spark, tmp_path):
    """Its decontamination stage finds a document that holds no more than a form that all items share."""
    from replicalog.llm import stages

    draw = random.Random(41)
    form = prose(draw, 24)
    items = [(i, f"{form} {prose(draw, 30)}") for i in range(40)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"{prose(draw, 9)} {form} {prose(draw, 9)}"), (2, prose(draw, 40))], "doc_id long, text string")
    assert [r.doc_id for r in stages.decontamination(spark, docs, str(tmp_path)).collect()] == [2]


def test_rounds_over_few_lines_make_few_tasks(spark):
    """However many partitions a shuffle has: what a round stores has as many as its rows are worth."""
    from replicalog.llm import common, graph

    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
        assert graph.components(edges).rdd.getNumPartitions() <= 3 * common.LEAST_PARTS
        text = [" ".join(["at", "this", "place", *(x if k != j else f"n{chr(97 + j)}" for j, x in enumerate("abcdefgh"))]) for k in range(8)]
        lines = spark.createDataFrame([(t, 1 + k) for k, t in enumerate(text)], "m string, docs long")
        distinct = lines.selectExpr(f"{line_dedup._HEAD} AS leaf", "xxhash64(m) AS mh", f"{line_dedup._COUNT} AS n", "docs", "m")
        taken = line_dedup._general(distinct)
        assert taken.count() == 8 and taken.rdd.getNumPartitions() <= 2 * common.LEAST_PARTS
        assert common.packed(spark.range(0, 10, 1, 61), 20 * common.PART_ROWS).rdd.getNumPartitions() == 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def general_by_hand(docs):
    """Lines (m: docs, all of one leaf) to the general template that takes them in, by the words of whole families."""
    agree = lambda x, y: sum(map(str.__eq__, x.split(), y.split())) >= line_dedup.SIMILAR * len(x.split())
    rest, taken = dict(docs), {}
    while families := families_by_hand(rest):
        left = {}
        for family in families:
            total, general = sum(rest[t] for t in family), []
            for place in zip(*(t.split() for t in family), strict=True):
                held = {}
                for t, w in zip(family, place, strict=True):
                    held[w] = held.get(w, 0) + rest[t]
                general.append(max(held, key=held.get) if 2 * max(held.values()) > total else "<*>")
            first = max(family, key=lambda t: rest[t])
            named = sum(agree(t, " ".join(general)) for t in family) > 1
            form = " ".join(general) if named else first
            taken |= {t: form for t in family if agree(t, form)}
            left |= {t: rest[t] for t in family if not agree(t, form)}
        rest = left
    return taken


def test_general_templates_are_those_of_whole_families(spark, monkeypatch):
    """Also where the heaviest line is masked, where another word than its own prevails, and with nothing broadcast or each leaf large."""
    from pyspark.sql import functions as F

    draw = random.Random(47)
    docs = {}
    for base in (["<*>" if k % 4 == 3 else f"b{chr(97 + k)}" for k in range(14)], [f"c{chr(97 + k)}" for k in range(9)], [f"d{chr(97 + k)}" for k in range(11)]):
        for k in range(24 if len(base) != 11 else 5):
            x = [w if p < 3 or draw.random() < 0.8 else draw.choice(["<*>", "y", "z"]) for p, w in enumerate(["at", "this", "place", *base])]
            docs.setdefault(" ".join(x), 1 + 7 * k)
    body = [f"e{chr(97 + k)}" for k in range(7)]
    docs[" ".join(["at", "this", "place", "<*>", *body])] = 1000
    docs |= {" ".join(["at", "this", "place", w, *body]): 900 for w in "qrst"}
    edge = " ".join(["at", "this", "place", "<*>", *body[:4], "x", "x", "x"])  # as much as a line may differ from the form, masked where that is
    docs[edge] = 1
    lines = spark.createDataFrame(list(docs.items()), "m string, docs long")
    distinct = lines.selectExpr(f"{line_dedup._HEAD} AS leaf", "xxhash64(m) AS mh", f"{line_dedup._COUNT} AS n", "docs", "m")
    forms = general_by_hand(docs)
    assert len(set(forms.values())) > 3 and edge in forms and any("<*>" in f for f in forms.values())
    want = spark.createDataFrame(list(forms.items()), "m string, general string").select(F.xxhash64("m").alias("mh"), F.xxhash64(F.expr(line_dedup._HEAD), "general").alias("template"))
    want = {tuple(r) for r in want.collect()}
    for small, most in ((line_dedup.SMALL_LEAF, None), (100, None), (0, 0)):
        monkeypatch.setattr(line_dedup, "SMALL_LEAF", small)
        if most is not None:
            monkeypatch.setattr(line_dedup, "FEW_KEYS", most)
            monkeypatch.setattr(line_dedup, "FEW_LINES", most)
        assert {(r.mh, r.template) for r in line_dedup._general(distinct).collect()} == want


def test_small_leaves_shuffle_no_words_and_templates_are_broadcast_whole(spark, monkeypatch):
    """Two copies with an edit are compared as texts, and a template is looked up in one row, not in one for each salt."""
    draw = random.Random(53)
    rows = []
    for i in range(40):
        words = [f"{w}{chr(97 + i % 26)}" for w in prose(draw, 60).split()]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:30], "zz", *words[31:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 200)
    exploded, real = [], line_dedup.F.posexplode
    monkeypatch.setattr(line_dedup.F, "posexplode", lambda c: exploded.append(c) or real(c))
    found = line_dedup.templates(docs, line_dedup.keyed(docs))
    assert not exploded
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert {(r.n_docs, r.first_doc % 2) for r in found.collect()} == {(2, 0)} and found.count() == 80


def test_families_by_words_also_where_all_could_be_compared(spark, monkeypatch):
    """Few lines are compared each with each; that the search by rare words finds the same stays tested."""
    by_words, real = [], line_dedup._links_by_words
    monkeypatch.setattr(line_dedup, "_links_by_words", lambda d: by_words.append(d) or real(d))
    monkeypatch.setattr(line_dedup, "FEW_COMPARED", 0)
    test_no_link_is_lost_to_heavier_lines(spark)
    test_general_templates_are_those_of_whole_families(spark, monkeypatch)
    assert by_words


def leaf_of_two_rounds(spark):
    """Lines of one leaf, some of which no general template takes in at first."""
    base = [f"b{chr(97 + k)}" for k in range(10)]
    texts = [" ".join(["at", "this", "place", *(w if (p + k) % 11 else f"o{chr(97 + k)}" for p, w in enumerate(base))]) for k in range(12)]
    far = [w if p > 2 else f"far{chr(97 + p)}" for p, w in enumerate(base)]
    texts += [" ".join(["at", "this", "place", *far[:7], x, *far[8:9], y]) for x in "uv" for y in "st"]
    lines = spark.createDataFrame([(t, 40 - k) for k, t in enumerate(texts)], "m string, docs long")
    return lines.selectExpr(f"{line_dedup._HEAD} AS leaf", "xxhash64(m) AS mh", f"{line_dedup._COUNT} AS n", "docs", "m")


def test_rounds_over_few_lines_broadcast_nothing(spark, monkeypatch):
    """What fits one partition is joined there: no table is built in the driver for it."""
    from replicalog.llm import graph

    sent, real = [], line_dedup.F.broadcast
    distinct = leaf_of_two_rounds(spark)
    monkeypatch.setattr(line_dedup.F, "broadcast", lambda d: sent.append(d.columns) or real(d))
    assert line_dedup._general(distinct).count() == distinct.count()
    assert graph.components(spark.range(40).selectExpr("id AS a", "id + 1 AS b")).count() == 41
    assert not sent


def test_text_is_broadcast_up_to_a_bound_in_bytes(spark, monkeypatch):
    """A few lines may be of megabytes: beyond the bound no frame with their text or their words' places is broadcast, and the result is the same."""
    from replicalog.llm import common

    distinct = leaf_of_two_rounds(spark)
    want = {tuple(r) for r in line_dedup._general(distinct).collect()}
    sent, real = [], line_dedup.F.broadcast
    monkeypatch.setattr(line_dedup.F, "broadcast", lambda d: sent.append(set(d.columns)) or real(d))
    monkeypatch.setattr(common, "PART_ROWS", 10)
    monkeypatch.setattr(line_dedup, "FEW_BYTES", 100, raising=False)
    for compared in (line_dedup.FEW_COMPARED, 0) if hasattr(line_dedup, "FEW_COMPARED") else (0,):
        monkeypatch.setattr(line_dedup, "FEW_COMPARED", compared, raising=False)
        assert {tuple(r) for r in line_dedup._general(distinct).collect()} == want
    assert sent and not any({"mh", "m"} <= c or {"q", "first"} <= c or {"r", "c"} <= c or {"r", "g"} <= c for c in sent)


def test_ids_of_documents_are_broadcast_beyond_the_bound_of_templates(spark, monkeypatch):
    """Also with null ids, and with not even ids broadcast, the lines dropped are the same."""
    draw = random.Random(59)
    lines = [prose(draw, 14) for _ in range(6)]
    edited = [" ".join([*x.split()[:9], "zz", *x.split()[10:]]) for x in lines]
    rows = [(i, f"{x}\n{prose(draw, 9)}") for i, x in enumerate(lines)] + [(10 + i, x) for i, x in enumerate(edited)]
    for more in ([], [(None, "nobody has\nthis line of some nine words or so here now"), (None, "this line of some nine words or so here then")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        want = {tuple(r) for r in line_dedup.dropped(docs).collect()}
        assert {r[0] for r in want} >= {10 + i for i in range(6)}
        with monkeypatch.context() as patch:
            patch.setattr(line_dedup, "MAX_BROADCAST", 0)
            sent, real = [], line_dedup.F.broadcast
            patch.setattr(line_dedup.F, "broadcast", lambda d: sent.append(d.columns) or real(d))  # noqa: B023
            assert {tuple(r) for r in line_dedup.dropped(docs).collect()} == want
            assert (["holder"] in sent) == (not more)
            patch.setattr(line_dedup, "MOST_IDS", 0)
            assert {tuple(r) for r in line_dedup.dropped(docs).collect()} == want


def test_the_pipelines_lost_lines_are_broadcast_by_the_size_of_their_table(spark, monkeypatch):
    """Its stage lines sends a row for each document: many lines of few documents need no shuffle of all texts, very many are not broadcast."""
    from replicalog.llm import stages

    draw = random.Random(61)
    text = "\n".join(prose(draw, 9) for _ in range(24))
    docs = spark.createDataFrame([(i, text if i < 3 else prose(draw, 12), 0) for i in range(5)], "doc_id long, text string, n_chars long")
    sent, real = [], line_dedup.F.broadcast
    monkeypatch.setattr(line_dedup.F, "broadcast", lambda d: sent.extend(c for c in d.columns if c.endswith("_gone")) or real(d))
    for most, few in ((10, True), (7, False)):
        monkeypatch.setattr(line_dedup, "MAX_BROADCAST", most)
        sent.clear()
        assert sorted(r.doc_id for r in stages.lines(spark, docs, "").collect()) == [0, 3, 4]
        assert bool(sent) == few
