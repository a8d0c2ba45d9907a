import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from replicalog.llm import alignment

from .brute import odd_docs

TEXTS = [
    "a  b", "  two  spaces ", "tab\tand\nline \n end", "ﬁ ½ é é", "<0x41> </s> <s> <|endoftext|>", "a▁b", " ", "nbsp x   y", "x  y", "\x1c \x1d a", "a ᠎b c", "日本語 テキスト", "don't we'll", "1234567 89.5 %%",
    "é 🙂🙃 👩‍👩‍👧", "\x00 \x01", "Déjà vu " * 50,
]


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(*alignment.default_paths())


def brute(own, texts):
    """Rows by doc_id, from whole texts encoded in one piece."""
    made, links = {}, Counter()
    for k, t in texts.items():
        if not t:
            continue
        a, b = own.a.encode(f" {t}", add_special_tokens=False).ids, own.b.encode(t)
        of_a, of_b = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
        if not b"".join(of_a) == b"".join(of_b) == f" {t}".encode():
            continue
        end, ends = 0, defaultdict(lambda: ([], []))
        for side, tokens in enumerate((of_a, of_b)):
            end = 0
            for n, x in enumerate(tokens):
                end += len(x)
                ends[end][side].append(n)
        cuts = sorted(e for e, (x, y) in ends.items() if x and y)
        own_links = Counter((a[i], b[j]) for e in cuts for i in ends[e][0] for j in ends[e][1])
        groups, i, j = [], 0, 0
        for e in cuts:
            x, y = max(ends[e][0]) + 1, max(ends[e][1]) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links.update(own_links)
        made[k] = (len(a), len(b), groups, own_links)
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = {}
    for k in texts:
        if k not in made:
            out[k] = (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, mine = made[k]
        out[k] = (a, b, len(groups), mine.total(), sum(n for p, n in mine.items() if links[p] == best[p[1]]), sum(n * links[p] for p, n in mine.items()), hashlib.sha256(";".join(groups).encode()).hexdigest())
    return out


def test_query_against_whole_texts(spark, own, monkeypatch):
    docs = odd_docs(spark).collect()
    known = {d.doc_id: d.text for d in docs} | {100 + i: t for i, t in enumerate(TEXTS)} | {200 + i: t for i, t in enumerate(TEXTS[:6])}
    known |= {300 + r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in known.items()], "doc_id long, text string, key string, pair int").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(df).collect()}
    want = brute(own, known)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_short_segments_and_a_small_store_change_nothing(own, monkeypatch):
    texts = [*TEXTS, " ".join(TEXTS), "word " * 300]
    whole = list(own.measures(texts))
    monkeypatch.setattr(alignment, "SEGMENT", 5)
    monkeypatch.setattr(alignment, "KEPT_WORDS", 3)
    own.words = ({}, {})
    assert list(own.measures(texts)) == whole


def test_repeats_count_each_and_null_ids_pass(spark, own):
    known = {1: "the cat sat", 2: "the cat sat", 3: "the hat"}
    df = spark.createDataFrame([(1, "the cat sat"), (None, "the cat sat"), (3, "the hat")], "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in alignment.align(df).collect()}
    want = brute(own, known)
    assert got == {1: want[1], None: want[2], 3: want[3]}
    assert alignment.align(df.limit(0)).collect() == []


def test_vocabularies_bound_the_pairs(spark, own):
    assert 100_000 < own.most_pairs() < 600_000
    n = len(own.bytes_b)
    for *_, pairs in own.measures(TEXTS):
        for p in np.frombuffer(pairs, np.int32).tolist():
            a, b = own.bytes_a[p // n], own.bytes_b[p % n]
            assert a.endswith(b) or b.endswith(a)
