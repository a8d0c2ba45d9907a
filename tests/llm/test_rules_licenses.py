import pytest

from replicalog.llm import license_scan, quality_rules

from . import brute


def test_quality_rules_against_brute_force(spark):
    rows = quality_rules.score(brute.odd_docs(spark)).collect()
    assert len(rows) == len(brute.ODD_TEXTS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(brute.ODD_TEXTS[r.doc_id]), r
        assert not (r.base_failed and r.kept)


def test_quality_rules_keep_prose_and_drop_symbols(spark):
    import random

    draw = random.Random(5)
    prose = "\n".join(" ".join(["The", *draw.choices("river town wide people bridge of and with to is stone water light road hill".split(), k=14)]) + "." for _ in range(9))
    rows = [(1, prose), (2, prose.replace(" ", "### ")), (3, prose.upper())]
    got = {r.doc_id: r for r in quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept
    assert "symbols_per_word" in got[2].failed_rules and "upper_words" in got[3].failed_rules


def test_license_base_against_brute_force(spark):
    docs = brute.odd_docs(spark)
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(brute.ODD_TEXTS)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(brute.ODD_TEXTS[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_templates_need_their_key_phrases(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    filler = [(i, f"plain words number {i} about rivers and towns of the land") for i in range(10, 40)]
    rows = [(1, "intro words. " + grant), (2, "any person may copy files free of charge"), (3, "All rights\nreserved.")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows + filler, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score > 0.5
    assert got[2].labels == "" and got[3].labels == "reserved"
    assert all(got[i].labels == "" for i, _ in filler)


def test_license_notices_together_and_hot_notice(spark):
    """Every pair of notices in one file; all words of one notice stand in a third of the files."""
    notices = {label: text for label, text, _ in license_scan.TEMPLATES if label in ("mit", "bsd", "mpl", "cc-by", "apache")}
    pairs = [(a, b) for a in notices for b in notices if a < b]
    rows = [(i, f"intro words {notices[a]} some words between {notices[b]} the end") for i, (a, b) in enumerate(pairs)]
    rows += [(100 + i, f"file {i} of a hot source. {notices['bsd']} and more") for i in range(40)]
    rows += [(200 + i, f"plain words number {i} about rivers and towns of the land") for i in range(60)]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(set(pair) <= set(got[i].split(",")) for i, pair in enumerate(pairs)), [(pair, got[i]) for i, pair in enumerate(pairs)]
    assert all(got[100 + i] == "bsd" for i in range(40)) and all(got[200 + i] == "" for i in range(60))


@pytest.mark.parametrize("op", [quality_rules.score, license_scan.scan])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_labels_against_brute_force(spark):
    """Notices cut, edited, repeated, mixed; rows that share a doc_id; one label in two fifths of the files."""
    import random
    import re
    from collections import Counter

    draw = random.Random(21)
    word = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
    texts = []
    for i in range(120):
        parts = []
        for _ in range(draw.randint(0, 3)):
            w = (license_scan.TEMPLATES[9] if i % 5 < 2 else draw.choice(license_scan.TEMPLATES))[1].split()
            w = w[: draw.randint(len(w) // 2, len(w))]
            if draw.random() < 0.4:
                w[draw.randrange(len(w))] = "other"
            parts.append(" ".join(w))
        texts.append(" river stone\n".join(["Some words", *parts, "and the rest"]))
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    files = [word(t) for _, t in rows]
    frequency = Counter(w for f in files for w in set(f))

    def labels(f):
        got = {x for x in license_base_labels(f) if x}
        for label, text, keys in license_scan.TEMPLATES:
            template = word(text)
            if not all(f" {k} " in f" {' '.join(f)} " for k in keys):
                continue
            top = sorted(set(template) & set(f), key=lambda w: (frequency[w], w))[: license_scan.RAREST]
            at = Counter()
            for offset, _ in {(i - p, w) for i, w in enumerate(f) if w in top for p, x in enumerate(template) if x == w}:
                at[offset] += 1
            if at and max(at.values()) >= license_scan.SUPPORT * len(top):
                got.add(label)
        return ",".join(sorted(got))

    def license_base_labels(f):
        return [v for k, v in license_scan.PHRASES.items() if f" {k} " in f" {' '.join(f)} "]

    want = Counter((i, labels(f)) for (i, _), f in zip(rows, files, strict=True))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.labels) for r in got) == want and len({x for _, x in want}) > 8
