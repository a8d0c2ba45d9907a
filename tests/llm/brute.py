"""Plain Python versions of the operators' contracts, and fixtures of odd rows."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD_TEXTS = [
    None, "", " \t\n", "a", "one two three four", "a b c a b c a b c", "x y\n\nx y\n \nx y\n", "É é ß İK ſ 中文 \x00\x1f ok\x0bvt\x0cff",
    "# * $ % & | < >" * 9, "the MIT License. The mit-license; CC BY-NC 4.0 Apache  License", "GNU General\nPublic License, version 3. GNU General Public Licenses",
    "mail a.b+c@x-y.co.uk_d@e.f and 1.2.3.4.5.6.7.8 256.1.1.1 000.1.2.3 +1 (578) 555-6437 4111 1111 1111 1111 4111111111111112 00000000000000000000",
    "word " * 6000, "1-" * 5000, "all rights reserved", "naïve space a b", "don't  you'll  <|endoftext|> x<|endoftext|>\n\n  y   ",
]


def odd_docs(spark):
    """Nulls in every column, repeated rows, ties, empty and long texts, an extra column."""
    rows = [(i, t, None if i % 3 else "en", f"src{i % 2}" if i % 4 else None, None if t is None else len(t), "extra") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, w string")


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    r = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, r, len(w) < 50 or 100 * r > 50 * len(w)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    at = [(i, label) for i in range(len(w)) for p, label in PHRASES.items() if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def shingle_sets(text):
    w = WORD.findall((text or "").translate(AZ))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def components(texts, percent=80):
    """Smallest id reachable by links, for every id."""
    sets = {i: shingle_sets(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = Counter((a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    spans = [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [sum(s[0] == k for s in spans) for k, _, _ in kinds], hashlib.sha256(joined.encode()).hexdigest(), joined
