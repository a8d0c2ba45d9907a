r"""Personal data by weak supervision, in built-in functions only.

Base spans come from four fixed patterns with their checks and always stay. Looser patterns give candidates
(written-out addresses, numbers without a country code, dotted card numbers, IPv6, account numbers, secrets). Base
spans and candidates go to labelers: a checksum or shape test, gazetteers, words of the context, and regular grouping.
Each votes 1, -1 or 0. One aggregate over the whole corpus counts vote patterns together with patterns of the
span's features (its length, shares of digits and separators, the characters around it), all of them of a few values,
so that their number is bounded. Expectation-maximisation over the votes estimates each labeler's reliability; a
logistic span classifier over the features is trained on its posteriors, and is evaluated as a column expression
where the spans are found. Candidates that it accepts and that touch no span taken before are added.

Patterns with repeated groups use possessive forms that match the same spans without
recursion, so that very long digit runs are safe; places of spans come from sums over blocks of matches, so that texts
full of matches are too. Nothing but the counts is shuffled.

Defined cases: null text is empty; texts without spans give zeros, the hash of the empty
string and empty ``spans``; of candidates that overlap, the one of the kind listed first stays; rows are handled one by
one, so repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: In spans the kinds that only the method finds come last.
KINDS = (*BASE_KINDS, "iban", "secret")

#: Base patterns. A card run of 16 to 19 digits is one whose greedy leftmost run has that many.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT)\x20?[\])}])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9._/-])(?:[0-9]{4}[._/]){3}[0-9]{4}(?![0-9._/-])",
    "phone": r"(?<![0-9+(._/-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9._/-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}",
}
#: Gazetteers: endings of domains, first digits of cards, reserved first parts of addresses.
DOMAINS = "com net org edu gov mil int info biz io co uk de fr es it nl eu ch at be us ca au in jp cn br ru"
CUES = {
    "email": ("mail|contact|write|reach|address", "example only|regex"),
    "ip": ("ip|host|server|address|from|login", "version|release|section|build"),
    "card": ("card|visa|master|amex|pay|credit|iban", "isbn|order|token|key|serial|sha"),
    "phone": ("tel|phone|call|fax|mobile|whatsapp|reach", "isbn|order|version|serial|score"),
    "iban": ("iban|account|konto|compte|cuenta|bank|transfer", "isbn|order|version|serial"),
    "secret": ("token|secret|passw|passphrase|pwd|credential|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer", "sha1|sha256|md5|checksum|digest|commit|revision|uuid|guid|href|src|path"),
}
VOTES = ("v_shape", "v_gazetteer", "v_context", "v_grouping")
#: Features of a span, and how many values each has.
FEATURES = {"f_length": 6, "f_digits": 5, "f_separators": 4, "f_before": 5, "f_after": 4, "f_strict": 2}
CONTEXT = 30
#: Spans whose places are summed up in one go; longer lists go block by block.
RUN = 256


def _spans(text: str, pattern: str) -> str:
    """SQL for array<struct<s, e, m>>: the spans' places in code points, from the gaps between the matches."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    gaps, found = f"split({text}, '{p}', -1)", f"regexp_extract_all({text}, '{p}', 0)"
    start = "CAST(struct(0 AS at, array() AS out) AS struct<at: int, out: array<struct<s: int, e: int, m: string>>>)"
    step = "struct(a.at + x.g + coalesce(length(x.m), 0) AS at, CASE WHEN x.m IS NULL THEN a.out ELSE array_append(a.out, struct(a.at + x.g AS s, a.at + x.g + length(x.m) AS e, x.m AS m)) END AS out)"
    zipped = f"transform(arrays_zip({found}, {gaps}), z -> struct(z['0'] AS m, length(z['1']) AS g))"
    summed = lambda part, result: f"aggregate({part}, {start}, (a, x) -> {step}, a -> {result})"
    blocks = f"transform(sequence(0, (size(z) - 1) div {RUN}), k -> {summed(f'slice(z, k * {RUN} + 1, {RUN})', 'a')})"
    begins = "aggregate(b, CAST(struct(0 AS at, array() AS out) AS struct<at: int, out: array<int>>), (a, x) -> struct(a.at + x.at AS at, array_append(a.out, a.at) AS out), a -> a.out)"
    moved = "flatten(transform(b, (x, k) -> transform(x.out, y -> struct(y.s + o[k] AS s, y.e + o[k] AS e, y.m AS m))))"
    long = f"transform(array({blocks}), b -> transform(array({begins}), o -> {moved})[0])[0]"
    # One-element arrays give names to values that are used more than once.
    return f"transform(array({zipped}), z -> IF(size(z) <= {RUN}, {summed('z', 'a.out')}, {long}))[0]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: (lambda x: F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x))(F.substring(d, i, F.lit(1)).cast("int")))
    return (F.length(d) > 0) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _octets(m: Column) -> Column:
    return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")


def _mod97(m: Column) -> Column:
    """The check of account numbers: letters as 10 to 35, the first four characters last."""
    c = F.regexp_replace(m, "[^A-Z0-9]", "")
    c = F.concat(F.substring(c, 5, 1 << 20), F.substring(c, 1, 4))
    each = F.transform(F.split(c, ""), lambda x: F.when(x.rlike("[A-Z]"), F.ascii(x) - 55).otherwise(x.cast("int")))
    rest = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97)
    return rest == 1


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
SHAPES = {
    "email": lambda m: m.rlike(r"[A-Za-z]{2,24}$"),
    "ip": lambda m: _octets(m) | m.contains(":"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "iban": _mod97,
    # Many different characters, as in what is drawn at random.
    "secret": lambda m: F.size(F.array_distinct(F.split(m, ""))) >= F.least(F.length(m) / 2, F.lit(9)),
}
GAZETTEERS = {
    "email": lambda m: m.rlike(r"(?i)(?:" + DOMAINS.replace(" ", "|") + r")$"),
    "ip": lambda m: ~m.rlike(r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\."),
    "card": lambda m: m.rlike(r"^[3-6]"),
    "phone": lambda m: ~m.rlike(r"^\+?[\x20(]*0"),
    "iban": lambda m: m.rlike("^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|TR)"),
    # Starts of well-known kinds of keys, and lengths of random hex.
    "secret": lambda m: m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk[-_]|xox[abprs]-|eyJ|AIza|ya29|npm_|SG\.)") | m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64})$"),
}
GROUPINGS = {
    "email": lambda m: ~m.rlike(r"\.\.|^[.-]"),
    "ip": lambda m: ~m.rlike(r"(?:^|\.)0[0-9]"),
    "card": lambda m: m.rlike(r"^(?:[0-9]{16,19}|(?:[0-9]{4}[^0-9]){3}[0-9]{4,7})$"),
    "phone": lambda m: ~m.rlike(r"(?:[^0-9][0-9]){4}|[\x20().-]{4}"),
    "iban": lambda m: m.rlike(r"^(?:[A-Z0-9]+|(?:[A-Z0-9]{4}\x20)+[A-Z0-9]{1,4})$"),
    "secret": lambda m: ~m.rlike(r"/.*/|[_-].*[_-].*[_-].*[_-]|^[a-z]+[0-9]{1,6}$|^[0-9]+[a-z]{1,3}$"),
}


def _checked(kind: str) -> Column:
    return F.filter(f"base_{kind}", lambda x: CHECKS[kind](x["m"]))


def _coded(kind: str) -> Column:
    return F.transform(f"base_{kind}", lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _features(kind: str, x: Column, strict: int) -> dict[str, Column]:
    """Small integers that describe a span by itself and by the characters beside it."""
    m, n = x["m"], F.length(x["m"])
    share = lambda pattern, parts: F.floor(F.regexp_count(m, F.lit(pattern)) * parts / n).cast("int")
    beside = lambda at: F.when(at < 1, "").otherwise(F.substring("t", at, F.lit(1)))
    before, after = beside(x["s"]), beside(x["e"] + 1)
    code = lambda c, *classes: F.coalesce(*[F.when(c.rlike(p) if p else c == "", i) for i, p in enumerate(classes)], F.lit(len(classes)))
    return {
        "f_length": F.least(F.floor(n / 8), F.lit(5)).cast("int"),
        "f_digits": F.least(share("[0-9]", 5), F.lit(4)),
        "f_separators": F.least(F.regexp_count(m, F.lit("[^A-Za-z0-9]")), F.lit(3)).cast("int"),
        "f_before": code(before, "", r"[\x20\x09-\x0D]", "[=:]", "[\"'`(<\\[]"),
        "f_after": code(after, "", r"[\x20\x09-\x0D]", "[\"'`)>\\].,;!?]"),
        "f_strict": F.lit(strict),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, for each base kind base_<kind>, and c: array of spans with their votes and features."""
    d = docs.select("doc_id", text_of().alias("t"))
    has = lambda p: F.col("t").rlike(p)
    near = {"email": F.expr("t LIKE '%@%'"), "ip": has(r"[0-9]\.[0-9]"), "card": has("[0-9]"), "phone": F.col("t").contains("+")}
    loose_near = {
        "email": has(r"[\[({]\x20?(?:at|AT)\x20?[\])}]"), "ip": has("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "card": has(r"[0-9]{4}[._/][0-9]{4}"), "phone": has(r"[0-9]{3}[\x20.-][0-9]{4}"),
        "iban": has("[A-Z]{2}[0-9]{2}"), "secret": has("[0-9]") & has("[A-Za-z0-9+/_-]{16}") & has("[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9]"),
    }
    none = F.array().cast("array<struct<s: int, e: int, m: string>>")
    found = {f"base_{k}": F.when(near[k], F.expr(_spans("t", BASE[k]))).otherwise(none) for k in BASE_KINDS}
    found |= {f"loose_{k}": F.when(loose_near[k], F.expr(_spans("t", LOOSE[k]))).otherwise(none) for k in KINDS}
    d = d.select("doc_id", "t", *[c.alias(n) for n, c in found.items()])
    d = d.withColumns({f"base_{k}": _checked(k) for k in BASE_KINDS})
    place = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    d = d.withColumn("taken", F.concat(*[place(f"base_{k}") for k in BASE_KINDS]))
    vote = lambda yes: F.when(yes, 1).otherwise(-1)

    def judged(kind: str, strict: int):
        def one(x: Column) -> Column:
            before = F.lower(F.substring("t", F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT))))
            yes, no = CUES[kind]
            return F.struct(
                F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), vote(SHAPES[kind](x["m"])).alias("v_shape"), vote(GAZETTEERS[kind](x["m"])).alias("v_gazetteer"),
                F.when(before.rlike(rf"(?<![a-z])(?:{yes})"), 1).when(before.rlike(rf"(?<![a-z])(?:{no})"), -1).otherwise(0).alias("v_context"), vote(GROUPINGS[kind](x["m"])).alias("v_grouping"),
                *[c.alias(n) for n, c in _features(kind, x, strict).items()],
            )

        return one

    def free(k: str) -> Column:
        sooner = [place(f"loose_{j}") for j in KINDS[: KINDS.index(k)]]
        return F.filter(f"loose_{k}", lambda x: ~F.exists(F.concat("taken", *sooner), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

    c = F.concat(*[F.transform(f"base_{k}", judged(k, 1)) for k in BASE_KINDS], *[F.transform(free(k), judged(k, 0)) for k in KINDS])
    return d.select("doc_id", *[f"base_{k}" for k in BASE_KINDS], F.when(F.size("taken") + sum(F.size(f"loose_{k}") for k in KINDS) > 0, c).alias("c"))


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Expectation-maximisation over the vote patterns of one kind: the posterior of each. ``votes``: rows of -1, 0, 1.
    A labeler's votes are independent given the class; Beta-like pseudo-counts keep it better than chance."""
    shown = np.stack([votes == x for x in (1, 0, -1)], axis=2).astype(float)  # pattern, labeler, vote
    table = np.empty((2, votes.shape[1], 3))
    table[1], table[0] = (0.8, 0.1, 0.1), (0.1, 0.1, 0.8)
    pseudo = np.array([[1.0, 1.0, 8.0], [8.0, 1.0, 1.0]])[:, None, :]
    prior, total = 0.5, count.sum()
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (shown * (np.log(table[1]) - np.log(table[0]))).sum(axis=(1, 2))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        prior = float(((count * p).sum() + 2) / (total + 4))
        weight = np.stack([np.tensordot(count * q, shown, axes=1) for q in (1 - p, p)]) + pseudo
        table = weight / weight.sum(axis=2, keepdims=True)
    return p


def classifier(features: np.ndarray, count: np.ndarray, p: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> list[np.ndarray]:
    """Logistic regression of the posteriors on the features, by Newton steps over the counted patterns: a weight for
    each value of each feature; the first list holds the constant."""
    hot = [np.ones((len(count), 1)), *(np.eye(n)[features[:, j]] for j, n in enumerate(FEATURES.values()))]
    x, cuts = np.concatenate(hot, axis=1), np.cumsum([h.shape[1] for h in hot])[:-1]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (count * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (count * (p - q)) - ridge * w)
    return np.split(w, cuts)


def learned(found: DataFrame) -> dict[str, list[np.ndarray]]:
    """Weights of the span classifier of each kind. The collected rows are patterns of votes and features, whose number
    the values of both bound."""
    names = [*VOTES, *FEATURES]
    # The outer form: from the plain one Spark infers a filter on the array, and makes it twice.
    rows = found.select(F.explode_outer("c").alias("c")).where("c IS NOT NULL").groupBy("c.kind", *[f"c.{v}" for v in names]).count().orderBy("kind", *names).collect()
    weights = {}
    for k in KINDS:
        if mine := [r for r in rows if r["kind"] == k]:
            votes, count = np.array([[r[v] for v in VOTES] for r in mine]), np.array([r["count"] for r in mine], dtype=float)
            # A pattern of votes may come with many patterns of features.
            known, which = np.unique(votes, axis=0, return_inverse=True)
            p = reliabilities(known, np.bincount(which.ravel(), weights=count))[which.ravel()]
            weights[k] = classifier(np.array([[r[f] for f in FEATURES] for r in mine]), count, p)
    return weights


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and hash of the base spans, all spans, how many were added, and whether
    any were found."""
    d = candidates(docs)
    weights = learned(d)
    none = F.array().cast("array<struct<k: int, s: int, e: int>>")

    def accepted(x: Column) -> Column:
        yes = F.lit(False)
        for k, (constant, *rest) in weights.items():
            value = lambda f, w: F.element_at(F.array(*[F.lit(float(v)) for v in w]), x[f] + 1)
            odds = F.lit(float(constant[0])) + sum(value(f, w) for f, w in zip(FEATURES, rest, strict=True))
            yes = yes | ((x["kind"] == k) & (odds >= 0))
        return yes & (x["f_strict"] == 0)

    number = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).cast("int") - 1
    base = F.concat(*map(_coded, BASE_KINDS))
    more = F.coalesce(F.transform(F.filter("c", accepted), lambda x: F.struct(number(x).alias("k"), x["s"].alias("s"), x["e"].alias("e"))), none)
    d = d.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS], base.alias("base"), more.alias("more"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    return d.select(
        "doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"),
        (F.size("base") + F.size("more") > 0).alias("found"),
    )
