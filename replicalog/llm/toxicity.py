"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: a word or word start that occurs almost only in
toxic documents of the training sample, and between various neighbours (copies of one document share
theirs), marks its tokens there. Over sentences of the sample, a chain with
two states, word and affix features and transition weights is fitted to those labels by its
conditional likelihood. Forward-backward marginals over each sentence of a whole text then give the
offending tokens with their places; a logistic fit on a part of the sample kept back for it turns the
largest marginals and the expected number of toxic tokens into a document's score.

A sentence ends with a full stop, ! or ?, and after ``LONGEST`` words at the latest, in training as in scoring; so
memory is bounded however long a text runs on. Where the fitted states attract each other, a sentence in which no
word's weight exceeds ``quiet`` can hold no marginal above ``FLOOR``, as a chain of that constant weight bounds it. Such
sentences are passed over with marginals of 0.

The sample is bounded in rows and text, the model in features; both are broadcast. Documents pass through
one Arrow map: no shuffle. Word weights are kept in a dictionary of at most ``KEPT_WORDS`` words.

Defined cases: null or empty texts get the score of a text without toxic tokens; without labelled
rows of both classes every score is 0.5 (predicted 0); repeated rows give repeated results; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released_after, text_of
from .labelled import held_out, sample

PER_CLASS = 2000
MOST_CHARS = 20_000
#: A feature marks tokens if toxic documents hold it so many times as often as others, and if it stands in toxic documents
#: between so many pairs of neighbours that, of all features, less than exp(-SURE) should do so by chance.
LEAST_PLACES, RATIO, SURE = 5, 10.0, 4.0
#: Training sentences of each kind at most, chosen by even steps; words of a sentence, and padded words handled at once.
SENTENCES, LONGEST, AT_ONCE = 12_000, 60, 1_000_000
ROUNDS, PENALTY = 60, 0.05
FLOOR = 0.01
KEPT_WORDS = 300_000
EDGE = "\"'`.,;:!?()[]{}<>*#$%&|_~-+=/\\"
ENDS = (".", "!", "?")


def features(word: str) -> list[str]:
    """Of a bare lower-case word: itself, its starts and its end."""
    return ["w" + word, *(f"p{word[:k]}" for k in (4, 5, 6) if len(word) > k), "s" + word[-3:]]


def sentences(words: list[str]) -> list[tuple[int, int]]:
    """First and past-last places; a word that ends with a full stop, ! or ? closes a sentence, and so does the
    LONGEST-th."""
    out, a = [], 0
    for i, w in enumerate(words, 1):
        if w.endswith(ENDS) or i - a == LONGEST:
            out.append((a, i))
            a = i
    return out if a == len(words) else [*out, (a, len(words))]


def expectations(weights: list[np.ndarray], t: np.ndarray, moves: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """P(toxic) of every token of every sentence, and the expected number of each move if asked for. ``weights``:
    log-odds of its tokens; ``t``: log-weights of moves between the states. Sentences of like length go side by side."""
    out, total = [np.zeros(0)] * len(weights), np.zeros((2, 2))
    order = sorted((i for i in range(len(weights)) if len(weights[i])), key=lambda i: -len(weights[i]))
    while order:
        n = max(1, AT_ONCE // len(weights[order[0]]))
        part, order = order[:n], order[n:]
        found, seen = _side_by_side([weights[i] for i in part], t, moves)
        total += seen
        for i, p in zip(part, found, strict=True):
            out[i] = p
    return out, total


def _side_by_side(weights: list[np.ndarray], t: np.ndarray, moves: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """The same of sentences in falling order of length."""
    sizes = np.array([len(w) for w in weights])
    e = np.zeros((sizes[0], len(weights)))
    for k, w in enumerate(weights):
        e[: sizes[k], k] = w
    alive = [int(np.searchsorted(-sizes, -s, side="left")) for s in range(sizes[0])]  # sentences longer than s
    # Messages as the log-odds of state 1: enough with two states.
    step = lambda x: np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)
    back = lambda x: np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)
    forward, behind, total = e.copy(), np.zeros_like(e), np.zeros((2, 2))
    for s in range(1, sizes[0]):
        n = alive[s]
        forward[s, :n] += step(forward[s - 1, :n])
    for s in range(sizes[0] - 2, -1, -1):
        n = alive[s + 1]
        later = e[s + 1, :n] + behind[s + 1, :n]
        behind[s, :n] = back(later)
        if moves:
            # The four moves from s to s + 1, by what stands before and behind.
            f = forward[s, :n]
            joint = np.stack([np.full(n, t[0, 0]), t[0, 1] + later, t[1, 0] + f, t[1, 1] + f + later])
            joint = np.exp(joint - joint.max(axis=0))
            total += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    p = 1 / (1 + np.exp(-np.clip(forward + behind, -60, 60)))
    return [p[: sizes[k], k] for k in range(len(weights))], total


class Chain:
    """The fitted model; small and bounded."""

    def __init__(self, rows: list[tuple[str, int]]):
        # Every fourth row of each class is kept back for the documents' scores.
        classes = [[r for r in rows if r[1] == y] for y in (0, 1)]
        self._learn([r for c in classes for k, r in enumerate(c) if k % 4 or len(c) < 4])
        self._calibrate([r for c in classes for r in c[::4]])

    def _learn(self, rows: list[tuple[str, int]]) -> None:
        toxic, clean = Counter(), Counter()
        bare = [[w.strip(EDGE) for w in t.lower().split()] for t, _ in rows]
        for words, (_, y) in zip(bare, rows, strict=True):
            (toxic if y else clean).update({f for w in set(words) if w for f in features(w) if f[0] != "s"})
        share = sum(y for _, y in rows) / len(rows)
        likely = {f for f, n in toxic.items() if n > 1 and n * (1 - share) >= RATIO * clean[f] * share}
        places: dict[str, set] = {f: set() for f in likely}
        for words, (_, y) in zip(bare, rows, strict=True):
            for before, w, after in zip(["", *words], words, [*words[1:], ""]) if y else ():  # noqa: B905
                for f in likely.intersection(features(w)):
                    places[f].add((before, after))
        least = max(LEAST_PLACES, (np.log(len(toxic) + len(clean) + 1) + SURE) / -np.log(min(share, 0.95)))
        marks = {f for f, found in places.items() if len(found) >= least}
        with_, without = [], []
        for words, (t, y) in zip(bare, rows, strict=True):
            raw = t.lower().split()
            for a, b in sentences(raw):
                own = words[a:b]
                tags = [float(bool(y and w and not marks.isdisjoint(features(w)))) for w in own]
                (with_ if any(tags) else without).append((own, tags))
        keep = lambda found: found[:: max(1, -(-len(found) // SENTENCES))]
        self._fit(keep(with_) + keep(without))
        self.kept: dict[str, float] = {}
        self.quiet = self._quiet()

    def _fit(self, data: list[tuple[list[str], list[float]]]) -> None:
        """Adaptive gradient ascent of the penalised conditional log-likelihood, in word and move weights at once."""
        seen = Counter(f for words, _ in data for w in words for f in set(features(w)))
        index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 2))}
        at = [[index[f] for f in features(w) if f in index] for words, _ in data for w in words]
        owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
        flat = np.array([i for x in at for i in x], dtype=np.int64)
        tags = np.concatenate([np.array(y) for _, y in data])
        cuts = np.cumsum([len(words) for words, _ in data])[:-1]
        held = np.zeros((2, 2))
        for _, y in data:
            np.add.at(held, (np.array(y[:-1], dtype=int), np.array(y[1:], dtype=int)), 1)
        w, g2, bias, b2, t, t2 = np.zeros(len(index)), np.full(len(index), 1e-6), -2.0, 1e-6, np.zeros((2, 2)), np.full((2, 2), 1e-6)
        for _ in range(ROUNDS):
            e = bias + np.bincount(owner, weights=w[flat], minlength=len(at))
            p, expected = expectations(np.split(e, cuts), t, moves=True)
            miss = tags - np.concatenate(p)
            grad = np.bincount(flat, weights=miss[owner], minlength=len(index)) - PENALTY * w
            g2 += grad**2
            w += 0.5 * grad / np.sqrt(g2)
            b2 += miss.sum() ** 2
            bias += 0.5 * miss.sum() / np.sqrt(b2)
            pull = held - expected - PENALTY * t
            t2 += pull**2
            t += 0.2 * pull / np.sqrt(t2)
        self.bias, self.moves = float(bias), t
        self.w = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}

    def _quiet(self) -> float:
        """The largest constant weight whose chain stays at or below FLOOR, by bisection; none where states repel."""
        if self.moves[0, 0] + self.moves[1, 1] < self.moves[0, 1] + self.moves[1, 0]:
            return -np.inf
        low, high = -60.0, 10.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if max(expectations([np.full(n, mid) for n in range(1, LONGEST + 1)], self.moves)[0][n].max() for n in range(LONGEST)) <= FLOOR else (low, mid)
        return low

    def weight(self, word: str) -> float:
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        bare = word.strip(EDGE)
        get = self.w.get
        found = self.kept[word] = self.bias + (sum(get(f, 0.0) for f in features(bare)) if bare else -5.0)
        return found

    def tagged(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """Of each text, places of words (among all its words) with marginals above FLOOR."""
        jobs, where = [], []
        for k, text in enumerate(texts):
            words = text.lower().split()
            get, make = self.kept.get, self.weight
            e = [x if (x := get(w)) is not None else make(w) for w in words]
            if not e or max(e) <= self.quiet:
                continue
            for a, b in sentences(words):
                if max(e[a:b], default=-99) > self.quiet:
                    jobs.append(np.array(e[a:b]))
                    where.append((k, a))
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        for (k, a), p in zip(where, expectations(jobs, self.moves)[0], strict=True):
            out[k] += [(a + int(i), float(p[i])) for i in np.flatnonzero(p > FLOOR)]
        return out

    @staticmethod
    def summary(found: list[tuple[int, float]]) -> np.ndarray:
        """What a score depends on: 1, the two largest marginals, the expected number of toxic tokens (its log)."""
        p = sorted((x for _, x in found), reverse=True)
        return np.array([1.0, max(p[:1], default=0.0), max(p[1:2], default=0.0), np.log1p(sum(p))])

    def _calibrate(self, rows: list[tuple[str, int]]) -> None:
        x = np.stack([self.summary(f) for f in self.tagged([t for t, _ in rows])])
        y = np.array([y for _, y in rows], dtype=float)
        self.fit = np.zeros(4)
        for _ in range(30):  # Newton steps of the penalised logistic fit
            p = 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
            self.fit += np.linalg.solve(hess, x.T @ (y - p) - 0.1 * self.fit)

    def score(self, found: list[tuple[int, float]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(found) @ self.fit, -30, 30))))


_PLACES = re.compile(r"\S+")


def offsets(text: str, found: list[tuple[int, float]]) -> str:
    """start:end in code points of the words with a marginal of a half or more, comma-joined."""
    hit = {i for i, p in found if p >= 0.5}
    if not hit:
        return ""
    spans, at = [], 0
    words = text.split()
    for i in range(max(hit) + 1):
        at = text.index(words[i], at)
        if i in hit:
            spans.append(f"{at}:{at + len(words[i])}")
        at += len(words[i])
    return ",".join(spans)


def fitted(docs: DataFrame, labels: DataFrame) -> Chain | None:
    rows = sample(docs, labels, "toxic", PER_CLASS, MOST_CHARS).orderBy("id").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    return Chain([(r["t"], r["y"]) for r in rows])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end of offending words), a row per row of ``docs``."""
    model = released_after(docs.sparkSession.sparkContext.broadcast(fitted(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(2).to_pylist()
                found = m.tagged(texts) if m else [[] for _ in texts]
                scores = [m.score(f) if m else 0.5 for f in found]
                spans = [offsets(t, f) for t, f in zip(texts, found, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "held_out", "score", "spans"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("t"))
    d = d.mapInArrow(run, "doc_id long, held_out boolean, score double, spans string")
    return d.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
