"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms are hashed byte pairs, and for every word how far back the same word stood last (in powers of two, or never).
Weighted and normalised term vectors of a bounded sample of labelled
documents give, by the leading eigenvectors of their Gram matrix, the latent space. The sample's
latent vectors, at most ``2 * PER_CLASS`` rows of ``RANK`` numbers, are broadcast. Every document is
folded in by its whole text, exact cosines with all of them are computed block by block, and the
``NEIGHBOURS`` nearest vote with their similarity as weight.

Only labels of rows that are not held out are read; lang, source, labels and doc_id are no input
of a score. Documents pass through one Arrow map: no shuffle, memory bounded by a block.

Defined cases: null or empty texts have no terms, and their score is the sample's share of label 1;
without labelled rows of both classes every score is 1 if only that label occurs, 0 if only label 0,
and 0.5 without any; ties among neighbours go to the sample's order by doc_id; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, released_after, text_of
from .labelled import held_out, sample

PER_CLASS = 1500
MOST_CHARS = 200_000
PAIRS = 2048
DISTANCES = 8
RANK = 48
#: Vectors beside these while they are searched for, and rounds of the search.
SPARE, ROUNDS = 16, 30
NEIGHBOURS = 15
BLOCK = 256


def _buckets() -> np.ndarray:
    """Bucket of each pair of bytes, by multiplicative hashing."""
    pair = np.arange(65536, dtype=np.uint64)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64) % PAIRS


BUCKET = _buckets()


def terms(text: str) -> np.ndarray:
    """Square roots of the relative frequencies of byte pairs, then of the words' distances to their last occurrence."""
    out = np.zeros(PAIRS + DISTANCES, dtype=np.float32)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(data) > 1:
        out[:PAIRS] = np.bincount(BUCKET[data[:-1].astype(np.int64) * 256 + data[1:]], minlength=PAIRS) / (len(data) - 1)
    words = text.split()
    last: dict[str, int] = {}
    distances = [0] * (DISTANCES + 1)
    for i, w in enumerate(words):
        before = last.get(w)
        last[w] = i
        distances[0 if before is None else min(DISTANCES - 1, (i - before).bit_length())] += 1
    if words:
        out[PAIRS:] = np.array(distances[:DISTANCES]) / len(words)
    return np.sqrt(out)


def leading(x: np.ndarray) -> np.ndarray:
    """The RANK leading eigenvectors of the Gram matrix of x, by subspace iteration: the matrix itself, and what its
    decomposition needs beside it, would be most of what the driver holds."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], min(x.shape[1], RANK + SPARE)), dtype=np.float32))[0]
    for _ in range(ROUNDS):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    small = x @ q
    values, vectors = np.linalg.eigh((small.T @ small).astype(np.float64))
    return (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


class Space:
    """Latent space and labelled vectors; small and fixed in size."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        """``rows`` is written over, so that the driver holds the sample's vectors once."""
        present = (rows > 0).sum(axis=0)
        self.weight = np.log((1 + len(rows)) / (1 + present)).astype(np.float32) + 1
        rows *= self.weight
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
        x = np.divide(rows, np.where(norm > 0, norm, 1), out=rows)
        self.basis = leading(x)
        self.vectors, self.labels, self.share = self._unit(x @ self.basis), labels.astype(np.float32), float(labels.mean())

    def _weighted(self, rows: np.ndarray) -> np.ndarray:
        return self._unit(rows * self.weight)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        cosine = self._unit(self._weighted(rows) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        # Where the last of them has equals outside, those first in the sample are taken.
        least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
        for r in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
            near[r] = np.argsort(-cosine[r], kind="stable")[:k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8 + 1e-12
        vote = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(rows.any(axis=1), np.clip(vote, 0, 1), self.share)


def fitted(docs: DataFrame, labels: DataFrame) -> Space | float:
    """The space, or the constant score where one class has no labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([terms(t.as_py()).tobytes() for t in b.column(1)], pa.binary()), b.column(2)], ["id", "v", "y"])

    rows = sample(docs, labels, "quality", PER_CLASS, MOST_CHARS).mapInArrow(run, "id long, v binary, y int").orderBy("id").collect()
    y = np.array([r["y"] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.empty((len(rows), PAIRS + DISTANCES), dtype=np.float32)
    for k in range(len(rows)):
        x[k] = np.frombuffer(rows[k]["v"], dtype=np.float32)
        rows[k] = None
    space = Space(x, y)
    del x, rows
    let_go()
    return space


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, a row per row of ``docs``."""
    space = released_after(docs.sparkSession.sparkContext.broadcast(fitted(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                got = np.full(part.num_rows, s) if isinstance(s, float) else s.scores(np.stack([terms(t.as_py()) for t in part.column(2)]))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(got.astype(np.float64))], ["doc_id", "held_out", "score"])
        let_go()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("t"))
    d = d.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1, all columns kept."""
    space = released_after(docs.sparkSession.sparkContext.broadcast(fitted(docs, labels)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                got = np.full(part.num_rows, s) if isinstance(s, float) else s.scores(np.stack([terms(t.as_py() or "") for t in part.column(at)]))
                yield part.filter(pa.array(got >= 0.5))
        let_go()

    return docs.mapInArrow(run, docs.schema)
