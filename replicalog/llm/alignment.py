"""Tokens of two tokenizers side by side: where both end, and which of them end together most often.

Texts are shuffled whole and counted, so that each distinct one is encoded and aligned once; what it says of pairs of ids
counts as often as the text occurs; the measures come back to the rows by the digest of the text. Of two tokens that end
at one byte one is a suffix of the other, so the vocabularies bound how many pairs can ever be seen (``most_pairs``),
whatever the corpus: that is the bound on what is broadcast.

A worker cuts texts where one space stands between two characters that aren't white space. Both tokenizers start a token
at such a space, hence the cut changes no token, and encodings of words can be kept: at most twice KEPT_WORDS of them, each of up
to KEPT_CHARS characters, the older half going first. Long texts are cut there first, so that memory follows a segment and not the text.

Defined cases: null and empty texts, and those whose tokens don't spell the text, have zeros and an empty digest; rows
with a null doc_id are measured like others; equal texts and repeated rows are encoded once and counted each; other
columns are ignored; an empty table gives an empty result. Special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import let_go, stored

KEPT_WORDS = 150_000
KEPT_CHARS = 48
#: Characters of a segment, and texts of which measures are held at once.
SEGMENT = 200_000
BATCH = 256
#: One space between two characters that no definition calls white space.
CUT = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
UNEVEN = re.compile("^ | $| [\\s᠎]|[\\s᠎] ")
MEASURES = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>"
NO_TOKENS = (0, 0, "", b"")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenizers, for one worker."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        letters = byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.n_b = len(self.bytes_b)
        last_a = max(self.bytes_a) + 1
        if last_a * self.n_b >= 1 << 31:
            raise ValueError("vocabularies of so many pairs need longer numbers of pairs")
        self.lengths_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(last_a)])
        self.lengths_b = np.array([len(t) for t in self.bytes_b])
        # Ids as text with what follows them: inside a group, at the end of its A half, at its end.
        said = lambda sep: np.array([f"{i}{sep}" for i in range(max(last_a, self.n_b))], dtype=object)
        self.comma, self.bar, self.semicolon = said(","), said("|"), said(";")
        self.words: tuple[dict, dict] = ({}, {})

    def most_pairs(self) -> int:
        """Pairs of ids of which one's bytes are the other's last: no others can end together."""
        count_a, count_b = Counter(self.bytes_a.values()), Counter(self.bytes_b)
        return sum(n * count_b[t[k:]] for t, n in count_a.items() for k in range(len(t))) + sum(n * count_a[t[k:]] for t, n in count_b.items() for k in range(1, len(t)))

    def aligned(self, words: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple | None]:
        """For each word its groups as text, the pairs (A id * n_b + B id) that end them as bytes of numbers, and the tokens of
        each; None where the tokens do not spell the word after a space. Words stand one after another, so that their
        ends are one row of numbers."""
        flat_a, flat_b = [i for x in a for i in x], [i for x in b for i in x]
        raw = b"".join([b" " + w.encode() for w in words])
        if b"".join([self.bytes_a[i] for i in flat_a]) != raw or b"".join([self.bytes_b[i] for i in flat_b]) != raw:
            if len(words) == 1:
                return [None]
            half = len(words) // 2
            return self.aligned(words[:half], a[:half], b[:half]) + self.aligned(words[half:], a[half:], b[half:])
        ids_a, ids_b = np.array(flat_a), np.array(flat_b)
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        cut_a, cut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        pairs = (ids_a[cut_a] * self.n_b + ids_b[cut_b]).astype(np.int32).tobytes()
        # The tokens in order of their group, those of A first.
        group = np.concatenate([np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b])
        text = np.concatenate([np.where(cut_a, self.bar[ids_a], self.comma[ids_a]), np.where(cut_b, self.semicolon[ids_b], self.comma[ids_b])])
        text = text[np.argsort(group, kind="stable")].tolist()
        count_a, count_b = [len(x) for x in a], [len(x) for x in b]
        tokens = list(accumulate(map(sum, zip(count_a, count_b, strict=True)), initial=0))
        links = [0, *(np.cumsum(cut_a)[np.cumsum(count_a) - 1] * 4).tolist()]
        return [("".join(text[tokens[k] : tokens[k + 1]])[:-1], pairs[links[k] : links[k + 1]], count_a[k], count_b[k]) for k in range(len(words))]

    def learn(self, words: Iterable[str]) -> dict[str, tuple | None]:
        """What is known of distinct words; those not kept are encoded in one call."""
        young, old = self.words
        found, new = {}, []
        for w in words:
            x = young.get(w, 0)
            if x == 0:
                x = old.get(w, 0)
                if x == 0:
                    new.append(w)
                    continue
                young[w] = x
            found[w] = x
        if new:
            a, b = self.a.encode_batch_fast([f" {w}" for w in new], add_special_tokens=False), self.b.encode(new, num_threads=1)
            for w, x in zip(new, self.aligned(new, [x.ids for x in a], b), strict=True):
                found[w] = x
                if len(w) <= KEPT_CHARS:
                    young[w] = x
        if len(young) >= KEPT_WORDS:
            self.words = ({}, young)
        return found

    def measures(self, texts: list[str]) -> Iterator[tuple[int, int, str, bytes]]:
        """n_a, n_b, groups_sha256 and the pairs of each text; texts go through together as far as SEGMENT characters."""
        held, size = [], 0
        for t in texts:
            if len(t) > SEGMENT:
                yield from self._together(held)
                held, size = [], 0
                yield self._long(t)
                continue
            held.append(CUT.split(t) if UNEVEN.search(t) else t.split(" "))
            size += len(t)
            if size > SEGMENT:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[list[str]]) -> Iterator[tuple[int, int, str, bytes]]:
        known = self.learn({w for words in texts for w in words})
        for words in texts:
            rows = [known[w] for w in words]
            if None in rows:
                yield NO_TOKENS
                continue
            yield sum([x[2] for x in rows]), sum([x[3] for x in rows]), hashlib.sha256(";".join([x[0] for x in rows]).encode()).hexdigest(), b"".join([x[1] for x in rows])

    def _long(self, text: str) -> tuple[int, int, str, bytes]:
        n_a, n_b, digest, pairs = 0, 0, hashlib.sha256(), []
        for k, segment in enumerate(segments(text)):
            words = CUT.split(segment) if UNEVEN.search(segment) else segment.split(" ")
            known = self.learn(set(words))
            if None in known.values():
                return NO_TOKENS
            rows = [known[w] for w in words]
            n_a, n_b = n_a + sum([x[2] for x in rows]), n_b + sum([x[3] for x in rows])
            digest.update((";" * (k > 0) + ";".join([x[0] for x in rows])).encode())
            pairs.append(b"".join([x[1] for x in rows]))
        return n_a, n_b, digest.hexdigest(), b"".join(pairs)


def segments(text: str) -> Iterator[str]:
    """The text in pieces of some SEGMENT characters; each cut takes one space with it."""
    at = 0
    while len(text) - at > SEGMENT and (m := CUT.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


@lru_cache(1)
def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    return Aligner(byte_bpe, piece_bpe)


def distinct_measures(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """MEASURES of each distinct text that is not empty; key is its SHA-256, copies the rows that have it."""
    byte_bpe, piece_bpe = paths
    names = [c.split()[0] for c in MEASURES.split(", ")]
    schema = pa.schema(list(zip(names, [pa.binary(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int32())], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_bpe, piece_bpe)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                rows = list(own.measures(b.column("text").to_pylist()))
                n_links = [len(x[3]) // 4 for x in rows]
                ends = pa.array(accumulate(n_links, initial=0), pa.int32())
                flat = pa.array(np.frombuffer(b"".join([x[3] for x in rows]), np.int32))
                columns = [b.column("key"), b.column("copies"), *(pa.array(x, pa.int64()) for x in ([x[0] for x in rows], [x[1] for x in rows], n_links, n_links)), pa.array([x[2] for x in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], schema=schema)
        let_go()

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text").mapInArrow(run, MEASURES)


def pair_counts(measures: DataFrame, n_b: int) -> DataFrame:
    """pair, count, best: links of each pair in the whole corpus, and whether no pair with its B id has more."""
    seen = measures.select("copies", F.explode("pairs").alias("pair"))
    counts = seen.groupBy("pair").agg(F.sum("copies").alias("count")).withColumn("b", F.col("pair") % n_b)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    paths = paths or default_paths()
    own = aligner(*paths)
    measures = stored(distinct_measures(docs, paths), "aligned-texts")
    counts = stored(pair_counts(measures, own.n_b).coalesce(1), "pair-counts")
    # At most own.most_pairs() rows of 17 bytes, by the vocabularies alone.
    each = measures.select("key", F.explode("pairs").alias("pair")).join(F.broadcast(counts), "pair")
    scored = each.groupBy("key").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    by_text = measures.drop("copies", "pairs").join(scored, "key", "left")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("key"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(by_text, "key", "left").select("doc_id", *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
