"""Byte-pair encoding and decoding of whole texts.

Encoding: an Aho-Corasick automaton over the vocabulary's byte strings gives the longest
token that starts at each byte. A backtracking walk takes the longest one, falls back on the
longest shorter prefix that is a token, and steps back over a token that leads nowhere; a
token may follow another only if the merges could not have joined across their border,
which a memoised pair table answers. A bit per byte keeps a place from being tried twice,
so that the work is linear in the text. The result is that of applying the merges by rank.
Decoding: token ids point into one byte string through a table of offsets.

Tasks read Arrow batches; each worker loads the vocabulary once. A text whose white space
never stands twice in a row is cut at its spaces, as the word pattern cuts there too, and
encodings of the pieces are kept: at most twice ``kept``, the older half going first. A piece that decodes to
itself is kept with its ids alone, so that with ``KEPT_WORDS`` a worker's pieces and pairs stay
below about 120 MB; between tasks it keeps one half of the pieces. ``kept`` trades speed for memory and changes no result.

Defined cases: null text is empty; empty text has no ids; special tokens' strings in a text
become their ids, as the library does; rows are handled one by one, so repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, text_of

#: Fixed value: the byte-level tokenizer's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 250_000
KEPT_PAIRS = 100_000
#: Texts whose ids are held at once.
BATCH = 128


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files, by the published rule: printable
    Latin-1 characters stand for themselves, the other bytes for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A vocabulary with its merges, for one worker."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        # Latin-1 strings: one character a byte.
        plain = {t: "".join(chr(letters[c]) for c in t) for t in model["vocab"]}
        self.ids = {plain[t]: i for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Ranks order the tokens as they come into being: bytes first, then the merges.
        self.rank = {t: -1 for t in self.ids if len(t) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.joined: dict[tuple[str, str], int] = {}
        for r, (a, b) in enumerate(merges):
            a, b = plain[a], plain[b]
            self.joined[a, b] = r
            if a + b not in self.rank:
                self.rank[a + b], self.halves[a + b] = r, (a, b)
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN)
        by_id = {i: t.encode("latin-1") for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes, self.offsets = b"", [0]
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        for p in parts:
            self.offsets.append(self.offsets[-1] + len(p))
        self.bytes = b"".join(parts)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefix: dict[str, str | None] = {}
        self.most, self.kept = kept, ({}, {})

    def may_follow(self, a: str, b: str) -> bool:
        """Whether the merges leave a border between a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._border(a, b)
        return known

    def _border(self, a: str, b: str) -> bool:
        # Undo the merges of the two tokens from the last one back. Before each of them, the pieces at the border
        # must not be a pair whose own merge would have come sooner.
        last = float("inf")
        while True:
            r = self.joined.get((a, b))
            if r is not None and r < last:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # On the left, the same rank is done left to right: a pair of that rank to its right comes later.
                last, a = ra, self.halves[a][1]
            else:
                last, b = rb + 0.5, self.halves[b][0]

    def shorter(self, token: str) -> str | None:
        """The longest token that is a proper prefix."""
        if token not in self.prefix:
            self.prefix[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), None)
        return self.prefix[token]

    def encode_bytes(self, word: str) -> list[int]:
        """Ids of a Latin-1 string of bytes."""
        if word in self.ids:
            return [self.ids[word]]
        # The walk without a step back, straight from the automaton, is right if every pair of it may stand.
        ends = [(end + 1, size) for end, size in self.automaton.iter_long(word)]
        out = [word[end - size : end] for end, size in ends]
        known, before = self.pairs.get, ""
        for t in out:
            if before:
                fits = known((before, t))
                if not (self.may_follow(before, t) if fits is None else fits):
                    break
            before = t
        else:
            return [self.ids[t] for t in out]
        # Later matches of one start are longer.
        longest = {end - size: size for end, size in self.automaton.iter(word)}
        open_, out, at, size = bytearray(b"\1") * (len(word) + 1), [], 0, len(word)
        prefix, pairs = self.prefix, self.pairs
        token: str | None = word[: longest[-1]]
        while at < size:
            if token is None:  # nothing leads on from here: step back over the last token
                open_[at] = 0
                token = out.pop()
                at -= len(token)
            elif open_[at + len(token)]:
                fits = not out or pairs.get((out[-1], token))
                if fits or fits is None and self.may_follow(out[-1], token):
                    out.append(token)
                    at += len(token)
                    token = word[at : at + longest[at - 1]] if at < size else None
                    continue
            token = prefix[token] if token in prefix else self.shorter(token)
        return [self.ids[t] for t in out]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes[self.offsets[i] : self.offsets[i + 1]] for i in ids)

    def encoded(self, word: str) -> list[int]:
        return self.encode_bytes(word.encode("utf-8").decode("latin-1"))

    def piece(self, piece: str) -> str | tuple[str, str] | None:
        """Comma-joined ids of a piece with the space before it, with what they decode to after that space where
        that is not the piece. None if white space meets the piece's ends, so that the cut was wrong."""
        young, old = self.kept
        found = old.get(piece)
        if found is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return None
            head, *rest = self.words.findall(" " + piece)
            known = rest and (young.get(head[1:]) or old.get(head[1:]))
            ids = [i for w in (rest if known else (head, *rest)) for i in self.encoded(w)]
            joined, decoded = ",".join(map(str, ids)), self.decode(ids).decode("utf-8", "replace")
            if known:
                before, same = known if isinstance(known, tuple) else (known, head[1:])
                joined, decoded = f"{before},{joined}", same + decoded
            else:
                decoded = decoded[1:]
            found = joined if decoded == piece else (joined, decoded)
        if len(young) >= self.most:
            self.kept = (young, _) = ({}, young)
        young[piece] = found
        return found

    def text(self, text: str) -> tuple[str, str]:
        """Comma-joined ids of a text, and the text that they decode to."""
        if self.specials and any(s in text for s in self.special):
            ids = []
            at = 0
            for m in self.specials.finditer(text):
                ids += [*self._ids(text[at : m.start()]), self.special[m.group()]]
                at = m.end()
            ids += self._ids(text[at:])
            return ",".join(map(str, ids)), self.decode(ids).decode("utf-8", "replace")
        first, *pieces = text.split(" ")
        get, make = self.kept[0].get, self.piece
        found = []
        if first and not first[-1].isspace():
            found = [get(p) or make(p) for p in pieces]
        if len(found) < len(pieces) or None in found or not first:
            ids = self._ids(text)
            return ",".join(map(str, ids)), self.decode(ids).decode("utf-8", "replace")
        ids = self._ids(first)
        parts, decoded = [",".join(map(str, ids))], [self.decode(ids).decode("utf-8", "replace")]
        for p, x in zip(pieces, found, strict=True):
            if isinstance(x, tuple):
                parts.append(x[0])
                decoded.append(x[1])
            else:
                parts.append(x)
                decoded.append(p)
        return ",".join(parts), " ".join(decoded)

    def rest(self) -> None:
        """At the end of a task: the larger half stays for the next one."""
        self.kept = ({}, max(self.kept, key=len))

    def _ids(self, text: str) -> list[int]:
        return [i for w in self.words.findall(text) for i in self.encoded(w)]


@lru_cache(maxsize=1)
def codec(path: str, kept: int = KEPT_WORDS) -> Codec:
    return Codec(path, kept)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded text, a row per row of ``docs``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                b = whole.slice(start, BATCH)
                pairs = [c.text(t) for t in b.column(1).to_pylist()]
                ids = [[int(i) for i in joined.split(",")] if joined else [] for joined, _ in pairs]
                yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in pairs], pa.string())], ["doc_id", "ids", "decoded"])
        c.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False, kept: int = KEPT_WORDS, resident: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, a row per row of ``docs``; texts stay in the task, and so do ids
    unless they are asked for. If not ``resident``, a worker gives the vocabulary back when its task ends."""
    path = path or default_path()
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, kept)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                b = whole.slice(start, BATCH)
                n, ids, decoded, values = [], [], [], array("i")
                for t in b.column(1):
                    joined, data = c.text(t.as_py())
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(digest(joined.encode()))
                    decoded.append(digest(data.encode()))
                    if with_ids and joined:
                        values.extend(map(int, joined.split(",")))
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(values, np.int32) if values else np.zeros(0, np.int32))))
                yield pa.record_batch(columns, names)
        c.rest()
        if not resident:
            del c
            codec.cache_clear()
        let_go()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(run, schema)
