import hashlib
import random

import pytest
from tokenizers import Tokenizer

from replicalog.llm import bpe

from . import brute


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_path())


def same(codec, library, text):
    joined, data = codec.text(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ([int(i) for i in joined.split(",")] if joined else []) == want, repr(text)
    assert data == library.decode(want, skip_special_tokens=False)


def test_codec_against_the_library(codec, library):
    draw = random.Random(8)
    letters = ["a", "e", "in", "th", "er", " ", "  ", "\n", "\t", "é", "ß", "ción", "1", "23", "'s", "'ll", "!", "...", "€", "中", "🙂", "‍", "\xa0", "　", "\x1c", "\x85", "İ", "²", "<|endoftext|>", "the", "ing", "zq", "aaaa", "////", "abab"]
    for _ in range(4000):
        same(codec, library, "".join(draw.choices(letters, k=draw.randint(0, 30))))
    for t in [*filter(None, brute.ODD_TEXTS), "a" * 5000, " " * 3000, "=" * 777, "xyzzy" * 900]:
        same(codec, library, t)


def test_every_letter(codec, library):
    for first in range(0, 0x30000, 64):
        text = "".join(f"a{chr(i)}b {chr(i)}{chr(i)} " for i in range(first, first + 64) if not 0xD800 <= i < 0xE000)
        same(codec, library, text)


def test_random_byte_words(codec, library):
    draw = random.Random(9)
    vocabulary = [t for t in codec.ids if t.isascii() and t.isalpha()]
    for _ in range(6000):
        same(codec, library, "".join(draw.choices(vocabulary, k=draw.randint(1, 5))))


def test_table(spark, library):
    rows = bpe.digests(brute.odd_docs(spark)).collect()
    assert len(rows) == len(brute.ODD_TEXTS)
    for r in rows:
        ids = library.encode(brute.ODD_TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r.doc_id: r for r in bpe.encode(brute.odd_docs(spark)).collect()}
    assert full[4].decoded == brute.ODD_TEXTS[4] and full[0].ids == []
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
