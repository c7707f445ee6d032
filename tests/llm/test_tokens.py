"""Encoding against the tokenizers library, counts against a plain greedy loop."""

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salestally.llm import bpe, tokens
from rows import odd_rows

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
VOCABULARY = bpe.vocabulary(PATH)


def unpack(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab  \n'sret<|endoftext|>é中\U0001f600\x1c՘ᲊ 0-=!\xa0\x85"), max_size=60) | st.text(max_size=40))
def test_any_text(text):
    packed, = VOCABULARY.encode([text])
    found = LIBRARY.encode(text, add_special_tokens=False).ids
    assert unpack(packed) == found
    assert VOCABULARY.decode(packed) == LIBRARY.decode(found, skip_special_tokens=False) == text


def test_long_words():
    for text in ("a" * 20000, " " * 5000 + "x", "-=" * 3000, "thering" * 2000):
        packed, = VOCABULARY.encode([text])
        assert unpack(packed) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_stores_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    texts = ["one two three four", "five six <|endoftext|> one", "two"]
    assert [unpack(p) for p in VOCABULARY.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_table(odd, clashing, none):
    for df in (odd, clashing):
        out = bpe.decode(bpe.encode(df, PATH, unpack=False), PATH).select("doc_id", "text", "ids", "decoded").collect()
        assert len(out) == len(odd_rows())
        for row in out:
            assert row.decoded == (row.text or "")
            assert unpack(bytes(row.ids)) == LIBRARY.encode(row.text or "", add_special_tokens=False).ids
    unpacked = bpe.encode(odd.where("doc_id = 8"), PATH, unpack=True).first()
    assert unpacked.ids == LIBRARY.encode("one two", add_special_tokens=False).ids
    assert bpe.digests(none).collect() == []


def test_unknown_ids_decode_to_nothing():
    assert VOCABULARY.decode(np.array([4_000_000], "<u4").tobytes()) == ""


def greedy(word: bytes, pieces: set, longest: int) -> int:
    n = at = 0
    while at < len(word):
        end = min(len(word), at + longest)
        while end > at and word[at:end] not in pieces:
            end -= 1
        if end == at:
            return 1
        at, n = end, n + 1
    return n


def test_counts(odd, clashing, none):
    letters = bpe.byte_letters()
    pieces = {bytes(letters[c] for c in p) for p in json.load(open(PATH))["model"]["vocab"]}
    longest = max(map(len, pieces))
    for df in (odd, clashing):
        for row in tokens.token_counts(df, PATH).select("text", "n_words", "n_tokens").collect():
            words = (row.text or "").encode().split()
            assert row.n_words == len(words)
            assert row.n_tokens == sum(greedy(b" " + w, pieces, longest) for w in words)
    assert tokens.token_counts(none, PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12),
       st.binary(max_size=20).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_any_vocabulary(pieces, word):
    """Failure links follow greedy matching, and what cannot be covered is one unknown token."""
    assert tokens.Automaton(pieces).count(word) == greedy(word, pieces, 5)
