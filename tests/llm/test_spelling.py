"""Spelling variants against a plain version that looks up every edit of every word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from salestally.llm import QUERIES, spelling


def plain_words(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def plain_variants(count):
    letters = sorted({c for w in count for c in w})
    near = {}
    for w in count:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + k:] for k in (0, 1) for i in range(len(w) + 1) for c in letters}
        near[w] = [x for x in edits if x != w and x in count]
    form = {}
    for w in count:
        first = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = first if first is not None and count[first] >= 10 * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, count[w], len(near[w]), form[w], count[form[w]] if form[w] else None, root(w)) for w in count}


def chain_rows():
    """Words with forms of forms, ties among them, and letters that only case or a mark tells apart."""
    rows, at = [], 0
    for word, n in [("rollingx", 2), ("rolling", 25), ("rollings", 25), ("rollins", 300), ("collins", 3100), ("marbles", 2), ("marblés", 20),
                    ("MARBLEÉ", 2), ("marbleé", 2), ("marbl×s", 2), ("parablex", 2), ("parables", 30), ("parablez", 30)]:
        for _ in range(n):
            rows.append((at, f"{word}, "))
            at += 1
    return rows


def family():
    """Many words under one signature: anagrams, and words that differ at one place."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(300)}
    words |= {"gabcdef" + c for c in "abcdefghijklmnopqrstuvwxyz"} | {"gabcdef"} | {"x" * 60, "x" * 61, "x" * 59 + "y", "y" * 120, "y" * 119}
    return [(1, " ".join(sorted(words))), (1, " ".join(sorted(words)))]


@pytest.mark.parametrize("group", [spelling.GROUP, 2])
def test_against_plain(spark, odd, clashing, none, group, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", group)
    cases = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (chain_rows(), family())] + [odd, clashing]
    for df in cases:
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        found = spelling.variants(df)
        assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
        assert Counter(map(tuple, found.collect())) == Counter(plain_variants(plain_words(rows)))
    assert spelling.variants(none).collect() == []


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op11_spelling"](spark, folder).collect())) == Counter(plain_variants(plain_words(rows)))


def edited(draw_word, place, letter, kind):
    place %= len(draw_word)
    return draw_word[:place] + ("" if kind == 0 else letter) + draw_word[place + (kind != 1):]


@settings(max_examples=300, deadline=None)
@given(st.text("abcéÿ", min_size=7, max_size=70), st.integers(0, 200), st.sampled_from("abcz"), st.integers(0, 2))
def test_near_words_share_a_signature(word, place, letter, kind):
    other = edited(word, place, letter, kind)
    if other == word:
        return
    a, b = sorted([word, other], key=len)
    assert spelling.one_edit(a, b) and spelling.near([a, b], np.array([0]), np.array([1])).all()
    x, y = (spelling.letters([w], len(w)) for w in (a, b))
    if len(a) == len(b):
        signs = [spelling.multiset_signatures(c, spelling.CLASSES_2, 2, 2 * len(a)) for c in (x, y)]
    else:
        signs = [spelling.multiset_signatures(c, spelling.CLASSES_1, 1, 2 * len(a) + 1) for c in (x, y)]
    assert np.intersect1d(*signs).size


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=8), st.text("ab", min_size=1, max_size=8))
def test_edit_distance(a, b):
    edits = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i + k:] for k in (0, 1) for i in range(len(a) + 1) for c in "ab"}
    want = b != a and (b in edits or a in {b[:i] + b[i + 1:] for i in range(len(b))})
    assert spelling.one_edit(a, b) == want
    assert bool(spelling.near([a, b], np.array([0]), np.array([1]))[0]) == want


def test_hash_without_a_letter():
    words = ["abcabca", "zzzzzzz", "gnirtsa"]
    holes, whole = spelling.without_each(spelling.letters(words, 7))
    for row, word in zip(holes, words):
        for i, h in enumerate(row):
            short = word[:i] + word[i + 1:]
            assert h == spelling.without_each(spelling.letters([short], 6))[1][0, 0]
