"""Spelling variants of words, by PartEnum signatures over letter multisets.

A word is the set of its letters, each numbered by its occurrence (the second a is another
element than the first), a binary vector. One replaced letter takes an element away and puts
another in, so the vectors of two such words differ in two places; with an inserted or
deleted letter they differ in one. The elements are parted into classes by a hash. Where at most
k differ, at least n - k of n classes are equal, so a signature for each choice of n - k classes
gives any such pair a signature in common. Words of one length meet by signatures for two
differences, words whose lengths differ by one by signatures for one. Pairs that meet are
verified by edit distance.

A signature that very many words share is not joined. Its words are given a signature for every
place instead, that of the word without the letter there; words that share one of those are
near each other, and an alphabet's size bounds their number.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import documents, map_batches, query
from salestally.session import cut

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SLIP = 31  # a run whose hash this divides loses a letter
LEAST_LENGTH, LEAST_COUNT = 7, 2
# runs that are long enough for a word; a letter less makes none longer
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
FORM = 10  # so many times more frequent is the form of a word
HELD = 200_000  # words that a task counts before it hands them on
# classes of elements: for two differences (words of one length), for one
CLASSES_2, CLASSES_1 = 5, 3
GROUP = 32  # words of a signature that are compared with each other

COUNT_SCHEMA = "word string, n long"


# --- words and their counts ------------------------------------------------------------


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(LOWER)


def slipped(run: str, before: int) -> str:
    """The lower-cased run, a letter less where the hash says so; ``before``: crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), before)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences in ``df``.

    A document's runs are counted first, since all equal ones of a document slip alike; a task
    hands on sums over its documents.
    """
    rows = df.select(F.coalesce(df[key].cast("string"), F.lit("")).alias("key"), df[text].cast("string").alias("body"))

    def run(batches):
        sums: Counter[str] = Counter()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())],
                                             ["word", "n"])
            sums.clear()
            return out

        for rows in batches:
            for key, body in zip(rows.column("key"), rows.column("body")):
                before = zlib.crc32(f"{key.as_py()}:".encode())
                runs: Counter[str] = Counter()
                for found, n in Counter(RUN.findall(body.as_py() or "")).items():
                    runs[lowered(found)] += n
                for found, n in runs.items():
                    word = slipped(found, before)
                    if len(word) >= LEAST_LENGTH:
                        sums[word] += n
                if len(sums) > HELD:
                    yield batch()
        if sums:
            yield batch()

    parts = map_batches(rows, run, COUNT_SCHEMA)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- signatures ---------------------------------------------------------------------------

# multipliers that spread a number over all its bits (those of a known generator)
SPREAD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits spread over all of them."""
    x = (x ^ (x >> np.uint64(30))) * SPREAD[0]
    x = (x ^ (x >> np.uint64(27))) * SPREAD[1]
    return x ^ (x >> np.uint64(31))


def letters(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size).astype(np.uint64)


def multiset_signatures(codes: np.ndarray, classes: int, differences: int, salt: int) -> np.ndarray:
    """For each choice of ``classes - differences`` classes the sum of its elements' hashes, a column each."""
    codes = np.sort(codes, axis=1)
    place = np.arange(codes.shape[1], dtype=np.uint64)
    begins = np.ones(codes.shape, bool)
    begins[:, 1:] = codes[:, 1:] != codes[:, :-1]
    nth = place - np.maximum.accumulate(np.where(begins, place, np.uint64(0)), axis=1)
    element = mixed(codes << np.uint64(32) | nth)
    part = mixed(element + np.uint64(classes)) % np.uint64(classes)
    sums = np.stack([np.where(part == np.uint64(c), element, np.uint64(0)).sum(axis=1, dtype=np.uint64) for c in range(classes)], axis=1)
    out = []
    for number, chosen in enumerate(combinations(range(classes), classes - differences)):
        out.append(mixed(sums[:, list(chosen)].sum(axis=1, dtype=np.uint64) + mixed(np.uint64([number << 40 | salt]))))
    return np.stack(out, axis=1)


STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
UNSTEP = np.uint64(pow(STEP, -1, 1 << 64))


def without_each(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of one length without their first, second, ... letter, and of the whole words."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(codes.shape[1] - 1, STEP, np.uint64)])
    sums = np.cumsum((codes + np.uint64(1)) * powers, axis=1)
    before = np.concatenate([np.zeros((len(codes), 1), np.uint64), sums[:, :-1]], axis=1)
    return before + (sums[:, -1:] - sums) * UNSTEP, sums[:, -1:]


# kinds of a signature: of words of one length; of the shorter and the longer word of a pair
SAME, SHORT, LONG = 0, 1, 2
SIGNED_SCHEMA = "sign long, kind byte, word string, n long"


def _signed_rows(words: DataFrame, sign, kinds: tuple[int, ...]) -> DataFrame:
    """One row for each signature that ``sign(codes, kind)`` gives to words of one length."""
    def run(batches):
        for batch in batches:
            held = batch.column("word").to_pylist()
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            for size in np.unique(sizes).tolist():
                places = np.flatnonzero(sizes == size)
                step = max(1, 40_000 // size)
                for start in range(0, len(places), step):
                    some = places[start:start + step]
                    codes = letters([held[i] for i in some.tolist()], size)
                    for kind in kinds:
                        signs = sign(codes, kind)
                        own = batch.take(pa.array(np.repeat(some, signs.shape[1])))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(signs.ravel().view(np.int64)), pa.array(np.full(signs.size, kind, np.int8)), own.column("word"), own.column("n")],
                            ["sign", "kind", "word", "n"])

    return map_batches(words, run, SIGNED_SCHEMA)


def signatures(words: DataFrame) -> DataFrame:
    """Rows ``sign``, ``kind``, ``word``, ``n``. The length is part of a signature: that of the shorter word of a pair."""
    def sign(codes: np.ndarray, kind: int) -> np.ndarray:
        size = codes.shape[1]
        if kind == SAME:
            return multiset_signatures(codes, CLASSES_2, 2, 2 * size)
        return multiset_signatures(codes, CLASSES_1, 1, 2 * size + (1 if kind == SHORT else -1))

    return _signed_rows(words, sign, (SAME, SHORT, LONG))


def place_signatures(words: DataFrame, same: bool) -> DataFrame:
    """Signatures under which only words meet that differ by one letter: for words of one length those
    without the letter at each place, else the whole of the shorter and the longer without a letter."""
    def sign(codes: np.ndarray, kind: int) -> np.ndarray:
        holes, whole = without_each(codes)
        size = codes.shape[1]
        if kind == SAME:
            return mixed(holes ^ mixed((np.uint64(size) << np.uint64(32)) + np.arange(size, dtype=np.uint64)))
        if kind == SHORT:
            return mixed(whole + np.uint64(size))
        return mixed(holes + np.uint64(size - 1))

    return _signed_rows(words, sign, (SAME,) if same else (SHORT, LONG))


# --- pairs ------------------------------------------------------------------------------------

MEASURED = 48  # letters of words that are compared side by side; longer ones are compared one by one
MET_SCHEMA = "a string, a_n long, b string, b_n long, kind byte"


def one_edit(a: str, b: str) -> bool:
    """Do words differ by one letter, replaced or put in?"""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def near(words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of places hold words at an edit distance of one."""
    out = np.zeros(len(left), bool)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = (sizes[left] < MEASURED) & (sizes[right] < MEASURED)
    for i in np.flatnonzero(~short).tolist():
        out[i] = one_edit(words[left[i]], words[right[i]])
    table = np.array([w if len(w) < MEASURED else "" for w in words], f"<U{MEASURED}").view("<u4").reshape(len(words), MEASURED)
    where = np.arange(MEASURED - 1)
    todo = np.flatnonzero(short)
    for start in range(0, len(todo), 50_000):
        some = todo[start:start + 50_000]
        swap = sizes[left[some]] > sizes[right[some]]
        a, b = np.where(swap, right[some], left[some]), np.where(swap, left[some], right[some])
        x, y = table[a], table[b]
        differ = x != y
        count, first = differ.sum(axis=1), differ.argmax(axis=1)
        more = sizes[b] - sizes[a]
        # behind the first difference the longer word goes on one letter later
        late = ((x[:, :-1] != y[:, 1:]) & (where >= first[:, None])).any(axis=1)
        out[some] = np.where(more == 0, count == 1, (more == 1) & ~late)
    return out


def met(signed: DataFrame, most: int | None) -> DataFrame:
    """Verified pairs among words that share a signature, ``a`` and ``b`` with their counts; words of a
    signature that more than ``most`` share are given back as ``a`` with their ``kind``, without ``b``.

    Rows are dealt by signature and sorted; a task goes through them and holds one signature's words at a
    time, at most ``most`` of them. Under a place signature (no ``most``) their number is bounded by the alphabet.
    """
    dealt = signed.repartition("sign").sortWithinPartitions("sign", "kind")

    def pairs(rows: pa.RecordBatch, begins: np.ndarray):
        """Pairs inside groups that begin at the given places."""
        kind = rows.column("kind").to_numpy()
        n = len(kind)
        group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, n]))
        ends = np.r_[begins[1:], n][group]
        # the first place behind the shorter words of a group
        shorts = np.bincount(group, kind == SHORT, len(begins)).astype(np.int64)
        from_ = np.where(kind == SAME, np.arange(n) + 1, (begins + shorts)[group])
        count = np.where(kind == LONG, 0, ends - from_)
        left = np.repeat(np.arange(n), count)
        right = np.repeat(from_ - (np.cumsum(count) - count), count) + np.arange(len(left))
        if len(left):
            words = rows.column("word").to_pylist()
            for start in range(0, len(left), 500_000):
                part = slice(start, start + 500_000)
                found = near(words, left[part], right[part])
                a, b = rows.take(pa.array(left[part][found])), rows.take(pa.array(right[part][found]))
                # one way round for a pair that meets under several signatures
                first = np.array([words[i] < words[j] for i, j in zip(left[part][found].tolist(), right[part][found].tolist())], bool)
                first = pa.array(first)
                pick = lambda c, x, y: pc.if_else(first, x.column(c), y.column(c))
                if a.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pick("word", a, b), pick("n", a, b), pick("word", b, a), pick("n", b, a), pa.nulls(a.num_rows, pa.int8())],
                        ["a", "a_n", "b", "b_n", "kind"])

    def many(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), rows.column("kind")],
                                          ["a", "a_n", "b", "b_n", "kind"])

    def run(batches):
        held, full = None, None  # the last group so far; the signature whose words are given back as they come
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield from step(rows, full, last=False)
            held, full = tail(rows, full)
        if held is not None:
            yield from step(held, full, last=True)

    def key(rows: pa.RecordBatch) -> np.ndarray:
        return rows.column("sign").to_numpy() ^ (rows.column("kind").to_numpy() == SAME)

    def groups(rows: pa.RecordBatch) -> np.ndarray:
        signs = key(rows)
        return np.r_[0, np.flatnonzero(signs[1:] != signs[:-1]) + 1]

    def tail(rows: pa.RecordBatch, full):
        """The last group, and whether it is given back; none of what was given back is kept but one row."""
        start = int(groups(rows)[-1])
        sign = key(rows)[start]
        if most and (full == sign or rows.num_rows - start > most):
            return rows.slice(rows.num_rows - 1), sign
        return rows.slice(start), None

    def step(rows: pa.RecordBatch, full, last: bool):
        begins, signs = groups(rows), key(rows)
        sizes = np.diff(np.r_[begins, rows.num_rows])
        whole = np.ones(len(begins), bool)
        if not last:
            whole[-1] = False  # goes on in the next batch
        big = np.zeros(len(begins), bool)
        if most:
            big = sizes > most
            if full is not None and signs[0] == full:
                big[0] = True
        group = np.repeat(np.arange(len(begins)), sizes)
        out = big[group]
        if full is not None and signs[0] == full:
            out[0] = False  # was given back before
        if out.any():
            yield many(rows.filter(pa.array(out)))
        small = whole & ~big & (sizes > 1)
        if small.any():
            some = rows.filter(pa.array(small[group]))
            counts = sizes[small]
            yield from pairs(some, np.cumsum(counts) - counts)

    return map_batches(dealt, run, MET_SCHEMA)


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of words at an edit distance of one, once each: ``a``, ``a_n``, ``b``, ``b_n``."""
    found = cut(met(signatures(words), GROUP), "met-words")
    # a word under a frequent signature is signed by its places, once for its meetings with words of its
    # length and once for the others; a pair meets there, for the signature is frequent for both
    frequent = found.where("b is null").select(F.col("a").alias("word"), F.col("a_n").alias("n"), (F.col("kind") == SAME).alias("same")).distinct()
    frequent = cut(frequent, "frequent-words")
    by_place = place_signatures(frequent.where("same"), True).union(place_signatures(frequent.where("not same"), False))
    pairs = found.where("b is not null").union(met(by_place, None))
    return pairs.select("a", "a_n", "b", "b_n").dropDuplicates(["a", "b"])


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of ``df``: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    A null or empty text has no words, a null key counts as empty in the hash, and repeated rows
    count each time. Words of any length are taken. Among near words of equal count the first in
    code-point order is the form. An empty table gives an empty table; further columns of
    ``df`` are not looked at, so none can clash.
    """
    words = cut(word_counts(df, key, text), "words")
    pairs = cut(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("w"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("other")).union(
        pairs.select(F.col("b").alias("w"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("other")))
    nears = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("first"))
    out = words.join(nears, F.col("word") == F.col("w"), "left")
    formed = F.col("first.near").isNotNull() & (-F.col("first.less") >= FORM * F.col("n"))
    out = cut(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(formed, F.col("first.near")).alias("form"), F.when(formed, -F.col("first.less")).alias("form_n")), "forms")
    up = roots(out).select(F.col("word").alias("w"), F.col("root").alias("last"))
    return out.join(up, F.col("word") == F.col("w"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("last", "word").alias("root"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words that have a form.

    Every step makes a count ten times larger, which bounds their number; each round doubles
    the steps that are taken.
    """
    up = cut(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    top = forms.agg(F.max("form_n")).first()[0]
    steps = len(str(top)) if top else 1
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        next_ = up.select(F.col("word").alias("w"), F.col("root").alias("further"))
        up = cut(up.join(next_, F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("further", "root").alias("root")), "roots")
    return up


@query("op11_spelling")
def op11_spelling(spark, sf_dir):
    """All words of the documents with their near words and forms."""
    return variants(documents(spark, sf_dir))
