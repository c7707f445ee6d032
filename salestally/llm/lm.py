"""Language-model scores: stupid backoff, with counts from all other documents.

``S(w | u v) = c(u v w) / c(u v)`` where the triple occurs in another document, else
``0.4 S(w | v)``, and so on down to ``c(w) / N``. A document's own n-grams are taken off
all counts, for otherwise every n-gram would be known.

One row per n-gram would move many times the text. So documents are dealt into
blocks of a few million characters. A block sends the hashes of its distinct
n-grams, with their counts in it, packed into one row per length and range of
hashes. The count tables, partitioned by these ranges, add up what all blocks sent and
answer with totals, and the block's documents, joined with the answers, sum
the scores of their n-grams. An n-gram common to all documents arrives once per
block, so no range of hashes is larger than others.

Words and pairs are asked for first. A longer n-gram is asked for only where
other documents have both n-grams it is made of, since otherwise none of them has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import arrow_schema, documents, query, ship

ORDER = 3
BACKOFF = 0.4
BLOCK = 8_000_000  # bytes of text in a block, about
TOTAL = np.uint64(0)  # stands for all words together
AT_ONCE = 2  # lengths asked for first, without knowing anything


def mix64(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits in which every bit tells on every other (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of some texts, length by length.

    ``doc``: the text of every word; ``into``: its place there. For the length k + 1: ``grams[k]``
    are the sorted distinct hashes, for words with ``TOTAL`` first; ``counts[k]`` their counts here;
    ``place[k]`` for every word the index of the n-gram that ends there, -1 where none does or
    none was asked for; ``others[k]`` how often other texts have it.
    """

    def __init__(self, texts: list[str]):
        split = [text.encode().split() for text in texts]
        self.sizes = np.array([len(words) for words in split], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, self.sizes.sum())
        hashes = mix64(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))) | np.uint64(1)
        self.distinct, place = np.unique(hashes, return_inverse=True)
        self.index = place[ids]
        self.word = hashes[ids]
        self.into = np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.last = self.word  # hashes of the longest n-grams so far
        self.grams, self.counts, self.place, self.others = [], [], [], []

    def add(self) -> None:
        """The next length."""
        k = len(self.grams)
        if k:
            longer = np.zeros_like(self.last)
            longer[1:] = mix64(self.last[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.word[1:] + np.uint64(k)) | np.uint64(1)
            self.last = longer
            ends = self.into >= k
            if k >= AT_ONCE:
                seen = self.others[k - 1] > 0
                ends[1:] &= seen[1:] & seen[:-1]
            grams, inverse, counts = np.unique(self.last[ends], return_inverse=True, return_counts=True)
            place = np.full(len(self.word), -1)
            place[ends] = inverse
        else:
            grams, place = np.r_[TOTAL, self.distinct], self.index + 1
            counts = np.r_[len(self.word), np.bincount(self.index, minlength=len(self.distinct))]
        self.grams.append(grams)
        self.counts.append(counts)
        self.place.append(place)

    def take(self, answers: pa.Table) -> None:
        """What the count tables say about every length they were asked for."""
        n_docs = len(self.sizes)
        for k in sorted(set(answers.column("length").to_pylist())):
            if len(self.grams) <= k:
                self.add()
            cells = answers.filter(pc.equal(answers.column("length"), k)).sort_by("part")
            totals = np.concatenate([unplanes(x.as_py()) for x in cells.column("totals")]).astype(np.int64)
            if not k:
                self.n_words = int(totals[0])
            others, here = np.zeros(len(self.word), np.int64), self.place[k]
            some = np.flatnonzero((here >= 0) & (totals[here] > 1))  # what occurs once, no other text has
            _, inverse, own = np.unique(here[some] * n_docs + self.doc[some], return_inverse=True, return_counts=True)
            others[some] = totals[here[some]] - own[inverse]
            self.others.append(others)

    def cells(self, lengths: range, bits: int) -> list[tuple]:
        """Per length and range of hashes: both, n-grams, counts."""
        out = []
        for k in lengths:
            grams, counts = self.grams[k], self.counts[k].astype(np.uint64)
            cuts = np.array([0, len(grams)])
            if bits:
                cuts = np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for i in np.flatnonzero(np.diff(cuts)):
                one = slice(cuts[i], cuts[i + 1])
                out.append((k, int(i), planes(np.diff(grams[one], prepend=TOTAL)), planes(counts[one])))
        return out

    def scores(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its words' log scores, and how many words fell back to the
        count of the word alone. Words that no other text has count as seen once."""
        n_docs, n = len(self.sizes), len(self.doc)
        none = np.zeros(n, np.int64)
        others = self.others + [none] * (order - len(self.others))
        score = np.log(np.maximum(others[0], 1) / np.maximum(self.n_words - self.sizes, 1)[self.doc])
        alone = np.ones(n, bool)
        for k in range(1, order):
            context = none.copy()
            context[1:] = others[k - 1][:-1]  # the n-gram before this word
            seen = others[k] > 0
            # each length that was tried in vain costs a factor, for words that have one so long
            score = np.where(seen, np.log(np.maximum(others[k], 1) / np.maximum(context, 1)),
                             score + np.where(self.into >= k, np.log(BACKOFF), 0))
            alone &= ~seen
        # without words there is nothing to sum, and the sums would be whole numbers
        return np.bincount(self.doc, score, n_docs).astype(float), np.bincount(self.doc, alone, n_docs).astype(np.int64)


def score(docs: DataFrame, text: str = "text", order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs`` but the text, with ``lm_words``, ``lm_log_score`` (natural logarithm,
    summed over words) and ``lm_alone`` (words scored by their own count only).

    Null and empty texts have no words and score 0. Repeated rows count as different documents.
    A very long text is a block of its own. Nothing depends on the order of rows or of equal counts.
    Other columns pass untouched, whatever their names but those three. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    n_blocks = max(1, -(-size // block))
    bits = (n_blocks - 1).bit_length()
    row = F.struct(F.lit(0).alias("lm_row"), *[docs[c] for c in docs.columns if c != text])
    dealt = docs.select(row.alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("body"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row", "body", F.monotonically_increasing_id()), F.lit(n_blocks)))

    def asked(rows: pa.Table, here: Block, lengths: range) -> pa.Table:
        cells = here.cells(lengths, bits)
        columns = [list(c) for c in zip(*cells)] or [[], [], [], []]
        block = [rows.column("block")[0].as_py()] * len(cells)
        return pa.table([pa.array(c, t) for c, t in zip([block, *columns], ASKED.types)], schema=ASKED)

    def ask(rows: pa.Table) -> pa.Table:
        here, lengths = Block(rows.column("body").to_pylist()), range(min(order, AT_ONCE))
        for _ in lengths:
            here.add()
        return asked(rows, here, lengths)

    def ask_longer(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return ASKED.empty_table()
        here = Block(rows.column("body").to_pylist())
        here.take(answers)
        k = len(here.others)
        here.add()
        return asked(rows, here, range(k, k + 1))

    def answer(rows: pa.Table) -> pa.Table:
        grams = [np.cumsum(unplanes(x.as_py()), dtype=np.uint64) for x in rows.column("grams")]
        counts = np.concatenate([unplanes(x.as_py()) for x in rows.column("counts")])
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(inverse, counts)[inverse].astype(np.uint64)
        ends = np.cumsum([len(g) for g in grams])
        return pa.table({"block": rows.column("block"), "length": rows.column("length"), "part": rows.column("part"),
                         "totals": pa.array([planes(t) for t in np.split(totals, ends[:-1])], pa.binary())})

    def sum_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out_arrow.empty_table()
        here = Block(rows.column("body").to_pylist())
        here.take(answers)
        scores, alone = here.scores(order)
        return pa.table({"row": rows.column("row"), "lm_words": here.sizes, "lm_log_score": scores, "lm_alone": alone})

    def answered(asked: DataFrame) -> DataFrame:
        out = asked.groupBy("length", "part").applyInArrow(answer, "block long, length int, part long, totals binary")
        return out.repartition("block")  # dealt out once, for the next length and for the sums

    out_schema = dealt.select("row", F.lit(0).cast("long").alias("lm_words"), F.lit(0.0).alias("lm_log_score"),
                              F.lit(0).cast("long").alias("lm_alone")).schema
    out_arrow = arrow_schema(out_schema)
    fields = "block long, length int, part long, grams binary, counts binary"
    # the same columns every time, so that Spark deals out the texts once for all
    blocks = dealt.groupBy("block")
    answers = answered(blocks.applyInArrow(ask, fields))
    for _ in range(AT_ONCE, order):
        longer = blocks.cogroup(answers.groupBy("block")).applyInArrow(ask_longer, fields)
        answers = answers.union(answered(longer))
    out = blocks.cogroup(answers.groupBy("block")).applyInArrow(sum_up, out_schema)
    return out.select("row.*", "lm_words", "lm_log_score", "lm_alone").drop("lm_row")


ASKED = pa.schema([("block", pa.int64()), ("length", pa.int32()), ("part", pa.int64()),
                   ("grams", pa.binary()), ("counts", pa.binary())])


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte: all first bytes, then all second ones, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unplanes(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (
  SELECT id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v, CASE WHEN i > 2 THEN w[i - 2] END AS u
  FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one_own AS (SELECT id, w, count(*) AS c FROM word GROUP BY id, w),
one AS (SELECT w, sum(c) AS c FROM one_own GROUP BY w),
two_own AS (SELECT id, v, w, count(*) AS c FROM word WHERE v IS NOT NULL GROUP BY id, v, w),
two AS (SELECT v, w, sum(c) AS c FROM two_own GROUP BY v, w),
three_own AS (SELECT id, u, v, w, count(*) AS c FROM word WHERE u IS NOT NULL GROUP BY id, u, v, w),
three AS (SELECT u, v, w, sum(c) AS c FROM three_own GROUP BY u, v, w),
-- how often other documents have an n-gram
o1 AS (SELECT x.id, x.w, a.c - x.c AS c FROM one_own x JOIN one a USING (w)),
o2 AS (SELECT x.id, x.v, x.w, a.c - x.c AS c FROM two_own x JOIN two a USING (v, w)),
o3 AS (SELECT x.id, x.u, x.v, x.w, a.c - x.c AS c FROM three_own x JOIN three a USING (u, v, w)),
counted AS (
  SELECT x.id, x.u, x.v, w1.c AS c_w, v1.c AS c_v, coalesce(vw.c, 0) AS c_vw, uv.c AS c_uv, coalesce(uvw.c, 0) AS c_uvw,
         greatest((SELECT count(*) FROM word) - len(d.w), 1) AS n
  FROM word x JOIN d ON d.id = x.id JOIN o1 w1 ON w1.id = x.id AND w1.w = x.w
  LEFT JOIN o1 v1 ON v1.id = x.id AND v1.w = x.v
  LEFT JOIN o2 vw ON vw.id = x.id AND vw.v = x.v AND vw.w = x.w
  LEFT JOIN o2 uv ON uv.id = x.id AND uv.v = x.u AND uv.w = x.v
  LEFT JOIN o3 uvw ON uvw.id = x.id AND uvw.u = x.u AND uvw.v = x.v AND uvw.w = x.w),
scored AS (
  SELECT id, c_uvw <= 0 AND c_vw <= 0 AS alone,
         CASE WHEN c_uvw > 0 THEN ln(c_uvw / greatest(c_uv, 1))
              WHEN c_vw > 0 THEN ln(c_vw / greatest(c_v, 1)) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
              ELSE ln(greatest(c_w, 1) / n) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END
                   + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM counted)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(count(*) FILTER (s.alone) AS BIGINT) AS n_alone,
       round(coalesce(sum(s.s), 0), 3) AS log_score, round(sum(s.s) / len(d.w), 6) AS mean_log_score
FROM d LEFT JOIN scored s USING (id) GROUP BY d.id, d.doc_id, d.w
"""


@query("op10_lm_scoring", OP10_SQL)
def op10_lm_scoring(spark, sf_dir):
    """Every document's score under the words, pairs and triples of all other documents."""
    out = score(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("lm_words").alias("n_words"), F.col("lm_alone").alias("n_alone"),
        (F.round(F.col("lm_log_score"), 3) + 0.0).alias("log_score"),
        F.when(F.col("lm_words") > 0, F.round(F.col("lm_log_score") / F.col("lm_words"), 6)).alias("mean_log_score"))
