"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts with the same set of word shingles are one class and compared once.
Classes that agree on a band of MinHash values tie to the band's least class;
what hangs together by these ties is a cluster of candidates, and every pair
that agrees on any band is in one cluster. Clusters are compared tile by tile:
MinHash values a few at a time, dropping pairs as soon as it is improbable that
their similarity reaches the threshold, and what remains by the shingles
themselves. Links leave a tile as counts and as a spanning forest, not as pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import chunks, documents, map_batches, query
from salestally.llm.graph import Forest, components
from salestally.llm.lm import mix64
from salestally.session import cut

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 36, 5  # a pair at 0.8 agrees on no band once in 1.6 million
STEP = 20  # MinHash values compared at a time
TOLERANCE = 1e-9  # drop a pair if the threshold is less probable than this
TILE = 1024  # classes on a side
CHUNK = 4_000_000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


FACTORS, SHIFTS = _odd(BANDS * ROWS, 11), _odd(BANDS * ROWS, 12)


def shingles(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer words make up one shingle."""
    split = [text.encode().split() for text in texts]
    known: dict[bytes, int] = {}
    sizes = [len(words) for words in split]
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, sum(sizes))
    word = mix64(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known)))[ids]
    out, at = [], 0
    for n in sizes:
        own, k = word[at:at + n], min(width, n)
        gram = np.full(n - k + 1 if n else 0, k, np.uint64)
        for i in range(k):
            gram = mix64(gram * np.uint64(0x9E3779B97F4A7C15) + own[i:n - k + 1 + i])
        out.append(np.unique(gram))
        at += n
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash values for each set; none may be empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    every = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(every * f + s, starts) for f, s in zip(FACTORS, SHIFTS)], axis=1)


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS].astype(np.uint64))
    return key.view(np.int64)


def least_matches(n: int, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Matches among ``n`` MinHash values below which the threshold is too improbable.

    With every similarity equally likely before, it is Beta(m + 1, n - m + 1) after ``m`` matches,
    and the part above t is the probability of at most m successes in n + 1 draws of chance t.
    """
    t, tail = float(threshold), 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of the pairs marked in ``alive``, those not dropped, by rows of MinHash values."""
    width = a.shape[1]
    matches = np.zeros(alive.shape, np.int32)
    for start in range(0, width, STEP):
        stop = min(start + STEP, width)
        if alive.sum() * 4 > alive.size:
            for c in range(start, stop):
                matches += a[:, c][:, None] == b[:, c][None]
        else:
            i, j = np.nonzero(alive)
            for part in np.array_split(np.arange(len(i)), len(i) // 200_000 + 1):
                matches[i[part], j[part]] += (a[i[part], start:stop] == b[j[part], start:stop]).sum(1)
        alive = alive & (matches >= least_matches(stop))
        if not alive.any():
            break
    return alive


def verified(a: list[np.ndarray], b: list[np.ndarray], alive: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Of the pairs marked, those whose sets reach the threshold exactly."""
    out = np.zeros(alive.shape, bool)
    rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    if not len(rows):
        return out
    sets = [*(a[i] for i in rows), *(b[j] for j in columns)]
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    left = owner < len(rows)
    shared = np.zeros(len(values), bool)  # only what both sides have can be common
    shared[np.intersect1d(place[left], place[~left])] = True
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], number[place[keep]]
    common = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(place, [start, start + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], place[lo:hi] - start] = 1
        r, c = np.flatnonzero(part[:len(rows)].any(1)), np.flatnonzero(part[len(rows):].any(1))
        if len(r) and len(c):
            common[np.ix_(r, c)] += part[r] @ part[len(rows) + c].T
    common = common.astype(np.int64)
    union = sizes[:len(rows), None] + sizes[None, len(rows):] - common
    out[np.ix_(rows, columns)] = common * threshold.denominator >= union * threshold.numerator
    return out & alive


def _signed(text: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(text, np.int64).tolist())


def classes_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row its key, the hash of its text, ``hi`` and ``lo`` (the class) and the keys of its bands; the
    last three are null without words."""
    body = docs[text].cast("string")
    rows = docs.select(docs[key].cast("long").alias("key"), F.xxhash64(body).alias("hash"), body.alias("body"))

    def run(batches):
        for batch in batches:
            for start, texts in chunks(batch.column("body"), CHUNK):
                sets = shingles(texts)
                full = [i for i, s in enumerate(sets) if len(s)]
                names: list = [(None, None)] * len(sets)
                bands: list = [None] * len(sets)
                if full:
                    for i, keys in zip(full, band_keys(min_hashes([sets[i] for i in full]))):
                        names[i], bands[i] = _signed(xxhash.xxh3_128_digest(sets[i].tobytes())), keys
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(start, len(texts)), batch.column("hash").slice(start, len(texts)), *(pa.array(c, pa.int64()) for c in zip(*names)),
                     pa.array(bands, pa.list_(pa.int64()))], ["key", "hash", "hi", "lo", "bands"])

    return map_batches(rows, run, "key long, hash long, hi long, lo long, bands array<long>")


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row with words ``s_hi`` and ``s_lo`` (the class) and its shingles, packed."""
    rows = docs.select(docs[text].cast("string").alias("body"))

    def run(batches):
        for batch in batches:
            for _, texts in chunks(batch.column("body"), CHUNK):
                sets = [s for s in shingles(texts) if len(s)]
                names = [_signed(xxhash.xxh3_128_digest(s.tobytes())) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["s_hi", "s_lo", "shingles"])

    return map_batches(rows, run, "s_hi long, s_lo long, shingles binary")


def compare(rows: pa.Table) -> pa.Table:
    """The links of a group: whole clusters, or one pair of tiles of a cluster."""
    rows = rows.sort_by([("cluster", "ascending"), ("tile", "ascending"), ("node", "ascending")])
    node = rows["node"].to_numpy()
    fresh = np.r_[True, node[1:] != node[:-1]] if len(node) else np.zeros(0, bool)
    rows = rows.filter(pa.array(fresh))
    node, cluster, tile = (rows[c].to_numpy() for c in ("node", "cluster", "tile"))
    weight = rows["weight"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["shingles"]]
    out: dict[str, list] = {"node": [], "n": [], "tied": []}
    two_tiles = rows.num_rows > 0 and rows["tile_a"][0] != rows["tile_b"][0]
    bounds = np.r_[0, np.flatnonzero(np.diff(cluster)) + 1, len(node)] if len(node) else np.zeros(1, int)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        n, middle = hi - lo, int((tile[lo:hi] == tile[lo]).sum())
        if two_tiles and middle == n:  # one of the tiles is empty
            continue
        own, values = sets[lo:hi], min_hashes(sets[lo:hi])
        if not two_tiles:  # all pairs within
            links = verified(own, own, surviving(values, values, np.triu(np.ones((n, n), bool), 1)))
            links = links | links.T
        else:  # pairs across
            across = verified(own[:middle], own[middle:], surviving(
                values[:middle], values[middle:], np.ones((middle, n - middle), bool)))
            links = np.zeros((n, n), bool)
            links[:middle, middle:], links[middle:, :middle] = across, across.T
        forest = Forest(n)
        for i in np.flatnonzero(links.any(1)).tolist():
            forest.tie(i, np.flatnonzero(links[i]))
        tied: dict[int, list[int]] = {}
        for i, j in forest.edges:
            tied.setdefault(i, []).append(int(node[lo + j]))
        for i in np.flatnonzero(links.any(1)).tolist():
            out["node"].append(int(node[lo + i]))
            out["n"].append(int(weight[lo:hi][links[i]].sum()))
            out["tied"].append(tied.get(i, []))
    return pa.table({"node": pa.array(out["node"], pa.int64()), "n": pa.array(out["n"], pa.int64()),
                     "tied": pa.array(out["tied"], pa.list_(pa.int64()))})


def _joined(docs: DataFrame, key: str, text: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes, and per class its component, the component's least key and its links."""
    made = cut(classes_of(docs, key, text), "jaccard-rows")
    known = made.where("hi is not null").groupBy("hi", "lo").agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"))
    known = cut(known.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    agreed = known.select("node", F.explode("bands").alias("band"))
    buckets = cut(agreed.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                  .select(F.col("band").alias("b_band"), "first"), "jaccard-bands")
    ties = agreed.join(buckets, F.col("band") == F.col("b_band")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    clusters = cut(components(ties), "jaccard-clusters")
    sizes = clusters.groupBy("component").agg(F.count("node").alias("size")).withColumnRenamed("component", "c")
    n_groups = max(1, clusters.count() // tile)
    member = (clusters.join(sizes, F.col("component") == F.col("c"))
              .withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
              .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
              .select(F.col("node").alias("m_node"), F.col("component").alias("cluster"), "tiles", "tile"))
    member = cut(known.drop("bands").join(member, F.col("node") == F.col("m_node")).drop("m_node"), "jaccard-members")
    wanted = member.select(F.coalesce(F.col("least"), F.lit(0)).alias("w_key"), F.col("least").isNull().alias("w_null")).distinct()
    source = docs.join(wanted, (F.coalesce(docs[key].cast("long"), F.lit(0)) == F.col("w_key"))
                       & (docs[key].isNull() == F.col("w_null")), "left_semi")
    rows = sets_of(source, key, text).join(member, (F.col("s_hi") == F.col("hi")) & (F.col("s_lo") == F.col("lo")))
    # a class goes to the group of its tile and every tile; small clusters share groups
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("cluster"), F.lit(n_groups))).otherwise(F.col("cluster")).alias("part"),
        F.when(F.col("tiles") == 1, -1).otherwise(F.least("tile", "other")).alias("tile_a"),
        F.when(F.col("tiles") == 1, -1).otherwise(F.greatest("tile", "other")).alias("tile_b"),
        "cluster", "tile", "node", "weight", "shingles")
    found = rows.groupBy("part", "tile_a", "tile_b").applyInArrow(compare, "node long, n long, tied array<long>")
    found = cut(found, "jaccard-links")
    n = found.groupBy("node").agg(F.sum("n").alias("n")).withColumnRenamed("node", "n_node")
    parts = components(found.select(F.col("node").alias("a"), F.explode("tied").alias("b"))).withColumnRenamed("node", "p_node")
    linked = known.select("hi", "lo", "least", "weight", "node").join(parts, F.col("node") == F.col("p_node"), "left")
    linked = linked.join(n, F.col("node") == F.col("n_node"), "left").withColumn("component", F.coalesce("component", "node"))
    least = linked.groupBy("component").agg(F.min("least").alias("class_id")).withColumnRenamed("component", "l_component")
    verdict = linked.join(least, F.col("component") == F.col("l_component")).select(
        F.col("hi").alias("v_hi"), F.col("lo").alias("v_lo"), F.col("component").alias("v_component"), "class_id",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    verdict = cut(verdict, "jaccard-verdicts")
    return made, verdict


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id`` (least key of all rows linked with it,
    directly or by others) and ``n_links`` (other rows of Jaccard similarity 0.8 or more).

    Rows without words (null, empty, blank) have no links and are classes of their own. Fewer
    than five words are one shingle. Repeated rows link with each other. Rows with a null key
    take part; the class of a group without any key is null. An empty table gives an empty table.
    """
    made, verdict = _joined(docs, key, text, tile)
    with_words = made.where("hi is not null").join(verdict, (F.col("hi") == F.col("v_hi")) & (F.col("lo") == F.col("v_lo")))
    alone = made.where("hi is null").select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.select("key", "class_id", "n_links").union(alone).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each group of linked rows: the one of the least key (null last).

    Of rows that repeat one another one stays. Rows without words all stay.
    """
    made, verdict = _joined(docs, key, text, tile)
    with_words = made.where("hi is not null").join(verdict, (F.col("hi") == F.col("v_hi")) & (F.col("lo") == F.col("v_lo")))
    chosen = with_words.groupBy("v_component").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("one")).select("one.*")
    alone = made.where("hi is null").select(F.col("key").isNull().alias("none"), "key", "hash").distinct()
    kept = cut(chosen.union(alone).select(F.col("none").alias("k_none"), F.coalesce("key", F.lit(0)).alias("k_key"),
                                          F.coalesce("hash", F.lit(0)).alias("k_hash")), "jaccard-kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].isNull().alias("none"),
                       F.coalesce(docs[key].cast("long"), F.lit(0)).alias("key"),
                       F.coalesce(F.xxhash64(docs[text].cast("string")), F.lit(0)).alias("hash"))
    same = [F.col(c) == F.col("k_" + c) for c in ("none", "key", "hash")]
    out = rows.join(kept, same, "left_semi").groupBy("none", "key", "hash").agg(F.first("row").alias("row"))
    return out.select("row.*")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc_id, (SELECT min(b) FROM reach WHERE a = doc_id) AS class_id,
       (SELECT count(*) FROM link WHERE a = doc_id) AS n_links,
       doc_id = (SELECT min(b) FROM reach WHERE a = doc_id) AS kept
FROM d
"""


@query("op7_jaccard_join", OP7_SQL)
def op7_jaccard_join(spark, sf_dir):
    """Every document's class of near copies and its number of links."""
    out = similar(documents(spark, sf_dir))
    return out.select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
