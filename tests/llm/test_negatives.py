"""Hard negatives against a plain version over all pairs in Python's integers."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from salestally.llm import QUERIES, negatives


def plain(rows):
    took = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        took.append((key, [math.floor(256 * Fraction(x)) for x in vector], (label + 1) % 10 if key % 7 == 0 else label))
    anchors = {}
    for key, q, label in sorted(took, key=lambda r: (r[0], r[2])):
        if key % 50 == 0:
            anchors.setdefault(key, (q, label))
    out = Counter()
    for key, (q, label) in anchors.items():
        scored = [(sum(a * b for a, b in zip(q, v)), k, l) for k, v, l in took if len(v) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, k, _ in [s for s in scored if s[2] == label and s[1] != key][:5]:
            inside = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score]
            for rank, (n, other, _) in enumerate(inside[:3], 1):
                out[key, k, rank, other, score, n] += 1
    return out


def vectors(n, dim, seed, labels=4, spread=0.3):
    """Around a few centres, in shorter and longer forms."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * spread
    x *= rng.uniform(0.2, 2, (n, 1))
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


def odd():
    rows = vectors(300, 6, 2)
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(90)]  # ties
    rows += [(2000, None, 1), (2050, [0.1, None] * 3, 1), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] * 6, 2), (2200, [0.3] * 6, None),
             (None, [0.4] * 6, 1), (2250, [0.0] * 6, 1), (2300, [], 1), (2301, [], 1), (2302, [], 2), (2350, [0.7], 0), (2351, [0.9], 0),
             (2352, [0.6], 1), (2353, [0.6], 0), (2400, [-0.5] * 6, 1), (3001, [0.5] * 6, 1), (3001, [0.5] * 6, 1), (3001, [0.25] * 6, 2)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block, tile, window", [(4096, 1024, 128), (32, 5, 8)])
def test_against_plain(spark, monkeypatch, block, tile, window):
    for name, value in (("BLOCK", block), ("TILE", tile), ("WINDOW", window)):
        monkeypatch.setattr(negatives, name, value)
    for rows in (odd(), vectors(900, 12, 3, labels=9, spread=0.05)):
        found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert Counter(map(tuple, found)) == plain(rows)


def test_wide_vectors(spark):
    """Beyond the exact range of doubles scores are still whole numbers."""
    big = 2.0 ** 21
    rows = [(50 * i, [big + i, 3.0, 1.0], 0) for i in range(3)] + [(7 * i + 1, [big * 0.8 + i, 1.0, 0.5], 1 + i % 2) for i in range(40)]
    rows += [(1000 + i, [big + i * 2.0 ** -20, 1 / 3, 5.0], 0) for i in range(1, 8)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, found)) == plain(rows) and found


def test_repeated_anchors_and_other_columns(spark):
    rows = vectors(200, 5, 4)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("rank"), F.lit(2).alias("score"), F.lit(3).alias("anchor"), F.lit(4).alias("size"))
    assert Counter(map(tuple, negatives.hard_negatives(df).collect())) == plain(rows)
    again = rows + [(50, rows[50][1], rows[50][2])]
    found = Counter(map(tuple, negatives.hard_negatives(spark.createDataFrame(again, SCHEMA)).collect()))
    assert found == plain(again)


def test_none(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).collect() == []


def test_bounds_hold():
    """No inner product lies outside its bounds, and they leave out most of what is far away."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * (rng.normal(size=(400, 16)) + 3 * rng.normal(size=(4, 16))[rng.integers(0, 4, 400)]))
    refs = negatives.directions(x)
    angles = np.arccos(np.clip(negatives.unit(x) @ refs.T, -1, 1))
    norms = np.linalg.norm(x, axis=1)
    out = 0
    for start in range(0, 400, 40):
        part = slice(start, start + 40)
        low, high = negatives.score_bounds(angles, angles, angles[part].min(0), angles[part].max(0), norms[part].min(), norms[part].max(), norms)
        scores = x @ x[part].T
        assert (scores >= low[:, None]).all() and (scores <= high[:, None]).all()
    order = np.lexsort([angles.min(1), angles.argmin(1)])
    for start in range(0, 400, 20):
        part = order[start:start + 20]
        low, high = negatives.score_bounds(angles, angles, angles[part].min(0), angles[part].max(0), norms[part].min(), norms[part].max(), norms)
        out += (high < 0.8 * norms * norms[part].max()).mean()
    assert out / 20 > 0.5


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>)", "label").collect()]
    assert Counter(map(tuple, QUERIES["op13_hard_negatives"](spark, folder).collect())) == plain(rows)
