"""A quality classifier over document statistics.

Random Fourier features stand in for a Gaussian kernel: cosines of random
projections of the standardised statistics. Each partition sums its part of
the normal equations, the sums give ridge scores, and isotonic regression on
labels kept apart turns scores into probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.llm.common import documents, fresh, map_batches, query, ship, table
from salestally.session import cut

# labelled rows that the model is fitted on at most; chosen by the hash of their ids
MAX_ROWS = 500_000
FEATURES = 256  # random features
RIDGE = 0.1
WIDTH = 1.5  # of the kernel, for statistics of standard deviation 1, times the root of their number
BINS = 2048  # of raw scores, for the calibration
SEED = 5

STATISTICS = ["log words", "log bytes", "bytes per word", "upper case", "digits", "markup symbols", "stops",
              "exclamation marks", "not ASCII", "lines per word", "bytes per line", "different words",
              "repeated lines", "commonest word", "words of one byte", "words that end in a symbol", "compressed"]


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


KINDS = np.stack([
    _kind(bytes(range(65, 91))), _kind(b"0123456789"), _kind(b"#*$%&|<>=_{}[]~^\\@"), _kind(b".,;:?"), _kind(b"!"),
    np.r_[np.zeros(128), np.ones(128)],
])
SYMBOL_ENDS = frozenset(b"#*$%&|<>!=_~^")


def statistics(text: str) -> list[float]:
    """Of one whole text, an empty one included; see ``STATISTICS``."""
    raw = text.encode()
    words, lines = raw.split(), [line for line in raw.split(b"\n") if line.strip()]
    n, size = len(words), len(raw)
    shares = KINDS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(size, 1)
    counts = Counter(words)
    most = max(counts.values(), default=0)
    return [
        np.log1p(n), np.log1p(size), size / (n + 1), *shares, (len(lines) + 1) / (n + 1), np.log1p(size / (len(lines) + 1)),
        (len(counts) + 1) / (n + 1), 1 - (len(set(lines)) + 1) / (len(lines) + 1), most / (n + 1),
        sum(c for w, c in counts.items() if len(w) == 1) / (n + 1),
        sum(c for w, c in counts.items() if w[-1] in SYMBOL_ENDS) / (n + 1),
        (len(zlib.compress(raw, 1)) + 20) / (size + 20),
    ]


def with_statistics(df: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """``df`` without the text, with its statistics as an array. Null counts as empty."""
    own, = fresh(df, "text_in")
    rows = df.withColumn(own, df[text].cast("string")).drop(text)
    schema = rows.drop(own).withColumn(name, F.lit(None).cast("array<double>")).schema

    def run(batches):
        for batch in batches:
            made = pa.array([statistics(t.as_py() or "") for t in batch.column(own)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in schema.names[:-1]), made], schema.names)

    return map_batches(rows, run, schema)


@dataclass
class Model:
    """``score`` gives probabilities of label 1; without any labels 0.5 for all."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random features of the standardised statistics, and a constant."""
        rng = np.random.default_rng(SEED)
        k = x.shape[1]
        w = rng.normal(size=(k, FEATURES)) / np.sqrt(k) / WIDTH
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(raw if self.knots is None else np.interp(raw, *self.knots), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations: each partition's sums, then their sums by row of the matrix."""
    def part(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                z = model.features(matrix(batch.column("statistics")))
                y = batch.column("y").to_numpy(zero_copy_only=False)
                total = total + z.T @ np.column_stack([z, y])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    def add(part_rows: pa.Table) -> pa.Table:
        total = matrix(part_rows.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"row": part_rows.column("row")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "row int, sums array<double>"
    rows = map_batches(train, part, schema).groupBy("row").applyInArrow(add, schema).toArrow()
    rows = rows.sort_by("row")
    if not rows.num_rows:
        return np.zeros((0, 0)), np.zeros(0)
    both = matrix(rows.column("sums").combine_chunks())
    return both[:, :-1], both[:, -1]


def _pool(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic regression: means of adjacent violators pooled."""
    blocks: list[list[float]] = []
    for count, value in zip(n, total):
        blocks.append([count, value, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c, v, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c, blocks[-1][1] + v, blocks[-1][2] + k]
    return np.concatenate([np.full(k, v / c) for c, v, k in blocks])


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """From rows (``fold``: long, ``statistics``, ``y``: 0 to 1). Folds of remainder 0 to 2 of 4 fit
    the scores, those of remainder 3 calibrate them. Beyond ``max_rows`` rows a share of them is
    taken by fold hash. Where the calibration rows have one label only, scores stay as they are."""
    n = labelled.count()
    if n > max_rows:
        part = int(max_rows / n * 1_000_000)
        labelled = labelled.where(F.pmod(F.xxhash64("fold"), F.lit(1_000_000)) < part)
    labelled = cut(labelled, "quality-train")
    width = len(STATISTICS)
    moments = [f(F.col("statistics")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]
    found = labelled.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()
    if found[0] is None:
        return Model(np.zeros(width), np.ones(width))
    model = Model(np.array(found[0::2], float), np.array([s if s and s > 1e-9 else 1.0 for s in found[1::2]]))
    apart = F.pmod(F.col("fold"), F.lit(4)) == 3
    a, b = _sums(labelled.where(~apart), model)
    if not len(b):
        return model
    model.weights = np.linalg.solve(a + RIDGE * np.eye(len(b)), b)

    def bins(batches):
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(matrix(batch.column("statistics")))
                place = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("y"), pa.array(raw)], ["bin", "y", "raw"])

    rows = (map_batches(labelled.where(apart), bins, "bin long, y double, raw double")
            .groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("y"), F.avg("raw").alias("raw"))
            .toArrow().sort_by("bin"))
    n, y, raw = (rows.column(c).to_numpy() for c in ("n", "y", "raw"))
    if 0 < y.sum() < n.sum():  # of one label only, nothing can be learnt about the other
        model.knots = (raw, _pool(n.astype(float), y))
    return model


def score(df: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``df``, which has ``statistics``, with the score of each row in their place."""
    schema = df.drop("statistics").withColumn(name, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            made = model.score(matrix(batch.column("statistics"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in schema.names[:-1]), pa.array(made, pa.float64())], schema.names)

    return map_batches(df, run, schema)


def crc(column) -> "F.Column":
    return F.crc32(column.cast("string").cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id``, ``held_out`` and ``score`` of every row of ``docs``.

    Labels are learnt from rows that are not held out (``held_out``: a column made of ``doc_id``;
    null counts as false). Several labels of a document count as their mean, null labels and
    documents without an id teach nothing but are scored. Without labels every score is 0.5.
    Repeated rows are scored each; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    made = cut(with_statistics(docs.select("doc_id", "text")), "quality-statistics")
    y = labels.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).where("y is not null")
    y = cut(y.withColumnRenamed("doc_id", "label_id"), "quality-labels")
    outside = F.coalesce(held_out, F.lit(False))
    train = (made.where(~outside).join(y, made["doc_id"] == y["label_id"])
             .select(F.xxhash64("doc_id").alias("fold"), "statistics", "y"))
    model = fit(train, max_rows)
    return score(made.withColumn("held_out", outside), model)


@query("op4_quality")
def op4_quality(spark, sf_dir):
    """Every document's quality score; labels of every fourth id are held out."""
    out = classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), F.pmod(crc(F.col("doc_id")), F.lit(4)) == 2)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
