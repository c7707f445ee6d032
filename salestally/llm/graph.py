"""Connected components over a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally.session import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least node it is connected with) of all nodes on an edge to another node.

    Large and small stars in turn (Kiveris and others): every node ties its larger neighbours,
    then its smaller ones, to the least it knows, until all that is left are stars. The number
    of rounds grows with the logarithm of the longest path, and the edges never grow.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = cut(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    seen = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "n")
        large = (both.where("v > u").join(least, F.col("u") == F.col("n")).where("v > m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = cut(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = (large.join(least, F.col("u") == F.col("n")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
        now, before = cut(small, "edges"), seen
        seen = _mark(now)
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union and find within one task; ``edges`` are a spanning forest."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def tie(self, i: int, others) -> None:
        for j in others:
            a, b = self.root(i), self.root(int(j))
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((i, int(j)))


def tie_all(forest: Forest, links: np.ndarray) -> None:
    """``links``: a square of truth values."""
    for i in range(len(links)):
        forest.tie(i, np.flatnonzero(links[i]))
