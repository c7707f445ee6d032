"""Two sides compared by checksums first, row by row only where these differ.

Each side is dealt into buckets by a hash of its keys, and a bucket's checksum is the number
of its rows and the sum of their hashes, which no order or partitioning changes. Checksums of
a few neighbouring buckets add up to that of a coarser one, so the two trees are compared from
the top, and only rows in unequal leaves are read and joined. Sides that agree nearly everywhere,
as a report and the report of the day before, are compared at the cost of their differences.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOP, LEAVES = 64, 64  # folders of a side, and leaves in each

_TREE = "top int, leaf int, n bigint, total decimal(38,0)"


def _hash(columns: list[str]) -> Column:
    """Hash of a row in which null differs from every text."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c), F.col(c).isNull())])


@dataclass
class Side:
    """A written side: its rows in folders by ``top``, its checksums by ``top`` and ``leaf``."""

    rows: DataFrame
    tree: DataFrame
    keys: list[str]
    values: list[str]


def write_side(df: DataFrame, path: str, keys: list[str], values: list[str] = ()) -> Side:
    """Write distinct rows of ``keys`` and ``values`` with their checksums."""
    values = list(values)
    place = F.pmod(_hash(keys), F.lit(TOP * LEAVES)).cast("int")
    rows = df.select(*keys, *values).distinct().withColumn("place", place).withColumn("check", _hash([*keys, *values]))
    rows = rows.select(*keys, *values, "check", (F.col("place") % LEAVES).alias("leaf"), F.floor(F.col("place") / LEAVES).cast("int").alias("top"))
    rows.hint("rebalance", "top").write.mode("overwrite").partitionBy("top").parquet(os.path.join(path, "rows"))
    kept = df.sparkSession.read.schema(rows.schema).parquet(os.path.join(path, "rows"))
    tree = kept.groupBy("top", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("check").cast("decimal(38,0)")).alias("total"))
    tree.write.mode("overwrite").parquet(os.path.join(path, "tree"))
    return read_side(df.sparkSession, path, keys, values, rows.schema)


def read_side(spark: SparkSession, path: str, keys: list[str], values: list[str] = (), schema=None) -> Side:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return Side(reader.parquet(os.path.join(path, "rows")), spark.read.schema(_TREE).parquet(os.path.join(path, "tree")), list(keys), list(values))


def unequal(left: Side, right: Side, level: str) -> DataFrame:
    """Buckets of a level ("top" or "leaf") whose checksums differ: one row per bucket."""
    by = ["top"] if level == "top" else ["top", "leaf"]
    both = left.tree.withColumn("sign", F.lit(1)).unionByName(right.tree.withColumn("sign", F.lit(-1)))
    sums = both.groupBy(*by).agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum(F.col("total") * F.col("sign")).alias("total"))
    return sums.where("n <> 0 or total <> 0").select(*by)


def differences(left: Side, right: Side) -> DataFrame:
    """Rows that are not the same on both sides: keys, ``left_`` and ``right_`` values, and the ``side``:
    export_only, db_only or, where both have the key, changed.

    Which of the ``TOP`` folders differ is known before the rows are planned, so the scan leaves the others
    out; within them the unequal leaves are kept by a semi-join. Keys that repeat with
    other values give a row per pair of values.
    """
    tops = sorted(r.top for r in unequal(left, right, "top").collect())  # at most TOP
    leaves = unequal(left, right, "leaf")

    def rows(side: Side, name: str) -> DataFrame:
        some = side.rows.where(F.col("top").isin(tops)).join(leaves, ["top", "leaf"], "left_semi")
        return some.select(*side.keys, *[F.col(v).alias(f"{name}_{v}") for v in side.values], F.col("check").alias(f"{name}_check"))

    keys = left.keys
    a, b = rows(left, "left"), rows(right, "right").withColumnsRenamed({k: f"r_{k}" for k in keys})
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"r_{k}"))
        same = test if same is None else same & test
    joined = a.join(b, same, "full").where(~F.col("left_check").eqNullSafe(F.col("right_check")))
    side = F.when(F.col("right_check").isNull(), "export_only").when(F.col("left_check").isNull(), "db_only").otherwise("changed")
    return joined.select(
        *[F.coalesce(F.col(k), F.col(f"r_{k}")).alias(k) for k in keys], *[f"left_{v}" for v in left.values],
        *[f"right_{v}" for v in right.values], side.alias("side"))


def side_counts(left: Side, right: Side) -> DataFrame:
    """common, export_only and db_only of the keys, the common ones from checksums alone: sides without values."""
    rows = differences(left, right).select("side", F.lit(0).cast("bigint").alias("n"))
    # one sum over both tables, so that two rows need no join
    every = rows.unionByName(left.tree.select(F.lit("left").alias("side"), "n"))
    return every.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("side") == "export_only")).alias("common"),
        *[F.count_if(F.col("side") == s).alias(s) for s in ("export_only", "db_only")])
