"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)``, with the SQL text that gives the same rows."""
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, in place of any whose name differs in case only."""
    same = [c for c in df.columns if c.lower() == name.lower() and c != name]
    return df.drop(*same).withColumn(name, value)


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text], F.lit(""))


def chunks(texts: pa.StringArray, limit: int) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null: empty) of about ``limit`` characters in all, with the place of the first."""
    start, held, size = 0, [], 0
    for place, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = place + 1, [], 0
    if held:
        yield start, held


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not lead to it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    known = [os.path.realpath(p or ".") for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if os.path.realpath(root) in known or getattr(context, "_salestally_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "salestally"), "zip", root, "salestally")
    context.addPyFile(archive)
    context._salestally_shipped = True


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``run`` over the Arrow batches of each partition."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
