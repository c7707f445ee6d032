"""Sheets of any layout as one table of rows, in the order of their files.

A row carries its sheet's headers, so that sheets of different headers share one
schema and one plan, in batch and in a stream. Its place is exact: files are read as
lines, and a row is known by its file, the block of the file that its task read, and
its number in the block. A block's number of rows gives the number of a row in its
sheet, without sorting rows.

Only the split of a line into fields and the lookup of a header run in Python; which
column holds what, and what becomes a cell, are expressions.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salestally.functions.names import header_text, identifier_or_blank, identifier_or_unknown
from salestally.operators.reshape import ACTUAL, LAYOUTS, MEASURES
from salestally.session import cut, ship
from salestally.sources.paths import decoded, inside, sheet_of

ROW_SCHEMA = ("path string, modified timestamp, block bigint, at bigint, headers array<string>, fields array<string>")
HEAD = 1 << 20  # bytes of a file in which its header ends


# --- lines of text ---------------------------------------------------------------------


def fields_of(line: str) -> list[str | None]:
    """The fields of a line; empty ones are null. Quotes inside a quoted field are doubled or escaped."""
    found = next(csv.reader([line], escapechar="\\"), [])
    return [f or None for f in found]


def open_head(path: str):
    """A file of the shared folder as a byte stream."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def header_line(path: str) -> str:
    """The first line of a text file."""
    with open_head(path) as file:
        first = file.read(HEAD).split(b"\n", 1)[0]
    return first.decode("utf-8").rstrip("\r")


def headers_of(line: str) -> list[str]:
    """Names of the columns; one without a name is called by its place."""
    return [(f or "").strip() or f"_c{i}" for i, f in enumerate(fields_of(line.removeprefix("\ufeff")))]


def _lines(reader, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return reader.load(path).select(
        "value", decoded(meta["file_path"]).alias("path"), meta["file_modification_time"].alias("modified"),
        meta["file_block_start"].alias("block"))


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines become rows. The lines of a block follow one another; the first one of a file is its header.

    A block that begins inside a file looks its header up at the file's start.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        now, at, header = None, 0, None
        for batch in batches:
            out: dict[str, list] = {"place": [], "at": [], "headers": [], "fields": []}
            lines = batch.column("value").to_pylist()
            for i, place in enumerate(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist())):
                if place != now:
                    now, at = place, 0
                    header = headers_of(header_line(place[0])) if place[1] else None
                if header is None:
                    header = headers_of(lines[i])
                elif lines[i].strip():
                    for name, value in zip(out, (i, at, header, fields_of(lines[i]))):
                        out[name].append(value)
                    at += 1
            if out["place"]:
                own = batch.take(pa.array(out["place"], pa.int64()))
                text = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [own.column("path"), own.column("modified"), own.column("block"), pa.array(out["at"], pa.int64()),
                     pa.array(out["headers"], text), pa.array(out["fields"], text)],
                    ["path", "modified", "block", "at", "headers", "fields"])

    ship(lines.sparkSession)
    return _named(lines.mapInArrow(run, ROW_SCHEMA))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim(sheet_of(F.col("path"))).alias("sheet"), "*")


def read_rows(spark: SparkSession, folder: str, pattern: str | None = None, fmt: str = "csv") -> DataFrame:
    """Rows of all sheets in a folder: sheet, path, modified, block, at, headers, fields.

    One pass over the files, whatever their number. ``at`` counts the rows of a block from 0. A
    field that goes on over several lines is not supported, as in Spark's own reader of split
    files. With ``fmt`` parquet the files are those of one or more Parquet sheets, whose
    columns are told by their footers.
    """
    if fmt == "parquet":
        return _parquet_rows(spark, inside(folder, pattern))
    return _parsed(_lines(spark.read.format("text"), inside(folder, pattern)))


def _parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet sheets. Columns that a file has not are null and no header of it."""
    meta = F.col("_metadata")
    df = spark.read.option("mergeSchema", True).parquet(path)
    rows = df.select(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("every"),
                     decoded(meta["file_path"]).alias("path"), meta["file_modification_time"].alias("modified"),
                     F.lit(0).cast("bigint").alias("block"), meta["row_index"].alias("at"))
    listing = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    own = headers_of_files(listing).withColumnRenamed("path", "own_path")
    names = F.array(*[F.lit(c) for c in df.columns])
    value = lambda h: F.get("every", F.array_position(names, h) - 1)
    return _named(rows.join(own, F.col("path") == F.col("own_path")).select(
        "path", "modified", "block", "at", "headers", F.transform("headers", value).alias("fields")))


def headers_of_files(files: DataFrame) -> DataFrame:
    """``files``, which have a ``path``, with the ``headers`` of each: of its first line, or of a Parquet footer."""
    schema = files.drop("headers").withColumn("headers", F.array().cast("array<string>")).schema

    def run(batches):
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                if name.endswith(".parquet"):
                    import pyarrow.parquet as pq

                    with open_head(name) as file:
                        found.append([c.strip() for c in pq.read_schema(file).names])
                else:
                    found.append(headers_of(header_line(name)))
            columns = [pa.array(found, pa.list_(pa.string())) if c == "headers" else batch.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    ship(files.sparkSession)
    return files.mapInArrow(run, schema)


def stream_rows(spark: SparkSession, folder: str, pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """The same rows of CSV files that appear in a folder."""
    reader = spark.readStream.format("text").schema("value string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _parsed(_lines(reader, inside(folder, pattern)))


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``row``, the exact number of a row in its sheet from 1, files in the order of their names.

    Rows are written once; their numbers are those of the blocks before, a table of one row
    per block, plus their places in the block.
    """
    kept = cut(rows, "sheet-rows")
    blocks = kept.groupBy("sheet", "path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sheet").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("path").alias("b_path"), F.col("block").alias("b_block"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = kept.join(blocks, (F.col("path") == F.col("b_path")) & (F.col("block") == F.col("b_block")))
    return joined.withColumn("row", F.col("before") + F.col("at") + 1).drop("b_path", "b_block", "before")


# --- cells -----------------------------------------------------------------------------------


def _value(name: str) -> Column:
    """The field under a header, null where there is none."""
    return F.trim(F.get("fields", F.array_position("low", name) - 1))


def _has(name: str) -> Column:
    return F.array_contains("low", name)


def row_layout() -> Column:
    """Layout whose columns the headers have; the one with targets comes first."""
    found = None
    for name, need in LAYOUTS.items():
        test = F.lit(True)
        for header in need:
            test = test & (_has(header) | _has("target") if header == "targets" else _has(header))
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def cells_of_rows(rows: DataFrame, null_as_zero: bool = False, every_row: bool = False) -> DataFrame:
    """Cells of rows of all layouts: sheet, path, modified, block, at, row_ord, identifier, metric, value_raw.

    Empty measures are skipped, or read as "0" with ``null_as_zero``; a metric/value row is kept even
    when it is empty. Rows under headers of no layout give no cells, or with ``every_row`` one without
    a value, so that their sheet is reported. ``row_ord`` grows with the rows of a file.
    """
    rows = rows.withColumn("low", F.transform("headers", header_text)).withColumn("layout", row_layout())
    name = F.when(_has("identifier"), _value("identifier")).when(_has("identifier/label"), _value("identifier/label")).when(
        _has("week"), _value("week")).otherwise(F.trim(F.get("fields", F.lit(0))))
    pair = lambda metric, value: F.struct(metric.alias("metric"), value.alias("value_raw"))
    filled = lambda value: F.coalesce(value, F.lit("0")) if null_as_zero else value
    pairs = None
    for layout, measures in MEASURES.items():
        made = F.array(*[pair(F.lit(m), filled(F.coalesce(_value(h), _value("target")) if h == "targets" else _value(h)))
                         for m, h in measures.items()])
        made = F.filter(made, lambda x: x["value_raw"].isNotNull())
        pairs = F.when(F.col("layout") == layout, made) if pairs is None else pairs.when(F.col("layout") == layout, made)
    for layout, header in (("metric", "excel value"), ("week_metric", "value")):
        pairs = pairs.when(F.col("layout") == layout, F.array(pair(identifier_or_blank(_value("metric")), filled(_value(header)))))
    if every_row:
        pairs = pairs.otherwise(F.array(pair(F.lit(ACTUAL), F.lit(None).cast("string"))))
    out = rows.withColumn("identifier", identifier_or_unknown(name)).withColumn("pair", F.explode(pairs))
    return out.select("sheet", "path", "modified", "block", "at", (F.col("block") + F.col("at")).alias("row_ord"),
                      "identifier", "pair.metric", "pair.value_raw")


ORDER = ["modified", "path", "block", "at"]


def last_cells(cells: DataFrame) -> DataFrame:
    """The last cell per (sheet, identifier, metric): later files first, then later rows.

    In a stream this is the operator's state, kept and restored by Spark: one value per key,
    combined in each task before anything moves, so a hot key costs one row per task.
    """
    return (
        cells.groupBy(F.struct("sheet", "identifier", "metric").alias("key"))
        .agg(F.max_by(F.struct("value_raw", "row_ord"), F.struct(*ORDER, "value_raw")).alias("last"))
        .select("key.sheet", "last.row_ord", "key.identifier", "key.metric", "last.value_raw")
    )


def sheet_shapes(rows: DataFrame) -> DataFrame:
    """One row per sheet: sheet, headers (of its first file), data_volume, n_columns."""
    return rows.groupBy("sheet").agg(
        F.transform(F.min_by("headers", "path"), header_text).alias("headers"), F.count(F.lit(1)).alias("data_volume"),
    ).withColumn("n_columns", F.size("headers"))

