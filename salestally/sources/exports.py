"""Exported sheets and KPI lists: a folder of CSV or Parquet files.

A sheet is a file, or a folder of part files as Spark writes them; its name
is the name of the file or folder without suffix.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salestally import fixed_values as fv
from salestally.functions.names import header_text
from salestally.operators.reshape import ACTUAL, layout_of, sheet_cells, sheet_wide, union_all
from salestally.sources import sheets
from salestally.sources.paths import decoded, inside, sheet_of, sheet_root

KPI_SCHEMA = "kpi_name string, value_raw string"
CELL_SCHEMA = "sheet string, row_ord bigint, identifier string, metric string, value_raw string"


def file_sheet() -> Column:
    """The sheet of the file a row was read from."""
    return sheet_of(decoded(F.col("_metadata.file_path")))


# --- which files ------------------------------------------------------------------


def export_files(spark: SparkSession, folder: str, pattern: str = fv.EXPORT_FILE_PATTERN) -> DataFrame:
    """Non-empty files whose sheet fits the pattern: path, sheet, size, modified.

    Only listings are read: the content column is pruned from the scan.
    """
    return (
        spark.read.format("binaryFile").load(inside(folder, pattern))
        .select("path", sheet_of(F.col("path")).alias("sheet"),
                F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        .filter("size > 0")
    )


def newest(files: DataFrame) -> DataFrame:
    """The file modified last, by path where times are equal."""
    last = F.struct("modified", "path")
    return files.agg(*[F.max_by(c, last).alias(c) for c in ("path", "sheet", "modified")])


def new_files(files: DataFrame, seen: DataFrame, skip_word: str = fv.KPI_FILE_WORD) -> DataFrame:
    """Files not in an earlier listing, without those named after KPIs."""
    fresh = files.join(seen.select("path"), "path", "left_anti")
    return fresh.filter(~F.lower("sheet").contains(skip_word))


# --- sheets ------------------------------------------------------------------------


def header_groups(spark: SparkSession, folder: str, pattern: str | None = None) -> dict[tuple, list[str]]:
    """Distinct header -> the sheets that have it.

    One job, in which tasks read the first line or the footer of each sheet's first file; the rows
    stay where they are. Sheets share a handful of headers, and with one read per header their
    number does not enter the plan.
    """
    place = inside(folder, pattern)
    listing = spark.read.format("binaryFile").load(place).where("length > 0").select("path")
    first = listing.groupBy(sheet_root(F.col("path")).alias("root")).agg(F.min("path").alias("path"))
    heads = sheets.headers_of_files(first)
    found = heads.where(F.size("headers") > 0).groupBy("headers").agg(F.sort_array(F.collect_list("root")).alias("roots"))
    return {tuple(row.headers): row.roots for row in found.collect()}


def _read_group(spark: SparkSession, header: tuple, paths: list[str]) -> DataFrame:
    """Rows of sheets of one header, as text. ``row_ord`` keeps their order inside a file."""
    columns = [f"`{h.strip()}`" for h in header]
    schema = ", ".join(f"{c} string" for c in columns)
    parts = []
    if csv := [p for p in paths if not is_parquet(p)]:
        rows = spark.read.schema(schema).option("header", True).csv(csv)
        parts.append(rows.withColumn("sheet", file_sheet()).withColumn("row_ord", F.monotonically_increasing_id()))
    if parquet := [p for p in paths if is_parquet(p)]:
        rows = spark.read.parquet(*parquet)
        parts.append(rows.select(*[F.col(c).cast("string") for c in columns], file_sheet().alias("sheet"),
                                 F.col("_metadata.row_index").alias("row_ord")))
    return union_all(parts)


def is_parquet(path: str) -> bool:
    return path.endswith(".parquet")


def read_sheets(spark: SparkSession, folder: str, pattern: str | None = None) -> dict[tuple, DataFrame]:
    """Rows of every sheet with its own columns, one DataFrame per distinct header.

    ``row_ord`` keeps the order of rows inside a sheet; it is no row number.
    """
    groups = header_groups(spark, folder, pattern)
    return {h: _read_group(spark, h, paths) for h, paths in sorted(groups.items())}


def cells_of(spark: SparkSession, sheets: dict[tuple, DataFrame],
             null_as_zero: bool = False, every_row: bool = False) -> DataFrame:
    """Cells of the sheets whose layout is known; with ``every_row`` those of other sheets without a value."""
    parts = []
    for header, df in sheets.items():
        layout = layout_of(list(header))
        if layout:
            parts.append(sheet_cells(df, layout, null_as_zero))
        elif every_row:
            parts.append(sheet_wide(df, None).select(
                "sheet", "row_ord", "identifier", F.lit(ACTUAL).alias("metric"), F.col(f"`{ACTUAL}`").alias("value_raw")))
    return union_all(parts) if parts else spark.createDataFrame([], CELL_SCHEMA)


def read_cells(spark: SparkSession, folder: str, pattern: str | None = None,
               null_as_zero: bool = False) -> DataFrame:
    """Cells of all sheets of known layouts in a folder."""
    return cells_of(spark, read_sheets(spark, folder, pattern), null_as_zero)


def shapes_of_all(sheets: dict[tuple, DataFrame]) -> DataFrame:
    """One row per sheet: sheet, headers, data_volume, n_columns."""
    if not sheets:
        return SparkSession.active().createDataFrame([], "sheet string, headers array<string>, data_volume bigint, n_columns int")
    return union_all([shapes_of(df, list(header)) for header, df in sheets.items()])


def sheet_shapes(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    return shapes_of_all(read_sheets(spark, folder, pattern))


def shapes_of(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Shape of the sheets in a DataFrame with these headers."""
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("data_volume")).select(
        "sheet", F.array(*[header_text(F.lit(h)) for h in headers]).alias("headers"), "data_volume",
        F.lit(len(headers)).alias("n_columns"),
    )


def sample_rows(rows: DataFrame, headers: list[str], n: int = 3) -> DataFrame:
    """The first rows of each sheet that are not empty, as maps: sheet, row_ord, sample.

    The rank filter is applied per task before rows are shuffled, so a large
    sheet sends a few rows per task.
    """
    values = F.array(*[F.col(f"`{h}`").cast("string") for h in headers])
    keys = F.array(*[F.lit(h.strip().lower()) for h in headers])
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy("row_ord"))
    return (
        rows.na.drop("all", subset=[f"`{h}`" for h in headers])
        .withColumn("rank", rank).filter(F.col("rank") <= n)
        .select("sheet", "row_ord", F.map_from_arrays(keys, values).alias("sample"))
    )


# --- KPI lists ----------------------------------------------------------------------


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    """KPI list with a header line: names and values trimmed.

    ``ord`` is the place of a line: its file, its block of the file and its number among those that a
    task read, so that the last of equal names is the last in the files' order.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return (
        spark.read.schema(KPI_SCHEMA).option("header", True).csv(path)
        .select(F.trim("kpi_name").alias("kpi_name"), F.trim("value_raw").alias("value_raw"), place.alias("ord"))
    )


# --- several files as one -------------------------------------------------------------


def read_tagged(spark: SparkSession, paths: list[str] | str, fmt: str = "csv") -> DataFrame:
    """Rows of many files with the file's name as ``sheet``, by header where they differ.

    ``paths`` is a folder, or files.
    """
    if fmt != "csv":
        reader = spark.read.format(fmt)
        if fmt in ("parquet", "orc"):
            reader = reader.option("mergeSchema", True)
        return reader.load(paths).withColumn("sheet", file_sheet())
    if isinstance(paths, str):
        groups = header_groups(spark, paths)
    else:
        groups = {}
        for path in paths:
            head, name = os.path.split(path)
            for header, found in header_groups(spark, head, name).items():
                groups.setdefault(header, []).extend(found)
    out = None
    for header, found in sorted(groups.items()):
        part = _read_group(spark, header, found).drop("row_ord")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def config_table(spark: SparkSession, table: dict[str, str], key: str, value: str) -> DataFrame:
    """A fixed lookup table as a DataFrame."""
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} string")


def load_config(path: str) -> dict:
    """A settings file, YAML where the parser is installed, else JSON."""
    with open(os.fspath(path), encoding="utf-8") as handle:
        if os.fspath(path).endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("reading YAML needs the yaml package; use JSON") from error
            return yaml.safe_load(handle) or {}
        return json.load(handle)
