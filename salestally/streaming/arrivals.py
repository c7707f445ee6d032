"""Reconcile exports as they arrive."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salestally import fixed_values as fv
from salestally.operators import reconcile, report
from salestally.sources import sheets
from salestally.sources.exports import CELL_SCHEMA
from salestally.sources.paths import inside


def stream_cells(spark: SparkSession, folder: str, fmt: str = "parquet",
                 pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Cells in canonical form from files that appear in a folder."""
    reader = spark.readStream.schema(CELL_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(inside(folder, pattern))


def stream_sheets(spark: SparkSession, folder: str, pattern: str = fv.EXPORT_FILE_PATTERN,
                  files_per_batch: int | None = None, places: bool = False) -> DataFrame:
    """Cells from sheet files of any layout that appear in a folder, in the order of their rows.

    Sheets of headers that are not known give a cell without a value per row. With ``places`` the
    columns that order cells over files and drops come along.
    """
    cells = sheets.cells_of_rows(sheets.stream_rows(spark, folder, pattern, files_per_batch), every_row=True)
    names = [f.split()[0] for f in CELL_SCHEMA.split(", ")]
    return cells.select(*names, *(sheets.ORDER if places else []))


def reconcile_arrivals(cells: DataFrame, db: DataFrame, out: str,
                       checkpoint: str, **options) -> StreamingQuery:
    """Compare each new file once and write rows and counts per batch.

    ``checkpoint`` is the folder that remembers which files were read; the
    same one continues where the last run ended.

    A batch goes into folders of its own number and overwrites them, so a
    batch that is run again after a failure leaves the same result. The
    database side is a written table, read anew by every batch.
    """
    def each(batch: DataFrame, number: int) -> None:
        rows = reconcile.reconcile_long(batch, db, **options)
        rows.write.mode("overwrite").parquet(os.path.join(out, "rows", f"batch={number}"))
        written = batch.sparkSession.read.parquet(os.path.join(out, "rows", f"batch={number}"))
        report.sheet_summary(written).write.mode("overwrite").parquet(
            os.path.join(out, "summary", f"batch={number}")
        )

    return (
        cells.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def reconcile_latest(cells: DataFrame, db: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Compare what is last known of each key, over all drops so far.

    ``cells`` come with their places. The last value of each (sheet, identifier, metric) is the
    state of an aggregation, held in Spark's state store and restored from ``checkpoint``, so that
    a correction that arrives later replaces what an earlier file said, and a file that is late
    by its time of change replaces nothing newer. A batch writes the keys it has changed, into a
    folder of its own number; see ``read_latest``. State grows with the number of keys.
    """
    def each(batch: DataFrame, number: int) -> None:
        rows = reconcile.reconcile_long(batch, db, **options)
        rows.write.mode("overwrite").parquet(os.path.join(out, "rows", f"batch={number}"))

    return (
        sheets.last_cells(cells).writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The last report of every key."""
    rows = read_arrivals(spark, out)
    rest = [c for c in rows.columns if c not in (*reconcile.KEYS, "batch")]
    last = rows.groupBy(F.struct(*reconcile.KEYS).alias("key")).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return last.select("key.*", "row.*")


def read_arrivals(spark: SparkSession, out: str, part: str = "rows") -> DataFrame:
    """All batches so far."""
    return spark.read.parquet(os.path.join(out, part))
