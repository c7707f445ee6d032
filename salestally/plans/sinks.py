"""Writing reports, snapshots and logs.

Report tables are written one folder per sheet. The rebalance hint lets AQE
split a large sheet over several tasks and put small ones together, so the
writer makes files of even size whatever the shares of the sheets are.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from salestally.functions.names import sheet_title
from salestally.operators import report
from salestally.session import cut


def write_by_sheet(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   column: str = "sheet") -> None:
    """One folder per sheet, named by the shortened title; empty sheets make none.

    Two sheets whose titles are equal once shortened share a folder; the full
    name stays in the rows. CSV files get a header line.
    """
    titled = df.withColumn("title", sheet_title(column))
    writer = titled.hint("rebalance", "title").write.mode(mode).partitionBy("title")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


# --- runs ---------------------------------------------------------------------------------

_RUNS = "run string, seq bigint, n_rows bigint"


def write_run(df: DataFrame, path: str, run: str, seq: int) -> None:
    """Write a report as one run of several.

    Rows go into a folder of the run and replace what a lost attempt left there; only then a line
    about the run is written, also in a folder of its own. Readers follow these lines, so rows of an
    attempt that did not end are never seen, and a run that is repeated counts once. ``seq`` orders runs.
    """
    spark = df.sparkSession
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(os.path.join(path, "rows", f"run={run}"))
    done = spark.createDataFrame([(seq, counted.get["n"])], "seq bigint, n_rows bigint")
    done.write.mode("overwrite").parquet(os.path.join(path, "done", f"run={run}"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """run, seq, n_rows of the runs that ended."""
    return spark.read.schema(_RUNS).parquet(os.path.join(path, "done"))


def read_latest_run(spark: SparkSession, path: str, schema, column: str = "sheet") -> DataFrame:
    """Rows of each sheet from the last ended run that has it.

    The list of runs is one row each and decides on the folders; a run of which a sheet is no
    part leaves that sheet as it was.
    """
    runs = read_runs(spark, path)
    rows = spark.read.schema(StructType([*schema, StructField("run", StringType())])).parquet(os.path.join(path, "rows"))
    known = rows.join(runs.select("run", "seq"), "run")
    last = known.groupBy(F.col(column).alias("of")).agg(F.max("seq").alias("last"))
    return known.join(last, F.col(column).eqNullSafe(F.col("of")) & (F.col("seq") == F.col("last"))).drop("of", "last", "seq", "run")


def write_long_report(long: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Identifier/Label, Metric, Excel Value, DB Value, Status per sheet."""
    named = long.select(
        "sheet", "row_ord",
        F.col("identifier").alias("Identifier/Label"), F.col("metric").alias("Metric"),
        F.col("excel_value").alias("Excel Value"), F.col("db_value").alias("DB Value"),
        F.col("status").alias("Status"),
    )
    write_by_sheet(named, path, fmt)


def write_wide_report(wide: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One table per layout, each in folders by sheet."""
    for layout, df in wide.items():
        write_by_sheet(df, os.path.join(path, f"layout={layout}"), fmt)


def write_kpi_report(kpis: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The comparison and its summary, two outputs of one run of it."""
    kpis = cut(kpis, "kpi-report")
    named = kpis.select(
        F.col("kpi_name").alias("KPI Name"), F.col("excel_value").alias("Excel Value"),
        F.col("db_value").alias("DB Value"), F.col("status").alias("Status"),
        F.col("notes").alias("Notes"),
    )
    named.write.mode("overwrite").format(fmt).option("header", True).save(os.path.join(path, "comparison"))
    lines = report.summary_lines(report.kpi_summary(kpis), report.KPI_SUMMARY_LABELS)
    lines.write.mode("overwrite").format(fmt).option("header", True).save(os.path.join(path, "summary"))


def write_issue_report(issues: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Errors, warnings and the counts over both; a level without rows is left out."""
    for level in ("error", "warning"):
        sheet = report.issue_sheet(issues, level)
        if not sheet.isEmpty():
            sheet.write.mode("overwrite").format(fmt).option("header", True).save(
                os.path.join(path, f"{level}s")
            )
    totals = report.issue_totals(issues).select(
        F.lit("total").alias("part"), "level", F.lit(None).cast("string").alias("component"), "n"
    )
    parts = report.issues_by_component(issues).select(
        F.lit("component").alias("part"), "level", "component", "n"
    )
    totals.unionByName(parts).write.mode("overwrite").format(fmt).option("header", True).save(
        os.path.join(path, "summary")
    )


def combine_files(frames: dict[str, DataFrame], path: str, one_sheet: bool = False,
                  fmt: str = "parquet") -> DataFrame:
    """Rows of several files as one table, in folders by file unless ``one_sheet``."""
    tagged = [df.withColumn("sheet", F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if one_sheet:
        out.hint("rebalance").write.mode("overwrite").format(fmt).save(path)
    else:
        write_by_sheet(out, path, fmt)
    return out


def write_kpi_snapshot(kpis: DataFrame, path: str) -> None:
    """KPI names with their values as text."""
    kpis.select("kpi_name", F.col("value").cast("string").alias("value_raw")).write.mode(
        "overwrite"
    ).parquet(path)


def append_issues(spark: SparkSession, path: str, entries: list[tuple]) -> None:
    """Append log records (see ``report.ISSUE_SCHEMA``)."""
    spark.createDataFrame(entries, report.ISSUE_SCHEMA).write.mode("append").parquet(path)


def append_issue_rows(issues: DataFrame, path: str) -> None:
    """Append log records that a job produced."""
    issues.write.mode("append").parquet(path)


def append_run(spark: SparkSession, path: str, task_id: str, task_type: str, status: str,
               detail: str = "") -> None:
    spark.createDataFrame([(task_id, task_type, status, detail)], report.RUN_SCHEMA).write.mode(
        "append"
    ).parquet(path)


def read_report(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.option("header", True).format(fmt).load(path)

