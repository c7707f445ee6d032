"""Counts over comparisons, runs and issues; checks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.functions.values import percent, rounded, stamp, value_kind

ISSUE_SCHEMA = (
    "seq bigint, level string, ts timestamp, component string, widget_name string, "
    "type string, message string, path string"
)
RUN_SCHEMA = "task_id string, task_type string, status string, detail string"


# --- comparisons ---------------------------------------------------------------------


def kpi_summary(report: DataFrame) -> DataFrame:
    """One row: total, matches, mismatches, no_mapping, sp_errors, success_rate."""
    status = F.col("status")
    matches = F.count_if(status == "Match")
    total = F.count(F.lit(1))
    return report.agg(
        total.alias("total"),
        matches.alias("matches"),
        F.count_if(status == "Mismatch").alias("mismatches"),
        F.count_if(status == "No SP Mapping").alias("no_mapping"),
        F.count_if(status.isin("SP Missing", "DB Error")).alias("sp_errors"),
        percent(matches, total).alias("success_rate"),
        F.try_divide(matches * F.lit(100.0), total).alias("success_percent"),
    )


def summary_lines(summary: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A one-row summary as (ord, Metric, Count) lines."""
    lines = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("Metric"),
                 F.col(column).cast("string").alias("Count"))
        for i, (column, label) in enumerate(labels.items())
    ])
    return summary.select(F.inline(lines))


KPI_SUMMARY_LABELS = {
    "total": "Total KPIs",
    "matches": "Matches",
    "mismatches": "Mismatches",
    "no_mapping": "No SP Mapping",
    "sp_errors": "SP Errors",
    "success_rate": "Success Rate",
}


def sheet_summary(report: DataFrame) -> DataFrame:
    """Status counts and success rate per sheet of a long report."""
    status = F.col("status")
    matches, total = F.count_if(status == "Match"), F.count(F.lit(1))
    return report.groupBy("sheet").agg(
        total.alias("total"),
        matches.alias("matches"),
        F.count_if(status == "Mismatch").alias("mismatches"),
        F.count_if(status == fv.NOT_FOUND).alias("not_found"),
        percent(matches, total).alias("success_rate"),
    )


def wide_status_counts(report: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, status, n) over the status columns of a wide report."""
    names = [f"{m} Status" for m in metrics]
    long = report.select(*[F.col(f"`{n}`").alias(m) for n, m in zip(names, metrics)])
    return long.unpivot([], metrics, "metric", "status").groupBy("metric", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


def side_counts(export: DataFrame, db: DataFrame) -> DataFrame:
    """One row: rows on the export side, rows on the database side."""
    one = export.select(F.lit(1).alias("e"), F.lit(0).alias("d")).unionByName(
        db.select(F.lit(0).alias("e"), F.lit(1).alias("d"))
    )
    return one.agg(
        F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("excel_count"),
        F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("db_count"),
    )


def value_kinds(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.groupBy(value_kind(value).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))


# --- issues and runs -------------------------------------------------------------------


def issue_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def issues_by_component(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level", "component").agg(F.count(F.lit(1)).alias("n"))


def last_issues(issues: DataFrame, level: str, n: int = 5) -> DataFrame:
    return issues.filter(F.col("level") == level).orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def issue_sheet(issues: DataFrame, level: str) -> DataFrame:
    """Issues of one level as printed, with the time as text."""
    word = level.capitalize()
    columns = [
        F.col("seq"), stamp("ts").alias("Timestamp"), F.col("component").alias("Component"),
        F.col("widget_name").alias("Widget Name"), F.col("type").alias(f"{word} Type"),
        F.col("message").alias(f"{word} Message"),
    ]
    if level == "error":
        columns.append(F.coalesce("path", F.lit("")).alias("Screenshot Path"))
    return issues.filter(F.col("level") == level).select(*columns)


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- checks of rows ----------------------------------------------------------------------


def missing_columns(df: DataFrame, shape: str) -> list[str]:
    """Required columns of a shape that a sheet lacks."""
    have = {c.strip().lower() for c in df.columns}
    return [c for c in fv.REQUIRED_COLUMNS[shape] if c.lower() not in have]


def violations(cells: DataFrame, value: str = "value_raw", low: str = fv.SALES_RANGE[0],
               high: str = fv.SALES_RANGE[1]) -> DataFrame:
    """Cells whose amount lies outside the allowed range."""
    amount = rounded(value)
    inside = amount.between(F.lit(low).cast("decimal(38,2)"), F.lit(high).cast("decimal(38,2)"))
    return cells.withColumn("amount", amount).filter(~inside)


def year_outside(year: Column, low: int = fv.YEAR_RANGE[0], high: int = fv.YEAR_RANGE[1]) -> Column:
    return ~year.between(low, high)
