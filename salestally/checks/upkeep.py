"""Maintained tables, checksums, runs, and queries that fail."""

from __future__ import annotations

import os
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.checks import cells as cx
from salestally.checks.analytics import new_sql
from salestally.checks.base import P, YEAR, check, model_check, with_fact
from salestally.model import bind_folder, read_table
from salestally.operators import checksums, drill, kpis, maintained, match, reconcile, reshape, widgets
from salestally.params import Params
from salestally.plans import comparisons, sinks
from salestally.session import cut, scratch
from salestally.sources import sql_functions
from salestally.sources.registry import default_registry, kpi_values, probe

# --- customers by sketch, new customers by increments ------------------------------------------

_SCOPES = {"year": f"y = {YEAR}", "may": f"y = {YEAR} AND month(d) = 5", "store": f"y = {YEAR} AND store_key = 3",
           "state": f"y = {YEAR} AND state = 'NATION_3'", "two days": f"d IN (DATE '{YEAR}-02-01', DATE '{YEAR}-02-02')"}


@model_check("customers_by_sketch", with_fact("\nUNION ALL ".join(
    f"SELECT '{name}' AS scope, count(DISTINCT customer_key) AS customers, true AS within FROM fact WHERE {where}"
    for name, where in _SCOPES.items())))
def _(m):
    """Distinct customers of several scopes from sketches by day and store, written in two increments, one of
    them twice; the estimate lies within four standard errors of the exact number."""
    path = scratch(m.spark, "sketches")
    for start, stop in ((date(YEAR, 1, 1), date(YEAR, 7, 1)), (date(YEAR, 5, 1), date(YEAR + 1, 1, 1))):
        maintained.advance_sketches(m, path, start, stop)
    scopes = {"year": P, "may": P.override(month=5), "store": P.override(store="3"), "state": P.override(state="NATION_3"),
              "two days": Params(fromdate=date(YEAR, 2, 1), todate=date(YEAR, 2, 2))}
    parts = []
    for name, p in scopes.items():
        exact = m.line_sales(p).agg(F.count_distinct("customer_key").alias("customers"), F.lit(0.0).alias("estimate"))
        guess = maintained.customers_by_sketch(m, path, p).select(F.lit(0).cast("bigint").alias("customers"), F.col("Value").cast("double").alias("estimate"))
        parts.append(exact.unionByName(guess).agg(F.sum("customers").alias("customers"), F.sum("estimate").alias("estimate")).select(
            F.lit(name).alias("scope"), "customers",
            (F.abs(F.col("estimate") - F.col("customers")) <= 0.5 + maintained.ERROR * F.col("customers")).alias("within")))
    return reshape.union_all(parts)


@model_check("kpi_total_customers_approx", with_fact(
    f"SELECT count(DISTINCT customer_key) AS customers, true AS within FROM fact WHERE y = {YEAR}"))
def _(m):
    """The estimated number of customers, held against the exact one: within four standard errors."""
    exact = kpis.kpi(m, P, "Total Customers").select(F.col("Value").alias("exact"), F.lit(0).cast("decimal(28,2)").alias("guess"))
    guess = kpis.approx_customers(m, P).select(F.lit(0).cast("decimal(28,2)").alias("exact"), F.col("Value").alias("guess"))
    return exact.unionByName(guess).agg(F.sum("exact").alias("exact"), F.sum("guess").alias("guess")).select(
        F.col("exact").cast("bigint").alias("customers"), (F.abs(F.col("exact") - F.col("guess")) <= 0.04 * F.col("exact")).alias("within"))


@model_check("new_customers_incremental", with_fact(new_sql()))
def _(m):
    """First purchases kept over three increments, the last one run twice, equal the count over the whole history."""
    path, days = scratch(m.spark, "first-purchases"), [None, date(YEAR, 3, 10), date(YEAR, 11, 1), date(YEAR + 2, 1, 1)]
    for start, stop in [*zip(days, days[1:]), (days[-2], days[-1])]:
        maintained.advance_first_purchases(m, path, start, stop)
    return maintained.new_customers(m.spark, path, days[-1], P)


# --- checksums -----------------------------------------------------------------------------------

STAFF = cx.entity_sql("staff")


def _sides(m):
    cells = cx.entity_db(m, P, "staff")
    k = F.substring("identifier", -3, 3).cast("int")
    export = cells.where(k % 17 != 0).withColumn("value", F.when(k % 19 == 0, F.lit("1")).otherwise(F.col("value")))
    more = cells.where(k % 23 == 0).withColumn("identifier", F.concat("identifier", F.lit(" X")))
    return export.unionByName(more), cells


_K = "CAST(right(identifier, 3) AS INTEGER)"


@model_check("key_sides_by_checksum", with_fact(
    f"""SELECT count(*) FILTER ({_K} % 17 <> 0) AS common, count(*) FILTER ({_K} % 23 = 0) AS export_only,
  count(*) FILTER ({_K} % 17 = 0) AS db_only FROM staff_db""", *STAFF))
def _(m):
    """Keys on either side, the common ones counted by checksums and never read."""
    export, db = _sides(m)
    left, right = (checksums.write_side(df, scratch(m.spark, "side"), reconcile.KEYS) for df in (export, db))
    return checksums.side_counts(left, right)


@model_check("values_by_checksum", with_fact(
    f"""SELECT identifier || ' X' AS identifier, 'export_only' AS side, CAST(amount AS VARCHAR) AS left_value, NULL AS right_value FROM staff_db WHERE {_K} % 23 = 0
UNION ALL SELECT identifier, 'db_only', NULL, CAST(amount AS VARCHAR) FROM staff_db WHERE {_K} % 17 = 0
UNION ALL SELECT identifier, 'changed', '1', CAST(amount AS VARCHAR) FROM staff_db WHERE {_K} % 17 <> 0 AND {_K} % 19 = 0""", *STAFF))
def _(m):
    """Rows that differ between two sides, of buckets whose checksums do."""
    export, db = _sides(m)
    left, right = (checksums.write_side(df, scratch(m.spark, "side"), reconcile.KEYS, ["value"]) for df in (export, db))
    return checksums.differences(left, right).select("identifier", "side", "left_value", "right_value")


# --- runs ------------------------------------------------------------------------------------------


@check("report_rerun_written", """SELECT 'Stores' AS sheet, s_name AS name, CAST(s_suppkey + 2 AS BIGINT) AS v FROM supplier
UNION ALL SELECT 'Products', p_name, CAST(p_partkey + 1 AS BIGINT) FROM part""")
def _(spark, folder):
    """Two runs, the second one aborted before it ended and then repeated, and a third that never ended."""
    m, path = bind_folder(spark, folder), scratch(spark, "runs")
    stores = lambda n: m.stores.select(F.lit("Stores").alias("sheet"), F.col("store").alias("name"), (F.col("store_key") + n).alias("v"))
    products = m.products.select(F.lit("Products").alias("sheet"), F.col("product").alias("name"), (F.col("product_key") + 1).alias("v"))
    sinks.write_run(stores(1).unionByName(products), path, "first", 1)
    stores(9).limit(2).write.parquet(os.path.join(path, "rows", "run=second"))  # what a lost driver left
    for _ in range(2):
        sinks.write_run(stores(2), path, "second", 2)
    stores(7).write.parquet(os.path.join(path, "rows", "run=third"))
    return sinks.read_latest_run(spark, path, products.schema)


# --- queries as SQL functions ------------------------------------------------------------------------

_SQL_QUERIES = ["SP_SalesTrend", "SP_TopPerformingEmployee", "SP_TopProductsBySales", "SP_WeekdayWeekendSales", "SP_WeekwiseSalesComparison",
                "SP_TopStoresbySales", "SP_TopBrandsBySales", "SP_TopCategoriesBySaleswidget", "SP_TopSubCategoriesBySales",
                "SP_WeeklyTrendswidget", "SP_StorewiseActualVsTarget_Vertical_SortedByActual", "SP_TopProductsBySaleswidget"]


def _called(m, arguments: str, names=tuple(_SQL_QUERIES)):
    sql_functions.register(m.spark, m)
    parts = []
    for name in names:
        result = m.spark.sql(f"SELECT * FROM {name}({arguments})")
        parts.append(reshape.format_result(result, name, match.output_shape_of(result.columns)))
    return reshape.union_all(parts).select("sheet", "identifier", "metric", "value")


model_check("sql_table_function", with_fact(cx.sheet_cells_sql({q: q for q in _SQL_QUERIES})))(
    lambda m: _called(m, f"year => {YEAR}"))
model_check("sql_table_function_by_position", with_fact(cx.sheet_cells_sql(
    {q: q for q in _SQL_QUERIES[:8]}, "state = 'NATION_3' AND channel = '1-URGENT'")))(
    lambda m: _called(m, f"{YEAR}, NULL, NULL, 'NATION_3', '1-URGENT'", _SQL_QUERIES[:8]))


@model_check("sql_table_function_kpis", with_fact(
    f"""SELECT CAST(CAST(sum(s) AS DECIMAL(28,2)) AS DOUBLE) AS total, CAST(count(DISTINCT bill) AS DOUBLE) AS bills,
  CAST(count(DISTINCT customer_key) AS DOUBLE) AS customers FROM fact WHERE y = {YEAR} AND month(d) = 5"""))
def _(m):
    """KPIs inside a query of the caller's own, their parameters bound as named markers."""
    sql_functions.register(m.spark, m)
    return m.spark.sql(
        """SELECT (SELECT Value FROM N_GetFilteredSalesData(:year, month => :month)) AS total,
             (SELECT Value FROM SP_TotalBillsKPI(:year, month => :month)) AS bills,
             (SELECT Value FROM TotalCustomersKPI(month => :month, year => :year)) AS customers""", args={"year": YEAR, "month": 5})


# --- what fails, and dates ------------------------------------------------------------------------------


def _failing(m):
    r = default_registry()
    r.register("SP_Fails", lambda m, p: m.products.select(F.raise_error(F.lit("boom")).alias("Sales"), "brand"))
    return r


@model_check("kpi_values_failing", with_fact(
    f"""SELECT 'Total No. of Bills' AS kpi_name, CAST(count(DISTINCT bill) AS VARCHAR) AS value FROM fact WHERE y = {YEAR}
UNION ALL SELECT 'Fails', 'DB Error' UNION ALL SELECT 'Missing', 'SP Not Found'"""))
def _(m):
    """One KPI fails while it runs and one is not registered; the others go on."""
    return kpi_values(_failing(m), m, P, {"Total No. of Bills": "SP_TotalBillsKPI", "Fails": "SP_Fails", "Missing": "SP_NoSuchQuery"})


@model_check("probe_failing", with_fact(
    f"""SELECT 'SP_TopBrandsBySales' AS sp_name, true AS works, count(DISTINCT brand) AS row_count FROM fact WHERE y = {YEAR}
UNION ALL SELECT 'SP_Fails', false, NULL"""))
def _(m):
    """A query that fails while it runs becomes a row of the probe."""
    return probe(_failing(m), m, P, ["SP_TopBrandsBySales", "SP_Fails"]).table().select("sp_name", "works", "row_count")


_FROM, _TO = date(YEAR, 2, 10), date(YEAR, 4, 20)
_RANGE = f"d BETWEEN DATE '{_FROM}' AND DATE '{_TO}'"


@model_check("landing_date_range", with_fact("\nUNION ALL ".join(
    f"SELECT '{s}' AS sheet, {c} AS identifier, CAST(CAST(sum(s) AS DECIMAL(28,2)) AS VARCHAR) AS value FROM fact WHERE {_RANGE} GROUP BY {c}"
    for s, c in (("Sales Summary_Top Stores by Sal", "store"), ("Sales Summary_Top Brands by Sal", "brand"), ("Sales Summary_Top Products by S", "product")))))
def _(m):
    """Landing queries over a range of dates, without a year."""
    p = Params(fromdate=_FROM, todate=_TO)
    table = {s: fv.LANDING_SHEETS[s] for s in ("Sales Summary_Top Stores by Sal", "Sales Summary_Top Brands by Sal", "Sales Summary_Top Products by S")}
    out = comparisons.landing_values(default_registry(), m.cubed(p), p, table)
    return out.where("metric = 'Actual Sales'").select("sheet", "identifier", "value")


@model_check("drill_weekly_trend_week", with_fact(
    f"""SELECT 'Week9' AS "Week", CAST(CAST(coalesce(sum(s) FILTER (WHERE y = {YEAR}), 0) AS DECIMAL(28,2)) AS DOUBLE) AS "CurrentYearSales",
  CAST(CAST(coalesce(sum(s) FILTER (WHERE y = {YEAR - 1}), 0) AS DECIMAL(28,2)) AS DOUBLE) AS "PreviousYearSales"
FROM fact WHERE y IN ({YEAR - 1}, {YEAR}) AND dayofyear(d) BETWEEN 57 AND 63"""))
def _(m):
    """One week of the weekly trends, pinned by its name."""
    p = replace(drill.target_params("Weekly Trends", "Week9"), year=YEAR)
    return widgets.weekly_trends(m, p)


@check("cells_missing_columns", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS cells FROM part")
def _(spark, folder):
    """A result without the columns of its shape gives no cells."""
    rows = cut(read_table(spark, folder, "part").select(F.col("p_name").alias("ProductName"), F.col("p_size").alias("NetSize")), "rows")
    cells = [reshape.format_result(rows, "sheet", s).select("value") for s in ("product_sales", "brand_sales", "monthly_trends", "metric_value_pairs")]
    counted = reshape.union_all(cells).select(F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("cells")).unionByName(
        rows.select(F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("cells")))
    return counted.agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"))


@model_check("report_wide_all_layouts", with_fact(
    f"""SELECT 'standard' AS layout, 'Sales Summary_Top Stores by Sal' AS sheet, count(DISTINCT store) AS n FROM fact WHERE y = {YEAR}
UNION ALL SELECT 'target', 'Sales Summary_Store Sales with', count(DISTINCT store) FROM fact WHERE y IN ({YEAR - 1}, {YEAR})
UNION ALL SELECT 'year', 'Sales Summary_Weekly Trends', count(DISTINCT (dayofyear(d) - 1) // 7) FROM fact WHERE y IN ({YEAR - 1}, {YEAR})"""))
def _(m):
    """Wide reports of the three layouts, written in folders by sheet and read back."""
    from salestally.checks.matching import SHEETS, sheet_rows

    cubed, path, wide = m.cubed(P), scratch(m.spark, "wide"), {}
    for sheet in ("Sales Summary_Top Stores by Sal", "Sales Summary_Store Sales with", "Sales Summary_Weekly Trends"):
        layout = reshape.layout_of(SHEETS[sheet][1])
        kind = comparisons.WIDE_OF[layout]
        rows = reshape.sheet_wide(sheet_rows(cubed, sheet), layout)
        cells = reshape.sheet_cells(sheet_rows(cubed, sheet), layout).withColumnRenamed("value_raw", "value")
        wide[kind] = reconcile.reconcile_wide(cut(rows, "rows"), cut(cells, "cells"), comparisons.WIDE_LAYOUTS[kind])
    sinks.write_wide_report(wide, path)
    parts = [sinks.read_report(m.spark, os.path.join(path, f"layout={k}")).groupBy(F.lit(k).alias("layout"), "sheet").agg(
        F.count(F.lit(1)).alias("n")) for k in wide]
    return reshape.union_all(parts)
