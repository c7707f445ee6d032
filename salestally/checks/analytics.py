"""KPIs, rankings, trends and drill-throughs."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from salestally.checks.base import P, YEAR, check, model_check, money, with_fact
from salestally.model import bind_folder, read_table
from salestally.operators import kpis, widgets
from salestally.params import Params
from salestally.sources import registry as reg

S = money("sum(s)")
S_NOW = money(f"coalesce(sum(s) FILTER (WHERE y = {YEAR}), 0)")
S_BEFORE = money(f"coalesce(sum(s) FILTER (WHERE y = {YEAR - 1}), 0)")
BOTH = f"y IN ({YEAR - 1}, {YEAR})"


# --- rankings -------------------------------------------------------------------------

def _top_sql(key: str, label: str, measure: str = "Sales", where: str = f"y = {YEAR}",
             limit: int | None = 10) -> str:
    text = f"""SELECT {key} AS "{label}", {S} AS "{measure}" FROM fact WHERE {where}
GROUP BY {key} ORDER BY 2 DESC, 1"""
    return with_fact(text + (f" LIMIT {limit}" if limit else ""))


model_check("top_stores", _top_sql("store", "Identifier", "Actual Sales"))(
    lambda m: widgets.top_stores(m, P, 10))
model_check("top_brands", _top_sql("brand", "BrandName"))(lambda m: widgets.top_brands(m, P, 10))
model_check("top_categories", _top_sql("category", "CategoryName"))(
    lambda m: widgets.top_categories(m, P, 10))
model_check("top_sub_categories", _top_sql("sub_category", "CategoryName"))(
    lambda m: widgets.top_sub_categories(m, P, 10))
model_check("top_products", _top_sql("product", "ProductName"))(
    lambda m: widgets.top_products(m, P, 10))
model_check("top_employees", _top_sql("employee", "EmployeeName"))(
    lambda m: widgets.top_employees(m, P, 10))
model_check("store_sales_all", _top_sql("store", "Identifier", "Actual Sales", limit=None))(
    lambda m: widgets.top_stores(m, P))
model_check("employee_sales_all_years", _top_sql("employee", "EmployeeName", where="true", limit=None))(
    lambda m: widgets.top_employees(m, Params()))


# --- year over year ----------------------------------------------------------------------

def _years_sql(label_sql: str, label: str, where: str = BOTH) -> str:
    return with_fact(
        f"""SELECT {label_sql} AS "{label}", {S_NOW} AS "CurrentYearSales",
       {S_BEFORE} AS "PreviousYearSales"
FROM fact WHERE {where} GROUP BY 1"""
    )


WEEK_OF_YEAR = "'Week' || CAST((dayofyear(d) - 1) // 7 + 1 AS INTEGER)"
WEEK_OF_MONTH = "'Week' || CAST((day(d) - 1) // 7 + 1 AS INTEGER)"
MONTH = "strftime(d, '%b')"
WEEKPART = "CASE WHEN dayofweek(d) IN (0, 6) THEN 'WEEKEND SALES' ELSE 'WEEKDAY SALES' END"

model_check("weekly_trends", _years_sql(WEEK_OF_YEAR, "Week"))(lambda m: widgets.weekly_trends(m, P))
model_check("weekwise_comparison", _years_sql(WEEK_OF_MONTH, "Week"))(
    lambda m: widgets.weekwise_comparison(m, P))
model_check("monthly_trend", _years_sql(MONTH, "Month"))(lambda m: widgets.monthly_trend(m, P))
model_check("weekday_weekend", _years_sql(WEEKPART, "WeekCategory"))(
    lambda m: widgets.weekday_weekend(m, P))


def _trend_sql(key: str, label: str) -> str:
    return with_fact(
        f"""SELECT {key} AS "{label}", {MONTH} AS "Month", {S_NOW} AS "CurrentYearSales",
       {S_BEFORE} AS "PreviousYearSales"
FROM fact WHERE {BOTH} GROUP BY 1, 2"""
    )


for _dimension, _label in [("brand", "BrandName"), ("category", "CategoryName"),
                           ("sub_category", "CategoryName"), ("product", "ProductName")]:
    model_check(f"{_dimension}_trend", _trend_sql(_dimension, _label))(
        lambda m, d=_dimension: widgets.dimension_trend(m, P, d))


# --- targets --------------------------------------------------------------------------------

TARGETS = f"""t AS (
  SELECT store, sum(s) FILTER (WHERE y = {YEAR}) AS actual,
         sum(s) FILTER (WHERE y = {YEAR - 1}) * CAST(1.10 AS DECIMAL(3,2)) AS target
  FROM fact WHERE {BOTH} GROUP BY store)"""
_PAIRS = f"""SELECT store AS "Identifier", 'Actual Sales' AS "Metric", {money('actual')} AS "Excel Value" FROM t
UNION ALL SELECT store, 'Target', {money('target')} FROM t"""
model_check("store_actual_vs_target", with_fact(_PAIRS, TARGETS))(
    lambda m: widgets.store_actual_vs_target(m, P))


@check("store_actual_vs_given_target", with_fact(
    f"""SELECT store AS "Identifier", 'Actual Sales' AS "Metric", {S} AS "Excel Value"
FROM fact WHERE y = {YEAR} GROUP BY store
UNION ALL SELECT s_name, 'Target', CAST(CAST(s_acctbal AS DECIMAL(28,2)) AS DOUBLE) FROM supplier"""))
def _(spark, folder):
    """Targets from a table of their own: here the account balance of the store."""
    given = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("store_key"), F.col("s_acctbal").cast("decimal(28,2)").alias("target"))
    return widgets.store_actual_vs_target(bind_folder(spark, folder), P, given)


# --- details ------------------------------------------------------------------------------------

def _detail_sql(where: str) -> str:
    return with_fact(
        f"""SELECT product AS "ProductName", {S} AS "Sales", {money('sum(units)')} AS "Units",
       count(DISTINCT bill) AS "Bills" FROM fact WHERE y = {YEAR} AND {where} GROUP BY 1"""
    )


model_check("product_detail", _detail_sql("true"))(lambda m: widgets.product_detail(m, P))
model_check("product_detail_in_brand", _detail_sql("brand = 'Brand#7'"))(
    lambda m: widgets.product_detail(m, replace(P, brand="Brand#7")))
model_check("product_detail_in_category", _detail_sql("category = 'ECONOMY'"))(
    lambda m: widgets.product_detail(m, replace(P, category="ECONOMY")))
model_check("sales_by_region", with_fact(
    f"SELECT region, state, category, {S} AS sales FROM fact WHERE y = {YEAR} GROUP BY 1, 2, 3"))(
    lambda m: widgets.sales_by_region(m, P))


# --- KPIs -----------------------------------------------------------------------------------------

# sums over no rows are 0, averages are null
AVERAGES = {
    "Total Sales": money("coalesce(sum(s), 0)"),
    "Total Units Sold": money("coalesce(sum(units), 0)"),
    "Total No. of Bills": "CAST(count(DISTINCT bill) AS DOUBLE)",
    "Avg. Bill Value": "round(CAST(sum(s) AS DOUBLE) / count(DISTINCT bill), 2)",
    "Avg. Daily Sales": "round(CAST(sum(s) AS DOUBLE) / count(DISTINCT d), 2)",
    "Total Customers": "CAST(count(DISTINCT customer_key) AS DOUBLE)",
}


def new_sql(where: str = "true") -> str:
    return f"""SELECT CAST(count(*) AS DOUBLE) AS "Value" FROM
(SELECT customer_key FROM fact WHERE {where} GROUP BY 1 HAVING year(min(d)) = {YEAR})"""


def area_sql(where: str = "true", stores: str = "true") -> str:
    return f"""SELECT round((SELECT CAST(sum(s) AS DOUBLE) FROM fact WHERE y = {YEAR} AND {where})
  / (SELECT sum(500 + 25 * (s_suppkey % 40)) FROM supplier WHERE {stores}), 2) AS "Value" """


def kpi_rows(where: str = "true", stores: str = "true") -> str:
    parts = [
        f"SELECT '{k}' AS kpi_name, {v} AS value FROM fact WHERE y = {YEAR} AND {where}"
        for k, v in AVERAGES.items()
    ]
    parts.append(f"""SELECT 'New Customers', "Value" FROM ({new_sql(where)})""")
    parts.append(f"""SELECT 'Sales per Sqft', "Value" FROM ({area_sql(where, stores)})""")
    return "\nUNION ALL ".join(parts)


for _name, _label in [("total_sales", "Total Sales"), ("total_units", "Total Units Sold"),
                      ("total_bills", "Total No. of Bills"), ("avg_bill_value", "Avg. Bill Value"),
                      ("avg_daily_sales", "Avg. Daily Sales"), ("total_customers", "Total Customers")]:
    model_check(f"kpi_{_name}", with_fact(
        f"""SELECT {AVERAGES[_label]} AS "Value" FROM fact WHERE y = {YEAR}"""))(
        lambda m, k=_label: kpis.kpi(m, P, k))
model_check("kpi_new_customers", with_fact(new_sql()))(lambda m: kpis.new_customers(m, P))
model_check("kpi_sales_per_area", with_fact(area_sql()))(lambda m: kpis.sales_per_area(m, P))
model_check("kpi_set", with_fact(kpi_rows()))(lambda m: kpis.kpi_set(m, P))
model_check("kpi_with_period", with_fact(
    f"""SELECT kpi_name AS "KPI_Name", value AS "Value", '{YEAR}-01-01 to {YEAR + 1}-01-01' AS "Period"
FROM ({kpi_rows()})"""))(lambda m: kpis.kpi_with_period(m, P))
model_check("kpi_comparison", with_fact(
    f"""SELECT now AS "Current_Value", before AS "Previous_Value", (now - before) * 100 / before AS "Change_Percent"
FROM (SELECT {S_NOW} AS now, {S_BEFORE} AS before FROM fact WHERE {BOTH})""".replace(
        "(now - before)",
        "CAST((CAST(now AS DECIMAL(28,2)) - CAST(before AS DECIMAL(28,2))) AS DOUBLE)")))(
    lambda m: kpis.kpi_comparison(m, P))


# --- filters and drill-throughs ---------------------------------------------------------------------

model_check("filter_month_state_channel", _top_sql(
    "store", "Identifier", "Actual Sales", limit=None,
    where=f"y = {YEAR} AND month(d) = 3 AND state = 'NATION_3' AND channel = '1-URGENT'"))(
    lambda m: widgets.top_stores(m, replace(P, month=3, state="NATION_3", channel="1-URGENT")))
model_check("filter_date_range", _top_sql(
    "brand", "BrandName", limit=None, where="d BETWEEN DATE '1996-11-15' AND DATE '1997-02-10'"))(
    lambda m: widgets.top_brands(m, Params(fromdate=date(1996, 11, 15), todate=date(1997, 2, 10))))
model_check("filter_month_of_any_year", _top_sql(
    "category", "CategoryName", limit=None, where="month(d) = 12"))(
    lambda m: widgets.top_categories(m, Params(month=12)))
model_check("filter_nothing", _top_sql("category", "CategoryName", limit=None, where="true"))(
    lambda m: widgets.top_categories(m, Params()))
model_check("drill_store_kpis", with_fact(kpi_rows("store_key = 17", "s_suppkey = 17")))(
    lambda m: kpis.kpi_set(m, replace(P, store="17")))
model_check("drill_state_kpis", with_fact(kpi_rows(
    "state = 'NATION_3'",
    "s_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')")))(
    lambda m: kpis.kpi_set(m, replace(P, state="NATION_3")))
model_check("drill_brand_months", _years_sql(MONTH, "Month", f"{BOTH} AND brand = 'Brand#7'"))(
    lambda m: widgets.monthly_trend(m, replace(P, brand="Brand#7")))
model_check("drill_category_weekparts", _years_sql(
    WEEKPART, "WeekCategory", f"{BOTH} AND category = 'ECONOMY'"))(
    lambda m: widgets.weekday_weekend(m, replace(P, category="ECONOMY")))
model_check("drill_sub_category_products", _top_sql(
    "product", "ProductName", limit=None, where=f"y = {YEAR} AND sub_category = 'ECONOMY / 11'"))(
    lambda m: widgets.top_products(m, replace(P, sub_category="ECONOMY / 11")))
model_check("drill_product_weeks", _years_sql(
    WEEK_OF_YEAR, "Week", f"{BOTH} AND product = 'small ring'"))(
    lambda m: widgets.weekly_trends(m, replace(P, product="small ring")))
model_check("drill_week_stores", _top_sql(
    "store", "Identifier", "Actual Sales", limit=None, where=f"y = {YEAR} AND day(d) BETWEEN 1 AND 7"))(
    lambda m: widgets.top_stores(m, replace(P, week="Week1")))


# --- calls by name ---------------------------------------------------------------------------------------

@model_check("call_by_position", _top_sql(
    "store", "Identifier", "Actual Sales", limit=None, where=f"y = {YEAR} AND month(d) = 6"))
def _(m):
    return reg.default_registry().call_with("SP_TopStoresbySales", m, YEAR, 6, None, None, None, None, None)


@model_check("call_by_name", _top_sql(
    "brand", "BrandName", limit=None, where=f"y = {YEAR} AND store_key = 17"))
def _(m):
    return reg.default_registry().call_with("SP_TopBrandsBySales", m, year=YEAR, store="17")


@check("sql_with_named_arguments", f"""SELECT o_orderpriority AS channel, count(*) AS n FROM orders
WHERE year(o_orderdate) = {YEAR} AND month(o_orderdate) = 5 GROUP BY 1""")
def _(spark, folder):
    return reg.sql_query(
        spark,
        """SELECT o_orderpriority AS channel, count(*) AS n FROM {orders}
           WHERE o_orderdate >= make_timestamp_ntz(:year, :month, 1, 0, 0, 0)
             AND o_orderdate < add_months(make_date(:year, :month, 1), 1)
           GROUP BY o_orderpriority""",
        replace(P, month=5),
        tables={"orders": read_table(spark, folder, "orders")},
    )


# --- probes ----------------------------------------------------------------------------------------------

_COUNTS = {
    "SP_SalesTrend": ("Month CurrentYearSales PreviousYearSales", "monthly_trends", f"SELECT DISTINCT month(d) FROM fact WHERE {BOTH}"),
    "SP_TopPerformingEmployee": ("EmployeeName Sales", "employee_performance", f"SELECT DISTINCT employee FROM fact WHERE y = {YEAR}"),
    "SP_TopProductsBySales": ("ProductName Sales", "product_sales", f"SELECT DISTINCT product FROM fact WHERE y = {YEAR}"),
    "SP_WeekdayWeekendSales": ("WeekCategory CurrentYearSales PreviousYearSales", "weekly_trends", f"SELECT DISTINCT {WEEKPART} FROM fact WHERE {BOTH}"),
    "SP_WeekwiseSalesComparison": ("Week CurrentYearSales PreviousYearSales", "weekly_trends", f"SELECT DISTINCT {WEEK_OF_MONTH} FROM fact WHERE {BOTH}"),
    "SP_TopStoresbySales": ("Identifier Actual Sales", "store_sales", f"SELECT DISTINCT store FROM fact WHERE y = {YEAR}"),
    "SP_TopBrandsBySales": ("BrandName Sales", "brand_sales", f"SELECT DISTINCT brand FROM fact WHERE y = {YEAR}"),
    "SP_TopCategoriesBySaleswidget": ("CategoryName Sales", "category_sales", f"SELECT DISTINCT category FROM fact WHERE y = {YEAR}"),
    "SP_TopSubCategoriesBySales": ("CategoryName Sales", "category_sales", f"SELECT DISTINCT sub_category FROM fact WHERE y = {YEAR}"),
    "SP_WeeklyTrendswidget": ("Week CurrentYearSales PreviousYearSales", "weekly_trends", f"SELECT DISTINCT {WEEK_OF_YEAR} FROM fact WHERE {BOTH}"),
    "SP_StorewiseActualVsTarget_Vertical_SortedByActual": ("Identifier Metric Excel Value", "metric_value_pairs", f"SELECT store, m FROM (SELECT DISTINCT store FROM fact WHERE {BOTH}), (VALUES (1), (2)) v(m)"),
}


def profile_sql(names: list[str], missing: tuple = ()) -> str:
    parts = []
    for i, name in enumerate(names):
        if name in missing:
            parts.append(f"""SELECT CAST({i} AS BIGINT) AS ord, '{name}' AS sp_name, false AS works,
CAST(NULL AS BIGINT) AS row_count, CAST(NULL AS VARCHAR) AS columns, CAST(NULL AS VARCHAR) AS output_pattern""")
        else:
            columns, shape, rows = _COUNTS[name]
            parts.append(f"""SELECT CAST({i} AS BIGINT) AS ord, '{name}' AS sp_name, true AS works,
(SELECT count(*) FROM ({rows})) AS row_count, '{columns}' AS columns, '{shape}' AS output_pattern""")
    return with_fact("\nUNION ALL ".join(parts))


def _profile(m, names=None, limit=None):
    found = reg.profile(reg.default_registry(), m, P, names, limit)
    return found.withColumn("ord", F.col("ord").cast("bigint"))


@check("probe_catalogue", profile_sql(list(_COUNTS)))
def _(spark, folder):
    """Every catalogue query: does it work, how many rows, which columns and shape."""
    return _profile(bind_folder(spark, folder)).drop("error")


@check("probe_first_three", profile_sql(list(_COUNTS)[:3]))
def _(spark, folder):
    return _profile(bind_folder(spark, folder), limit=3).drop("error")


_DRILL = ["SP_SalesTrend", "SP_TopBrandsBySales", "SP_TopPerformingEmployee",
          "SP_TopProductsBySales", "SP_WeekdayWeekendSales", "SP_WeekwiseSalesComparison"]


@check("probe_drill_through", profile_sql(_DRILL))
def _(spark, folder):
    """Drill-through queries that return rows, run once each with results kept."""
    m = bind_folder(spark, folder).pinned(P)
    found = reg.probe(reg.default_registry(), m, P, _DRILL).working()
    return found.select(
        F.col("ord").cast("bigint").alias("ord"), "sp_name", "works", "row_count",
        F.array_join("columns", " ").alias("columns"), "output_pattern")


@check("probe_with_failure", profile_sql(["SP_TopBrandsBySales", "SP_NoSuchQuery"], ("SP_NoSuchQuery",)))
def _(spark, folder):
    """A query that does not exist becomes a row and the probe goes on."""
    return _profile(bind_folder(spark, folder), ["SP_TopBrandsBySales", "SP_NoSuchQuery"]).drop("error")
