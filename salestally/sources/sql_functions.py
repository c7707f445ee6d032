"""The catalogue's queries as SQL table functions.

``SELECT * FROM SP_TopStoresbySales(year => 1997, state => 'NATION_3')``: seven filters by position or
by name, all with a default. The functions are SQL themselves and are put into the query that
calls them, so filters given as values reach the scans, and columns that are not asked for are not read.
Results are those of the registry's queries, unsorted.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from salestally.model import SalesModel

# the filters of every query, in the order of fixed_values.PARAM_FIELDS
PARAMS = [("year", "INT"), ("month", "INT"), ("store", "STRING"), ("state", "STRING"), ("channel", "STRING"),
          ("fromdate", "DATE"), ("todate", "DATE")]
VIEWS = ("lines", "orders", "stores", "products", "customers")

_MONEY = "DECIMAL(28,2)"


def _money(total: str) -> str:
    return f"CAST(CAST({total} AS DECIMAL(28,0)) * 0.0001BD AS {_MONEY})"


def _period(f: str, back: bool) -> str:
    """Predicate over ``order_ts``; ``back`` for the same period a year before."""
    year = f"{f}.year - 1" if back else f"{f}.year"
    first, last = (f"add_months({f}.{d}, -12)" if back else f"{f}.{d}" for d in ("fromdate", "todate"))
    start = f"greatest(make_date({year}, coalesce({f}.month, 1), 1), {first})"
    whole = f"CASE WHEN {f}.month IS NULL THEN make_date({year} + 1, 1, 1) ELSE add_months(make_date({year}, {f}.month, 1), 1) END"
    stop = f"least({whole}, date_add({last}, 1))"
    return (f"(({start}) IS NULL OR order_ts >= CAST({start} AS TIMESTAMP_NTZ)) AND (({stop}) IS NULL OR order_ts < CAST({stop} AS TIMESTAMP_NTZ)) "
            f"AND ({f}.year IS NOT NULL OR {f}.month IS NULL OR month(order_ts) = {f}.month)")


def _facts(name: str) -> str:
    """Lines with their orders in the filters; with ``compare`` the year before as well, told by ``current``."""
    now, before = _period(name, False), _period(name, True)
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}({_signature()}, compare BOOLEAN DEFAULT false)
RETURNS TABLE (order_key BIGINT, order_ts TIMESTAMP_NTZ, customer_key BIGINT, store_key BIGINT, product_key BIGINT, units BIGINT,
  sales DECIMAL(18,0), current BOOLEAN)
RETURN SELECT l.order_key, o.order_ts, o.customer_key, l.store_key, l.product_key, l.units, l.sales, ({now}) AS current
FROM sales_lines l JOIN sales_orders o ON l.order_key = o.order_key
WHERE (({now}) OR ({name}.compare AND ({before})))
  AND ({name}.channel IS NULL OR o.channel = {name}.channel)
  AND ({name}.store IS NULL OR l.store_key = try_cast(CASE WHEN {name}.store RLIKE '^[0-9]+$' THEN {name}.store END AS BIGINT))
  AND ({name}.state IS NULL OR (l.store_key, {name}.state) IN (SELECT store_key, state FROM sales_store_states))"""


def _signature() -> str:
    return ", ".join(f"{n} {t} DEFAULT NULL" for n, t in PARAMS)


def _pass(name: str) -> str:
    return ", ".join(f"{name}.{n}" for n, _ in PARAMS)


def _by_name(key: str, table: str, column: str, label: str, measure: str = "Sales"):
    """Sums by key first, names after."""
    def text(name: str) -> tuple[str, str]:
        return (f"`{label}` STRING, `{measure}` {_MONEY}",
                f"SELECT n.{column}, {_money('sum(f.sales)')} FROM (SELECT {key}, sum(sales) AS sales FROM sales_facts({_pass(name)}) GROUP BY {key}) f "
                f"JOIN sales_{table} n ON f.{key} = n.{key} GROUP BY n.{column}")
    return text


def _by_time(label: str, expression: str):
    """Both years by a label of the day."""
    def text(name: str) -> tuple[str, str]:
        now, before = (_money(f"coalesce(sum(CASE WHEN {test} THEN sales END), 0)") for test in ("current", "NOT current"))
        return (f"`{label}` STRING, `CurrentYearSales` {_MONEY}, `PreviousYearSales` {_MONEY}",
                f"SELECT label, {now}, {before} FROM (SELECT {expression} AS label, sales, current FROM sales_facts({_pass(name)}, true)) GROUP BY label")
    return text


def _actual_and_target(name: str) -> tuple[str, str]:
    now, before = (f"sum(CASE WHEN {test} THEN sales END)" for test in ("current", "NOT current"))
    target = f"CAST(CAST({before} AS DECIMAL(28,0)) * 0.0001BD * 1.10BD AS {_MONEY})"
    sums = (f"SELECT s.store, {_money(now)} AS a, {target} AS t FROM sales_facts({_pass(name)}, true) f "
            f"JOIN sales_stores s ON f.store_key = s.store_key GROUP BY s.store")
    return (f"`Identifier` STRING, `Metric` STRING, `Excel Value` {_MONEY}",
            f"SELECT store, metric, amount FROM ({sums}) LATERAL VIEW stack(2, 'Actual Sales', a, 'Target', t) v AS metric, amount")


def _total(expression: str):
    def text(name: str) -> tuple[str, str]:
        return f"`Value` {_MONEY}", f"SELECT CAST({expression} AS {_MONEY}) FROM sales_facts({_pass(name)})"
    return text


FUNCTIONS = {
    "SP_TopStoresbySales": _by_name("store_key", "stores", "store", "Identifier", "Actual Sales"),
    "SP_TopBrandsBySales": _by_name("product_key", "products", "brand", "BrandName"),
    "SP_TopCategoriesBySaleswidget": _by_name("product_key", "products", "category", "CategoryName"),
    "SP_TopSubCategoriesBySales": _by_name("product_key", "products", "sub_category", "CategoryName"),
    "SP_TopProductsBySales": _by_name("product_key", "products", "product", "ProductName"),
    "SP_TopProductsBySaleswidget": _by_name("product_key", "products", "product", "ProductName"),
    "SP_TopPerformingEmployee": _by_name("customer_key", "customers", "customer", "EmployeeName"),
    "SP_SalesTrend": _by_time("Month", "date_format(order_ts, 'MMM')"),
    "SP_WeekdayWeekendSales": _by_time("WeekCategory", "CASE WHEN dayofweek(order_ts) IN (1, 7) THEN 'WEEKEND SALES' ELSE 'WEEKDAY SALES' END"),
    "SP_WeekwiseSalesComparison": _by_time("Week", "concat('Week', (dayofmonth(order_ts) - 1) DIV 7 + 1)"),
    "SP_WeeklyTrendswidget": _by_time("Week", "concat('Week', (dayofyear(order_ts) - 1) DIV 7 + 1)"),
    "SP_StorewiseActualVsTarget_Vertical_SortedByActual": _actual_and_target,
    "N_GetFilteredSalesData": _total(f"coalesce({_money('sum(sales)')}, 0)"),
    "SP_TotalUnitsSoldkpi": _total("coalesce(CAST(sum(units) AS DECIMAL(28,0)) * 0.01BD, 0)"),
    "SP_TotalBillsKPI": _total("count(DISTINCT order_key)"),
    "TotalCustomersKPI": _total("count(DISTINCT customer_key)"),
}


def register(spark: SparkSession, model: SalesModel) -> list[str]:
    """Make the functions known to the session, over the tables of ``model``; their names."""
    for view in VIEWS:
        getattr(model, view).createOrReplaceTempView(f"sales_{view}")
    places = model.stores.join(model.states, "state_key").select("store_key", "state")
    places.createOrReplaceTempView("sales_store_states")
    spark.sql(_facts("sales_facts"))
    for name, text in FUNCTIONS.items():
        columns, body = text(name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({_signature()}) RETURNS TABLE ({columns}) RETURN {body}")
    return list(FUNCTIONS)
