"""Exports derived from query results, and the SQL of the same cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally.checks.analytics import (
    BOTH, MONTH, WEEK_OF_MONTH, WEEK_OF_YEAR, WEEKPART,
)
from salestally.checks.base import P, YEAR, cents
from salestally.model import MONEY, SalesModel, money
from salestally.params import Params

STORES_SHEET = "Sales Summary_Top Stores by Sal"
STAFF_SHEET = "Sales Summary_Top Performing Em"


def written(amount: Column, key: Column) -> Column:
    """Amount as an export shows it, by key: null, changed, formatted or plain."""
    plain = amount.cast("string")
    return (
        F.when(key % 13 == 0, F.lit(None).cast("string"))
        .when(key % 11 == 0, plain)
        .when(key % 7 == 0, (amount + 1).cast(MONEY).cast("string"))
        .when(key % 5 == 0, F.concat(F.lit("$"), F.format_number(amount, 2)))
        .otherwise(plain)
    )


def renamed(identifier: Column, key: Column) -> Column:
    return F.when((key % 11 == 0) & (key % 13 != 0), F.concat(identifier, F.lit(" X"))).otherwise(identifier)


def entity_export(model: SalesModel, p: Params, kind: str) -> DataFrame:
    """Stores or staff as exported: sheet, row_ord, Identifier, Actual Sales, amount."""
    key, names, name, sheet = {
        "stores": ("store_key", model.stores, "store", STORES_SHEET),
        "staff": ("customer_key", model.customers, "customer", STAFF_SHEET),
    }[kind]
    sums = model.line_sales(p).groupBy(key).agg(money(F.sum("sales")).alias("amount"))
    k = F.col(key)
    return sums.join(names, key).select(
        F.lit(sheet).alias("sheet"), k.alias("row_ord"),
        renamed(F.col(name), k).alias("Identifier"), written(F.col("amount"), k).alias("Actual Sales"),
    )


def entity_db(model: SalesModel, p: Params, kind: str) -> DataFrame:
    """The database side of the same sheet as cells."""
    from salestally.operators import reshape, widgets

    if kind == "stores":
        return reshape.format_result(widgets.top_stores(model, p), STORES_SHEET, "store_sales")
    return reshape.format_result(widgets.top_employees(model, p), STAFF_SHEET, "employee_performance")


def entity_sql(kind: str) -> tuple[str, str]:
    """Two SQL views: ``{kind}_db`` (k, identifier, amount) and ``{kind}_x`` the export of it."""
    key, name, sheet = {
        "stores": ("store_key", "store", STORES_SHEET), "staff": ("customer_key", "employee", STAFF_SHEET),
    }[kind]
    db = f"""{kind}_db AS (SELECT '{sheet}' AS sheet, {key} AS k, {name} AS identifier,
  CAST(sum(s) AS DECIMAL(28,2)) AS amount FROM fact WHERE y = {YEAR} GROUP BY {key}, {name})"""
    export = f"""{kind}_x AS (SELECT sheet, k AS row_ord,
  CASE WHEN k % 11 = 0 AND k % 13 <> 0 THEN identifier || ' X' ELSE identifier END AS identifier,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN amount WHEN k % 7 = 0 THEN amount + 1 ELSE amount END AS v,
  CASE WHEN k % 13 <> 0 AND k % 11 <> 0 AND k % 7 <> 0 AND k % 5 = 0 THEN '$' || format('{{:,.2f}}', CAST(amount AS DOUBLE))
       ELSE CAST(CAST(CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN amount
            WHEN k % 7 = 0 THEN amount + 1 ELSE amount END AS DECIMAL(28,2)) AS VARCHAR) END AS raw
  FROM {kind}_db)"""
    return db, export


def long_sql(kind: str) -> str:
    """Rows of the long report over ``{kind}_x`` and ``{kind}_db``."""
    return f"""SELECT x.sheet, x.row_ord, x.identifier, 'Actual Sales' AS metric,
  CAST(CAST(x.v AS DECIMAL(28,2)) AS VARCHAR) AS excel_value,
  coalesce(CAST(d.amount AS VARCHAR), 'Not Found') AS db_value,
  CASE WHEN x.v = d.amount THEN 'Match' ELSE 'Mismatch' END AS status
FROM {kind}_x x LEFT JOIN {kind}_db d ON d.identifier = x.identifier WHERE x.v IS NOT NULL"""


# --- cells of the catalogue queries in SQL ------------------------------------------------

_NOW = cents(f"coalesce(sum(s) FILTER (WHERE y = {YEAR}), 0)")
_BEFORE = cents(f"coalesce(sum(s) FILTER (WHERE y = {YEAR - 1}), 0)")


def _year_cells(label: str, where: str) -> str:
    return f"""SELECT {label} AS identifier, 'Current Year' AS metric, {_NOW} AS value FROM fact WHERE {BOTH} AND {where} GROUP BY 1
UNION ALL SELECT {label}, 'Previous Year', {_BEFORE} FROM fact WHERE {BOTH} AND {where} GROUP BY 1"""


def _plain_cells(key: str, where: str) -> str:
    return f"SELECT {key} AS identifier, 'Actual Sales' AS metric, {cents('sum(s)')} AS value FROM fact WHERE y = {YEAR} AND {where} GROUP BY 1"


def query_cells_sql(name: str, where: str = "true") -> str:
    """Cells (identifier, metric, value) of a catalogue query."""
    if name == "SP_StorewiseActualVsTarget_Vertical_SortedByActual":
        target = f"sum(s) FILTER (WHERE y = {YEAR - 1}) * CAST(1.10 AS DECIMAL(3,2))"
        return f"""SELECT * FROM (
SELECT store AS identifier, 'Actual Sales' AS metric, {cents(f'sum(s) FILTER (WHERE y = {YEAR})')} AS value
FROM fact WHERE {BOTH} AND {where} GROUP BY 1
UNION ALL SELECT store, 'Target', {cents(target)} FROM fact WHERE {BOTH} AND {where} GROUP BY 1) WHERE value IS NOT NULL"""
    years = {"SP_SalesTrend": MONTH, "SP_WeekdayWeekendSales": WEEKPART,
             "SP_WeekwiseSalesComparison": WEEK_OF_MONTH, "SP_WeeklyTrendswidget": WEEK_OF_YEAR}
    if name in years:
        return _year_cells(years[name], where)
    plain = {"SP_TopPerformingEmployee": "employee", "SP_TopProductsBySales": "product",
             "SP_TopProductsBySaleswidget": "product", "SP_TopStoresbySales": "store",
             "SP_TopBrandsBySales": "brand", "SP_TopCategoriesBySaleswidget": "category",
             "SP_TopSubCategoriesBySales": "sub_category"}
    return _plain_cells(plain[name], where)


def sheet_cells_sql(table: dict[str, str], where: str = "true") -> str:
    """Cells of several sheets: sheet -> query."""
    return "\nUNION ALL ".join(
        f"SELECT '{sheet}' AS sheet, identifier, metric, value FROM ({query_cells_sql(query, where)})"
        for sheet, query in table.items()
    )


