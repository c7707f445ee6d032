"""Grouped sales views: rankings, trends, comparisons, targets.

Facts are summed by key first and given their names after, so the name
tables meet one row per key. Money is exact until the last projection.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally.model import MONEY, SalesModel, amount, money, pieces
from salestally.params import Params


def _total() -> Column:
    return F.sum("sales")


def _ranked(df: DataFrame, measure: str, label: str, n: int | None, ordered: bool) -> DataFrame:
    """Descending by the measure, ties by label; a comparison takes the rows unsorted."""
    if n is None and not ordered:
        return df
    out = df.orderBy(F.col(f"`{measure}`").desc(), F.col(f"`{label}`"))
    return out if n is None else out.limit(n)


def _money(c: Column) -> Column:
    return F.coalesce(money(c), F.lit(0).cast(MONEY))


# --- rankings ---------------------------------------------------------------


def top_stores(model: SalesModel, p: Params, n: int | None = None,
               ordered: bool = True) -> DataFrame:
    by_key = model.sums(p, "store_key")
    named = (
        by_key.join(model.stores, "store_key")
        .groupBy(F.col("store").alias("Identifier"))
        .agg(_money(F.sum("now")).alias("Actual Sales"))
    )
    return _ranked(named, "Actual Sales", "Identifier", n, ordered)


def _top_by_product_column(model, p, column: str, label: str, n, ordered) -> DataFrame:
    by_key = model.sums(p, "product_key")
    named = (
        by_key.join(model.products, "product_key")
        .groupBy(F.col(column).alias(label))
        .agg(_money(F.sum("now")).alias("Sales"))
    )
    return _ranked(named, "Sales", label, n, ordered)


def top_brands(model: SalesModel, p: Params, n: int | None = None,
               ordered: bool = True) -> DataFrame:
    return _top_by_product_column(model, p, "brand", "BrandName", n, ordered)


def top_categories(model: SalesModel, p: Params, n: int | None = None,
                   ordered: bool = True) -> DataFrame:
    return _top_by_product_column(model, p, "category", "CategoryName", n, ordered)


def top_sub_categories(model: SalesModel, p: Params, n: int | None = None,
                       ordered: bool = True) -> DataFrame:
    return _top_by_product_column(model, p, "sub_category", "CategoryName", n, ordered)


def top_products(model: SalesModel, p: Params, n: int | None = None,
                 ordered: bool = True) -> DataFrame:
    return _top_by_product_column(model, p, "product", "ProductName", n, ordered)


def top_employees(model: SalesModel, p: Params, n: int | None = None,
                  ordered: bool = True) -> DataFrame:
    by_key = model.sums(p, "customer_key")
    named = (
        by_key.join(model.customers, "customer_key")
        .groupBy(F.col("customer").alias("EmployeeName"))
        .agg(_money(F.sum("now")).alias("Sales"))
    )
    return _ranked(named, "Sales", "EmployeeName", n, ordered)


# --- year over year ---------------------------------------------------------


def _two_years(model: SalesModel, p: Params, keys: list[Column]) -> DataFrame:
    return model.sums(p, "day", compare=True).groupBy(*keys).agg(
        _money(F.sum("now")).alias("CurrentYearSales"),
        _money(F.sum("before")).alias("PreviousYearSales"),
    )


def week_of_year(day: Column) -> Column:
    """Days 1 to 7 of the year are week 1; a week never spans two years."""
    return F.floor((F.dayofyear(day) - 1) / 7).cast("int") + 1


def week_of_month(day: Column) -> Column:
    return F.floor((F.dayofmonth(day) - 1) / 7).cast("int") + 1


def weekly_trends(model: SalesModel, p: Params) -> DataFrame:
    by_week = _two_years(model, p, [week_of_year(F.col("day")).alias("n")])
    return by_week.orderBy("n").select(
        F.concat(F.lit("Week"), F.col("n").cast("string")).alias("Week"),
        "CurrentYearSales", "PreviousYearSales",
    )


def weekwise_comparison(model: SalesModel, p: Params) -> DataFrame:
    label = F.concat(F.lit("Week"), week_of_month(F.col("day")).cast("string"))
    return _two_years(model, p, [label.alias("Week")]).orderBy("Week")


def monthly_trend(model: SalesModel, p: Params) -> DataFrame:
    day = F.col("day")
    by_month = _two_years(
        model, p, [F.month(day).alias("n"), F.date_format(day, "MMM").alias("Month")]
    )
    return by_month.orderBy("n").drop("n")


def weekday_weekend(model: SalesModel, p: Params) -> DataFrame:
    label = F.when(F.dayofweek("day").isin(1, 7), "WEEKEND SALES").otherwise("WEEKDAY SALES")
    return _two_years(model, p, [label.alias("WeekCategory")]).orderBy("WeekCategory")


_TREND_LABELS = {
    "brand": "BrandName",
    "category": "CategoryName",
    "sub_category": "CategoryName",
    "product": "ProductName",
}


def dimension_trend(model: SalesModel, p: Params, dimension: str) -> DataFrame:
    """Month by month for each brand, category, sub-category or product."""
    by_key = model.sums(p, "product_key", "month", compare=True).withColumnRenamed("month", "n")
    label = _TREND_LABELS[dimension]
    month = F.date_format(F.make_date(F.lit(2000), F.col("n"), F.lit(1)), "MMM")
    return (
        by_key.join(model.products, "product_key")
        .groupBy(F.col(dimension).alias(label), "n")
        .agg(
            _money(F.sum("now")).alias("CurrentYearSales"),
            _money(F.sum("before")).alias("PreviousYearSales"),
        )
        .orderBy(label, "n")
        .select(label, month.alias("Month"), "CurrentYearSales", "PreviousYearSales")
    )


# --- targets ------------------------------------------------------------------


def store_targets(model: SalesModel, p: Params, targets: DataFrame | None = None) -> DataFrame:
    """Actual and target per store as columns: Identifier, Actual Sales, Target.

    ``targets`` (store_key, target) replaces the default, which is the
    previous year's sales plus ten percent.
    """
    if targets is None:
        by_key = model.sums(p, "store_key", compare=True).withColumnRenamed("now", "sales")
        target = (amount(F.sum("before")) * F.lit(Decimal("1.10"))).cast(MONEY)
    else:
        by_key = (
            model.sums(p, "store_key").withColumnRenamed("now", "sales")
            .join(targets.select("store_key", "target"), "store_key", "left")
        )
        target = F.sum("target").cast(MONEY)
    return (
        by_key.join(model.stores, "store_key")
        .groupBy(F.col("store").alias("Identifier"))
        .agg(money(F.sum("sales")).alias("Actual Sales"), target.alias("Target"))
    )


def store_actual_vs_target(model: SalesModel, p: Params, targets: DataFrame | None = None,
                           ordered: bool = True) -> DataFrame:
    """One row per store and metric, best store first."""
    wide = store_targets(model, p, targets).withColumn("rank_by", F.col("Actual Sales"))
    out = wide.unpivot(["Identifier", "rank_by"], ["Actual Sales", "Target"], "Metric", "Excel Value")
    if ordered:
        out = out.orderBy(F.col("rank_by").desc_nulls_last(), "Identifier", "Metric")
    return out.drop("rank_by")


# --- details --------------------------------------------------------------------


def product_detail(model: SalesModel, p: Params) -> DataFrame:
    """Sales, units and bills per product inside the pinned dimension.

    Bills are distinct per product name, and names repeat across keys, so the
    name has to be known before counting. Spark counts them in two steps, by
    (name, bill) and then by name, so one big product spreads over its bills.
    """
    products = model.scoped_products(p).select("product_key", "product")
    return (
        model.line_sales(p).join(products, "product_key")
        .groupBy(F.col("product").alias("ProductName"))
        .agg(
            _money(_total()).alias("Sales"),
            pieces(F.sum("units")).alias("Units"),
            F.count_distinct("order_key").alias("Bills"),
        )
        .orderBy(F.col("Sales").desc(), "ProductName")
    )


def sales_by_region(model: SalesModel, p: Params) -> DataFrame:
    """Sales by region, state and category: the facts with all their dimensions."""
    by_key = model.line_sales(p).groupBy("store_key", "product_key").agg(_total().alias("sales"))
    return (
        by_key.join(model.products.select("product_key", "category"), "product_key")
        .groupBy("store_key", "category").agg(_total().alias("sales"))
        .join(model.stores.select("store_key", "state_key"), "store_key")
        .join(model.states, "state_key")
        .join(model.regions, "region_key")
        .groupBy("region", "state", "category")
        .agg(_money(_total()).alias("sales"))
    )
