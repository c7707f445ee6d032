"""Sales KPIs. Each is an aggregate over the bills of the filtered period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.model import MONEY, SalesModel, amount, is_current, money, pieces
from salestally.params import Params, in_period

# label -> aggregate over bills (one row per order, so bills need no distinct)
_AGGREGATES = {
    "Total Sales": lambda: F.coalesce(money(F.sum("sales")), F.lit(0).cast(MONEY)),
    "Total Units Sold": lambda: F.coalesce(pieces(F.sum("units")), F.lit(0).cast(MONEY)),
    "Total No. of Bills": lambda: F.count(F.lit(1)).cast(MONEY),
    "Avg. Bill Value": lambda: F.try_divide(amount(F.sum("sales")), F.count(F.lit(1))).cast(MONEY),
    "Avg. Daily Sales": lambda: F.try_divide(
        amount(F.sum("sales")), F.count_distinct(F.to_date("order_ts"))
    ).cast(MONEY),
    "Total Customers": lambda: F.count_distinct("customer_key").cast(MONEY),
}


def _unpivot(row: DataFrame, labels: list[str]) -> DataFrame:
    lines = [F.struct(F.lit(k).alias("kpi_name"), F.col(f"`{k}`").alias("value")) for k in labels]
    return row.select(F.inline(F.array(*lines)))


def bill_kpis(model: SalesModel, p: Params, labels: list[str] | None = None) -> DataFrame:
    """Several KPIs in one pass: (kpi_name, value)."""
    labels = labels or list(_AGGREGATES)
    row = model.bills(p).agg(*[_AGGREGATES[k]().alias(k) for k in labels])
    return _unpivot(row, labels)


def approx_customers(model: SalesModel, p: Params, rsd: float = 0.01) -> DataFrame:
    """Customers by a fixed-size sketch, where an estimate will do."""
    return model.bills(p).agg(
        F.approx_count_distinct("customer_key", rsd).cast(MONEY).alias("Value")
    )


def new_customers(model: SalesModel, p: Params) -> DataFrame:
    """Customers whose first bill in scope falls in the period.

    The scope filters apply to the whole history, the period only to the
    first day. Orders without a line in scope are no bills: they are removed
    by a semi-join that reads nothing of the lines but their order key, each
    key once, so that an order with very many lines is no burden to one task.
    """
    history = Params(channel=p.channel)
    lines = model._in_scope(model.lines, p).select("order_key").distinct()
    bills = model._orders(history, compare=False).join(lines, "order_key", "left_semi")
    first = bills.groupBy("customer_key").agg(F.min("order_ts").alias("order_ts"))
    test = in_period(p, F.col("order_ts"))
    count = F.count(F.lit(1)) if test is None else F.count_if(test)
    return first.agg(count.cast(MONEY).alias("Value"))


def floor_area(model: SalesModel, p: Params, areas: DataFrame | None = None) -> DataFrame:
    """(area) of the stores in scope, each store once; ``areas`` (store_key, area) replaces that of the store table."""
    stores = model.scoped_stores(p).select("store_key", "area")
    if areas is not None:
        stores = stores.drop("area").join(areas, "store_key")
    return stores.agg(F.sum("area").cast("bigint").alias("area"))


def sales_per_area(model: SalesModel, p: Params, areas: DataFrame | None = None) -> DataFrame:
    """Sales over the floor area of the stores in scope."""
    return kpi_set(model, p, ["Sales per Sqft"], areas).select(F.col("value").alias("Value"))


def kpi(model: SalesModel, p: Params, label: str, areas: DataFrame | None = None) -> DataFrame:
    """One KPI as a single ``Value``."""
    if label == "New Customers":
        return new_customers(model, p)
    if label == "Sales per Sqft":
        return sales_per_area(model, p, areas)
    return model.bills(p).agg(_AGGREGATES[label]().alias("Value"))


def kpi_set(model: SalesModel, p: Params, labels: list[str] | None = None,
            areas: DataFrame | None = None) -> DataFrame:
    """All wanted KPIs as (kpi_name, value); those over bills, sales per area among them, share one pass.

    Totals and floor area are one row each; they meet in a union and a final aggregation, not in a join.
    """
    labels = labels or list(fv.LANDING_KPIS)
    shared = [k for k in labels if k in _AGGREGATES]
    parts = []
    if per_area := "Sales per Sqft" in labels:
        floor = floor_area(model, p, areas)
        totals = model.bills(p).agg(*[_AGGREGATES[k]().alias(k) for k in shared], F.sum("sales").alias("sold"))
        both = totals.withColumn("area", F.lit(None).cast("bigint")).unionByName(
            floor.select(*[F.lit(None).cast(MONEY).alias(k) for k in shared], F.lit(None).cast("decimal(28,0)").alias("sold"), "area"))
        row = both.agg(*[F.max(f"`{k}`").alias(k) for k in shared],
                       F.try_divide(amount(F.max("sold")), F.max("area")).cast(MONEY).alias("Sales per Sqft"))
        parts.append(_unpivot(row, [*shared, "Sales per Sqft"]))
    elif shared:
        parts.append(bill_kpis(model, p, shared))
    for label in labels:
        if label not in _AGGREGATES and not (per_area and label == "Sales per Sqft"):
            parts.append(
                kpi(model, p, label, areas).select(
                    F.lit(label).alias("kpi_name"), F.col("Value").alias("value")
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_text(value: Column) -> Column:
    """KPI as text: whole numbers without decimals, else two places."""
    return F.regexp_replace(value.cast("string"), r"\.00$", "")


def kpi_with_period(model: SalesModel, p: Params, labels: list[str] | None = None) -> DataFrame:
    """KPI_Name, Value and the period the value stands for."""
    start, stop = p.period()
    text = f"{start or 'start'} to {stop or 'end'}"
    return kpi_set(model, p, labels).select(
        F.col("kpi_name").alias("KPI_Name"), F.col("value").alias("Value"),
        F.lit(text).alias("Period"),
    )


def kpi_comparison(model: SalesModel, p: Params) -> DataFrame:
    """Sales of the period, of the same period a year before, change in percent."""
    now = is_current(p)
    sums = model.day_sales(p, compare=True).agg(
        money(F.sum(F.when(now, F.col("sales")))).alias("Current_Value"),
        money(F.sum(F.when(~now, F.col("sales")))).alias("Previous_Value"),
    )
    change = F.try_divide(
        (F.col("Current_Value") - F.col("Previous_Value")).cast("double") * 100,
        F.col("Previous_Value").cast("double"),
    )
    return sums.withColumn("Change_Percent", change)
