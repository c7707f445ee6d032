"""Odd inputs: weeks, dates without a year, missing columns, values out of range, queries that fail."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from salestally import Params
from salestally.functions.values import normalised
from salestally.operators import drill, reshape, widgets
from salestally.params import default_params
from salestally.plans import comparisons
from salestally.sources.registry import default_registry, kpi_values


def test_weeks_of_the_year_add_up(spark, model):
    """Each row of the weekly trends is the sum of its drill-through."""
    p = default_params()
    for row in widgets.weekly_trends(model, p).limit(3).collect() + widgets.weekly_trends(model, p).tail(1):
        pinned = drill.target_params("Weekly Trends", row["Week"])
        again = widgets.weekly_trends(model, pinned).collect()
        assert [tuple(r) for r in again] == [tuple(row)]


def test_bad_weeks_are_named(model):
    for p in (Params(week="Week6"), Params(year_week="Week54"), Params(week="7")):
        with pytest.raises(ValueError):
            model.line_sales(p)


def test_dates_without_a_year_compare_with_the_year_before():
    p = Params(fromdate=date(1996, 2, 29), todate=date(1996, 3, 5)).previous_year()
    assert (p.year, p.fromdate, p.todate) == (None, date(1995, 2, 28), date(1995, 3, 5))
    with pytest.raises(ValueError):
        Params(month=3).previous_year()


def test_columns_that_are_missing_give_no_cells(spark):
    one = spark.createDataFrame([("a",)], "Only string")
    for shape in reshape.FORMATTERS:
        assert reshape.format_result(one, "sheet", shape).collect() == []
    two = spark.createDataFrame([("a", 1)], "ProductName string, NetSales int")
    assert reshape.format_result(two, "sheet", "product_sales").collect() == []


def test_values_out_of_range_are_no_numbers(spark):
    df = spark.createDataFrame([("99999999999999999999999999B",), ("2K",)], "v string")
    assert [r.n for r in df.select(normalised("v").alias("n")).collect()] == ["99999999999999999999999999B", "2000"]


def test_failures_while_running_become_rows(spark, model):
    registry = default_registry()
    fails = lambda m, p: m.products.select(F.raise_error(F.lit("boom")).alias("Sales"), "brand")
    registry.register("SP_Fails", fails)
    p = default_params()
    assert [r.value for r in kpi_values(registry, model, p, {"Total Sales": "SP_Fails"}).collect()] == ["DB Error"]
    cells = comparisons.landing_values(registry, model, p, {"A": "SP_Fails"})
    assert [(r.sheet, r.value) for r in cells.collect()] == [("A", "Error")]
    assert comparisons.bundle_cells(registry, model, p, ["SP_Fails"]).collect() == []
