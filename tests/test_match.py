"""Sheets and the queries they are matched with."""

import pytest
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.checks.matching import EXPECTED, SHEETS
from salestally.operators import match

COLUMNS = {
    "SP_SalesTrend": "monthly_trends", "SP_TopPerformingEmployee": "employee_performance",
    "SP_TopProductsBySales": "product_sales", "SP_WeekdayWeekendSales": "weekday_weekend",
    "SP_WeekwiseSalesComparison": "weekly_trends", "SP_TopStoresbySales": "store_sales",
    "SP_TopBrandsBySales": "brand_sales", "SP_TopCategoriesBySaleswidget": "category_sales",
    "SP_TopSubCategoriesBySales": "category_sales", "SP_WeeklyTrendswidget": "weekly_trends",
    "SP_StorewiseActualVsTarget_Vertical_SortedByActual": "metric_value_pairs",
}


def found():
    return [
        (i, q, match.output_shape_of(fv.RETURN_COLUMNS[COLUMNS[q]]), 5, fv.RETURN_COLUMNS[COLUMNS[q]])
        for i, q in enumerate(fv.CATALOGUE)
    ]


def sheets(spark, table):
    rows = [(s, h, 5) for s, (_, h) in table.items()]
    return spark.createDataFrame(rows, "sheet string, headers array<string>, data_volume bigint")


def test_expected_mapping(spark):
    out = match.match_sheets(sheets(spark, SHEETS), found()).collect()
    assert {r.sheet: (r.sp_name, r.confidence, r.ties) for r in out} == EXPECTED


def test_floor_is_exclusive(spark):
    # a rule worth two tenths lifts the weekday sheet to exactly the floor or above it
    table = {"Day Sheet": (None, ["Identifier/Label", "Metric", "Excel Value"])}
    for points, kept in ((1, 0), (2, 1)):
        boosts = [("SP_WeekdayWeekendSales", ["day"], [], "any", points)]
        out = match.match_sheets(sheets(spark, table), found(), boosts=boosts)
        assert out.count() == kept


@pytest.mark.parametrize("headers, tags", [
    (["identifier", "actual sales"], ["sales_data"]),
    (["month", "current year"], ["monthly_data", "year_comparison"]),
    (["weekday", "revenue"], ["weekly_data", "weekday_weekend_data", "sales_data"]),
    (["store name", "target"], ["store_data", "target_data"]),
    (["x"], ["generic_data"]),
])
def test_tags(spark, headers, tags):
    df = spark.createDataFrame([(headers,)], "h array<string>")
    assert df.select(match.header_tags(F.col("h")).alias("t")).first().t == tags


@pytest.mark.parametrize("headers, keys", [
    (["store name", "identifier", "actual sales"], {"identifier": 1, "actual_sales": 2}),
    (["brand", "product", "sales"], {"identifier": 0, "sales": 2}),
    (["identifier/label", "metric", "excel value"], {"identifier": 0, "metric": 1, "excel_value": 2}),
    (["identifier", "previous year", "current year"], {"identifier": 0, "previous_year": 1, "current_year": 2}),
    (["a", "b"], {}),
])
def test_key_columns(spark, headers, keys):
    df = spark.createDataFrame([(headers,)], "h array<string>")
    found = df.select(match.key_columns(F.col("h")).alias("k")).first().k.asDict()
    assert {role: place for role, place in found.items() if place is not None} == keys


@pytest.mark.parametrize("columns, shape", [
    *[(c, s) for s, c in fv.RETURN_COLUMNS.items()
      if not s.startswith("kpi") and s != "weekday_weekend"],
    (["WeekCategory", "CurrentYearSales", "PreviousYearSales"], "weekly_trends"),
    (["DayType", "CurrentYearSales"], "weekday_weekend"),
    (["StoreName", "Sales"], "store_sales"), (["Label", "Sales"], "generic_sales"),
    (["Value"], "generic"), (["A", "B"], "generic"),
])
def test_shapes(spark, columns, shape):
    assert match.output_shape_of(columns) == shape
    df = spark.createDataFrame([(columns,)], "c array<string>")
    assert df.select(match.output_shape(F.col("c")).alias("s")).first().s == shape
