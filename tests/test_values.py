"""Cleaning of names and values on literal cells."""

import pytest
from pyspark.sql import functions as F

from salestally.functions import names, values


def one(spark, expression, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expression("v").alias("out")).first().out


@pytest.mark.parametrize("raw, expected", [
    ("1,234.50", "1234.50"), ("$12", "12.00"), ("₹7", "7.00"), ("1.5K", "1.50"), ("2M", "2.00"),
    ("N/A", "N/A"), ("nan", "nan"), ("inf", "inf"), ("1e5", "100000.00"), ("1.0d", "1.0d"), ("1f", "1f"),
    (" 12 ", "12.00"), ("", ""), ("1_000", "1_000"), ("-3.", "-3.00"), (".5", "0.50"), ("+4", "4.00"),
    ("12%", "12%"), ("0x1F", "0x1F"), ("NULL", "NULL"), (None, None),
    ("2.675", "2.68"), ("12345678.1", "12345678.10"), ("Not Found", "Not Found"),
])
def test_comparable(spark, raw, expected):
    assert one(spark, values.comparable, raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("1,234.50", "1234.5"), ("$12", "12"), ("1.5K", "1500"), ("2M", "2000000"), ("1.25B", "1250000000"),
    ("N/A", "N/A"), ("nan", "0"), ("none", "0"), ("NULL", "0"), ("", "0"), ("  ", "0"), (None, "0"),
    ("12%", "12"), ("100", "100"), ("0.50", "0.5"), ("7.126", "7.13"), ("1e2", "100"), ("-3.10", "-3.1"),
])
def test_normalised(spark, raw, expected):
    assert one(spark, values.normalised, raw) == expected


def test_scaled_suffix(spark):
    assert one(spark, lambda c: values.comparable(c, scale_suffix=True), "1.5K") == "1500.00"


@pytest.mark.parametrize("raw, expected", [
    ("Avg. Bill Value", "avg bill value"), ("avg bill  value", "avg bill value"), (" Total  Sales ", "total sales"),
])
def test_kpi_key(spark, raw, expected):
    assert one(spark, names.kpi_key, raw) == expected


def test_names(spark):
    assert one(spark, names.squash, "Top_Stores by Sales ") == "topstoresbysales"
    assert one(spark, names.letters_and_digits, "Top_Stores (2)") == "topstores2"
    assert len(one(spark, names.sheet_title, "x" * 40)) == 31
    assert one(spark, names.file_safe, "A b/c") == "A_b_c"
    assert one(spark, names.single_spaced, "  a \t b  ") == "a b"
    assert one(spark, names.last_word, "Top Products by Sales ") == "Sales"
    assert one(spark, names.short_month, "September") == "Sep"
    assert one(spark, names.short_month, "Sept") == "Sept"
    assert one(spark, names.identifier_or_unknown, None) == "Unknown"
    assert one(spark, names.identifier_or_unknown, "  ") == ""


def test_title_collisions(spark):
    df = spark.createDataFrame([("a" * 31 + "1",), ("a" * 31 + "2",), ("b",)], "sheet string")
    assert [tuple(r) for r in names.title_collisions(df).collect()] == [("a" * 31, 2)]


def test_percent(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    out = df.select(values.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in out] == ["33.3%", "0%"]
