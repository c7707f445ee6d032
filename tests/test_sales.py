"""Sales queries: filters, additivity, parameters."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from salestally import Params, default_registry, fixed_values as fv
from salestally.operators import drill, kpis, widgets
from salestally.params import default_params, from_mapping, valid

P = Params(year=1997)


def total(df):
    return df.first().Value


def test_stores_add_up(spark, model):
    stores = [r.store_key for r in model.stores.select("store_key").collect()]
    parts = sum(total(kpis.kpi(model, P.override(store=str(k)), "Total Sales")) for k in stores[:5])
    rows = widgets.top_stores(model, P).collect()
    names = {r.store for r in model.stores.filter(F.col("store_key").isin(stores[:5])).collect()}
    assert abs(parts - sum(r["Actual Sales"] for r in rows if r.Identifier in names)) < 1
    whole = total(kpis.kpi(model, P, "Total Sales"))
    assert abs(whole - sum(r["Actual Sales"] for r in rows)) < 1


def test_months_add_up_to_the_year(spark, model):
    months = widgets.monthly_trend(model, P).agg(F.sum("CurrentYearSales").alias("Value"))
    assert abs(total(months) - total(kpis.kpi(model, P, "Total Sales"))) < 1


@pytest.mark.parametrize("name", fv.CATALOGUE)
def test_written_facts_give_the_same(spark, model, name):
    r = default_registry()
    assert r.call(name, model, P).collect() == r.call(name, model.pinned(P), P).collect()


def test_written_facts_give_the_same_kpis(spark, model):
    def sets(m):
        return {r.kpi_name: r.value for r in kpis.kpi_set(m, P).collect()}
    assert sets(model) == sets(model.pinned(P))


def test_nothing_in_period(spark, model):
    empty = Params(year=1960)
    row = {r.kpi_name: r.value for r in kpis.kpi_set(model, empty).collect()}
    assert row["Total Sales"] == 0 and row["Total No. of Bills"] == 0 and row["Avg. Bill Value"] is None
    assert widgets.top_stores(model, empty).count() == 0


def test_period():
    assert Params(year=1997).period() == (date(1997, 1, 1), date(1998, 1, 1))
    assert Params(year=1997, month=12).period() == (date(1997, 12, 1), date(1998, 1, 1))
    assert Params(year=1997, fromdate=date(1997, 3, 5), todate=date(1999, 1, 1)).period() == (
        date(1997, 3, 5), date(1998, 1, 1))
    assert Params().period() == (None, None)
    leap = Params(year=2000, fromdate=date(2000, 2, 29)).previous_year()
    assert leap.fromdate == date(1999, 2, 28) and leap.year == 1999
    with pytest.raises(ValueError):
        Params().previous_year()


def test_fresh_and_override():
    assert P.fresh(date(2001, 7, 9)) == Params(year=2001, month=7)
    dated = Params(year=1997, fromdate=date(1997, 1, 1))
    assert dated.fresh(date(2001, 7, 9)) == dated
    assert P.override(store="3", month=None) == Params(year=1997, store="3")
    assert from_mapping({"Year": 1997, "Store": "3", "Other": 1}) == Params(year=1997, store="3")
    assert default_params().year == 2024


@pytest.mark.parametrize("p, ok", [
    (Params(year=2024), True), (Params(year=2019), False), (Params(year="2024"), False),
    (Params(year=2024, month=13), False), (Params(year=2024, store="1" * 11), False), (Params(), True),
])
def test_valid(p, ok):
    assert valid(p) is ok


def test_drill_target():
    assert drill.target_params("Top Stores by Sales", "Love Library").store == "717"
    assert drill.target_params("Top Stores by Sales", "720").store == "720"
    assert drill.target_params("Top Brands by Sales", "CRC Press").brand == "CRC Press"
    assert drill.target_params("Weekly Trends", "Week1").year_week == "Week1"
    assert drill.target_params("Other", "Thing") == Params(year=2024)


def test_calls(spark, model):
    r = default_registry()
    by_place = r.call_with("SP_TopBrandsBySales", model, 1997, None, None, None, None, None, None)
    by_name = r.call_with("SP_TopBrandsBySales", model, year=1997)
    assert by_place.collect() == by_name.collect()
    assert r.columns("SP_SalesTrend", model, P) == fv.RETURN_COLUMNS["monthly_trends"]
    with pytest.raises(KeyError):
        r.call("nothing", model, P)
