"""Maintained tables, checksums, grams, runs and SQL functions: their plans, hot keys and reruns."""

import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from salestally import Params, default_registry
from salestally.operators import checksums, kpis, maintained, reconcile
from salestally.plans import sinks
from salestally.session import scratch
from salestally.sources import sql_functions
from salestally.sources.registry import profile

P = Params(year=1997)
KEYS = ["sheet", "identifier"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark, left, right, values=("v",)):
    make = lambda rows: spark.createDataFrame(rows, "sheet string, identifier string, v string")
    return [checksums.write_side(make(rows), scratch(spark, "side"), KEYS, values) for rows in (left, right)]


def test_differences_by_checksum(spark):
    base = [("S", f"k{i}", str(i)) for i in range(3000)] + [(None, "a", "1"), ("S", None, None), (None, None, "2")]
    left = base + [("S", "only left", "1"), ("S", "k7", "70"), ("", "a", "1")]
    right = [r for r in base if r[1] != "k9"] + [("S", "only right", None)]
    a, b = sides(spark, left, right)
    found = {(r.sheet, r.identifier, r.left_v, r.right_v, r.side) for r in checksums.differences(a, b).collect()}
    assert found == {("S", "only left", "1", None, "export_only"), ("S", "k7", "70", "7", "changed"), ("", "a", "1", None, "export_only"),
                     ("S", "k9", "9", None, "export_only"), ("S", "only right", None, None, "db_only")}
    # a few of the folders are read, and the rest is known to be equal
    tops = checksums.unequal(a, b, "top").count()
    assert 0 < tops <= 10
    text = plan(checksums.differences(a, b))
    assert text.count("PartitionFilters: [top") == 2 and " IN (" in text


def test_equal_sides_read_no_rows(spark):
    rows = [("S", f"k{i % 500}", str(i % 500)) for i in range(2000)]
    a, b = sides(spark, rows, list(reversed(rows)))
    assert checksums.differences(a, b).collect() == []
    assert checksums.side_counts(*sides(spark, rows, rows, ())).first().asDict() == {"common": 500, "export_only": 0, "db_only": 0}
    none = sides(spark, [], rows, ())
    assert checksums.side_counts(*none).first().asDict() == {"common": 0, "export_only": 0, "db_only": 500}


def test_counts_are_those_of_the_keys(spark):
    rng = random.Random(2)
    left, right = ([("S", f"k{rng.randrange(400)}", "1") for _ in range(300)] for _ in range(2))
    a, b = sides(spark, left, right, ())
    want = reconcile.key_side_counts(reconcile.key_sides(a.rows, b.rows, KEYS)).first()
    assert checksums.side_counts(a, b).first().asDict() == want.asDict()


def test_a_text_in_all_keys_is_no_burden(spark):
    """Each task keeps the first keys of an identifier before they move, and probes the rarest gram only."""
    keys = spark.range(3000).select(F.lit("Sheet").alias("sheet"), F.format_string("common %05d", "id").alias("identifier"),
                                    F.lit("Actual Sales").alias("metric"), F.lit("1").alias("value"))
    missing = spark.createDataFrame([("common",), ("n 00012",), ("",), ("o",), ("zz",), ("mm",), (None,)], "identifier string")
    out = reconcile.near_keys(missing, keys.repartition(4))
    got = {}
    for r in out.collect():
        got.setdefault(r.identifier, []).append(r.near_key)
    first = [f"Sheet - common {i:05d}" for i in range(3)]
    assert got["common"] == got[""] == got["o"] == got["mm"] == first and got["n 00012"] == ["Sheet - common 00012"] and "zz" not in got
    assert plan(out).count("WindowGroupLimit") == 2


def test_sketches_are_replaced_by_day(spark, model):
    path = scratch(spark, "sketches")
    maintained.advance_sketches(model, path, date(1997, 1, 1), date(1998, 1, 1))
    once = maintained.customers_by_sketch(model, path, P).first()[0]
    maintained.advance_sketches(model, path, date(1997, 3, 1), date(1997, 4, 1))
    assert maintained.customers_by_sketch(model, path, P).first()[0] == once
    assert abs(float(once) - float(kpis.kpi(model, P, "Total Customers").first()[0])) <= 2
    march = maintained.customers_by_sketch(model, path, P.override(month=3))
    assert "PartitionFilters: [isnotnull(day" in plan(march)
    with pytest.raises(ValueError):
        maintained.customers_by_sketch(model, path, P.override(channel="1-URGENT"))
    assert maintained.customers_by_sketch(model, path, Params(year=1990)).first()[0] == 0


def test_increments_read_new_days_only(spark, model):
    path = scratch(spark, "first")
    maintained.advance_first_purchases(model, path, None, date(1996, 6, 1))
    maintained.advance_first_purchases(model, path, date(1996, 6, 1), date(1999, 1, 1))
    for p in (P, P.override(month=2), Params(year=1996)):
        assert maintained.new_customers(spark, path, date(1999, 1, 1), p).collect() == kpis.new_customers(model, p).collect()
    days = maintained.days(date(1996, 6, 1), date(1996, 6, 2))
    assert "GreaterThanOrEqual(o_orderdate,1996-06-01" in plan(model.bills(days))


def test_runs_that_did_not_end_are_not_read(spark):
    path = scratch(spark, "runs")
    rows = lambda sheet, v: spark.createDataFrame([(sheet, v), (sheet, v + 1)], "sheet string, v int")
    sinks.write_run(rows("A", 1).unionByName(rows("B", 1)), path, "one", 1)
    rows("A", 50).write.parquet(os.path.join(path, "rows", "run=two"))
    schema = rows("A", 1).schema
    read = lambda: {(r.sheet, r.v) for r in sinks.read_latest_run(spark, path, schema).collect()}
    assert read() == {("A", 1), ("A", 2), ("B", 1), ("B", 2)}
    sinks.write_run(rows("A", 7), path, "two", 2)
    assert read() == {("A", 7), ("A", 8), ("B", 1), ("B", 2)}
    assert [(r.run, r.n_rows) for r in sinks.read_runs(spark, path).orderBy("seq").collect()] == [("one", 4), ("two", 2)]


@pytest.mark.parametrize("named", [
    {"year": 1997}, {"year": 1997, "month": 12}, {"year": 1997, "store": "3"}, {"year": 1997, "store": "no store"},
    {"fromdate": date(1996, 2, 29), "todate": date(1996, 4, 1)}, {"year": 1996, "todate": date(1996, 2, 10), "channel": "2-HIGH"}])
def test_sql_functions_give_the_registrys_rows(spark, model, named):
    r, text = default_registry(), ", ".join(f"{k} => :{k}" for k in named)
    sql_functions.register(spark, model)
    for name in ("SP_TopBrandsBySales", "SP_SalesTrend", "SP_TopStoresbySales", "SP_WeekwiseSalesComparison", "SP_TotalBillsKPI",
                 "SP_StorewiseActualVsTarget_Vertical_SortedByActual", "SP_TotalUnitsSoldkpi", "N_GetFilteredSalesData"):
        mine = spark.sql(f"SELECT * FROM {name}({text})", args=named)
        want = r.call(name, model, Params(**named))
        assert mine.columns == want.columns, name
        assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect())), name


def test_sql_functions_prune_and_push(spark, model):
    sql_functions.register(spark, model)
    text = plan(spark.sql("SELECT Identifier FROM SP_TopStoresbySales(1997, store => '3')"))
    assert "EqualTo(l_suppkey,3)" in text and "GreaterThanOrEqual(o_orderdate,1997-01-01" in text
    assert "l_quantity" not in text and "l_partkey" not in text and "sales_store_states" not in text


def test_a_profile_goes_on_where_a_query_fails(spark, model):
    r = default_registry()
    r.register("SP_Fails", lambda m, p: m.products.select(F.raise_error(F.lit("boom")).alias("Sales"), "brand"))
    found = {x.sp_name: x for x in profile(r, model, P, ["SP_TopBrandsBySales", "SP_Fails", "SP_Unknown"], run=True).collect()}
    assert found["SP_TopBrandsBySales"].works and found["SP_TopBrandsBySales"].row_count > 0
    assert not found["SP_Fails"].works and "boom" in found["SP_Fails"].error and not found["SP_Unknown"].works


def test_kpis_of_bills_take_one_pass(model):
    text = plan(kpis.kpi_set(model, P, ["Total Sales", "Total Customers", "Sales per Sqft"]))
    assert text.count("lineitem.parquet") == 1
