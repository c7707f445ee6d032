"""What the plans look like, and how they stand up to a hot key."""

import os

import pytest
from pyspark.sql import functions as F

from salestally import Params, bind
from salestally.checks import CHECKS
from salestally.operators import kpis, reconcile, widgets
from salestally.session import work_dir
from salestally.sources.exports import sample_rows

P = Params(year=1997)

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(model):
    text = plan(widgets.top_stores(model, P.override(store="3"), 10))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_discount:double>" in text
    assert "EqualTo(l_suppkey,3)" in text and "GreaterThanOrEqual(o_orderdate" in text
    assert "TakeOrderedAndProject" in text


def test_bills_combine_before_the_shuffle(model, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(kpis.bill_kpis(model, P, ["Total Sales", "Total No. of Bills"]))
    lines = [line for line in text.splitlines() if "Exchange hashpartitioning(order_key" in line]
    assert len(lines) == 2 and "partial_sum(sales" in text and "Expand" not in text


def test_rank_is_limited_before_the_shuffle(spark):
    rows = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("sheet"), F.col("id").alias("row_ord"),
        F.col("id").cast("string").alias("Identifier"))
    text = plan(sample_rows(rows.repartition(4), ["Identifier"]))
    assert text.count("WindowGroupLimit") == 2


SKEW = {
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10KB",
}


def test_hot_export_key_is_split(spark, conf):
    """A third of the rows under one name: AQE splits that key's partition."""
    conf(**SKEW)
    n = 60000
    export = spark.range(0, n, 1, 16).select(
        F.lit("S").alias("sheet"), F.col("id").alias("row_ord"),
        F.when(F.col("id") % 3 == 0, "Unknown").otherwise(F.col("id").cast("string")).alias("identifier"),
        F.lit("Actual Sales").alias("metric"), F.col("id").cast("string").alias("value_raw"))
    cells = export.filter("identifier <> 'Unknown'").select(
        "sheet", "identifier", "metric", F.col("value_raw").alias("value"))
    db = reconcile.override_union([cells])
    out = reconcile.reconcile_long(export, db, missing_status="Not Found")
    counts = {r.status: r.n for r in out.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"Match": n * 2 // 3, "Not Found": n // 3}
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    assert "skew=true" in plan(out)


@pytest.mark.parametrize("metrics", [["Actual Sales"]])
def test_hot_key_in_a_wide_report_is_split(spark, conf, metrics):
    conf(**SKEW)
    export = spark.range(0, 60000, 1, 16).select(
        F.lit("S").alias("sheet"), F.col("id").alias("row_ord"),
        F.when(F.col("id") % 3 == 0, "Unknown").otherwise(F.col("id").cast("string")).alias("identifier"),
        F.col("id").cast("string").alias("Actual Sales"))
    db = export.filter("identifier <> 'Unknown'").select(
        "sheet", "identifier", F.lit("Actual Sales").alias("metric"), F.col("Actual Sales").alias("value"))
    out = reconcile.reconcile_wide(export, db, metrics)
    assert len(out.collect()) == 60000
    assert "skew=true" in plan(out)


def hot_model(spark, n=60000):
    """A third of all lines on one order, store and product."""
    ids = spark.range(0, n, 1, 16)
    hot = F.col("id") % 3 == 0

    def key(size):
        return F.when(hot, 0).otherwise(F.col("id") % size).cast("bigint")

    tables = {
        "lineitem": ids.select(
            key(5000).alias("l_orderkey"), key(50).alias("l_partkey"), key(20).alias("l_suppkey"),
            F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
            (F.col("id") % 100 + 1).cast("double").alias("l_extendedprice"), F.lit(0.1).alias("l_discount")),
        "orders": spark.range(5000).select(
            F.col("id").alias("o_orderkey"), (F.col("id") % 300).alias("o_custkey"),
            F.expr("timestampadd(DAY, CAST(id % 730 AS INT), TIMESTAMP_NTZ '1996-01-01')").alias("o_orderdate"),
            F.lit("1-URGENT").alias("o_orderpriority")),
        "supplier": spark.range(20).select(
            F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), F.lit(0).alias("s_nationkey")),
        "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
        "part": spark.range(50).select(
            F.col("id").alias("p_partkey"), F.concat(F.lit("P"), "id").alias("p_name"), F.lit("B").alias("p_brand"),
            F.lit("T").alias("p_type"), F.lit(1).alias("p_size")),
        "customer": spark.range(300).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name")),
    }
    return bind(tables.__getitem__), tables


def test_hot_order_line_by_line(spark, conf):
    """The join of lines with orders is split at the hot order."""
    model, tables = hot_model(spark)
    want = {r.s: r.n for r in tables["lineitem"].join(
        tables["orders"].filter("year(o_orderdate) = 1996"), F.col("l_orderkey") == F.col("o_orderkey")
    ).groupBy(F.concat(F.lit("S"), "l_suppkey").alias("s")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * F.lit("0.9").cast("decimal(2,1)")).alias("n")).collect()}
    conf(**SKEW)
    out = widgets.top_stores(model, Params(year=1996))
    got = {r.Identifier: r["Actual Sales"] for r in out.collect()}
    assert {k: round(v, 2) for k, v in want.items()} == got
    assert "skew=true" in plan(out)


def test_hot_order_by_bill(spark, conf):
    """Bills meet in the join as unique keys: nothing is left to be skewed."""
    model, tables = hot_model(spark)
    conf(**SKEW)
    row = {r.kpi_name: float(r.value) for r in kpis.kpi_set(model, Params(year=1996)).collect()}
    sold = tables["lineitem"].join(
        tables["orders"].filter("year(o_orderdate) = 1996"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    assert row["Total Units Sold"] == 2 * sold
    assert row["Total Customers"] <= 300


def test_catalogue_reads_the_facts_once(model, tmp_path):
    """One scan of lines and orders fills the cube; the queries read their own part of it."""
    from salestally.operators import reshape
    from salestally.plans import comparisons
    from salestally.sources.registry import default_registry

    cubed, r = model.cubed(P), default_registry()
    for name in ("SP_TopStoresbySales", "SP_TopBrandsBySales", "SP_WeeklyTrendswidget", "SP_BrandTrends", "SP_TopPerformingEmployee"):
        text = plan(r.call(name, cubed, P, ordered=False))
        assert "lineitem" not in text and "PartitionFilters: [isnotnull(kind" in text, name
    assert "lineitem" in plan(r.call("SP_TopStoresbySales", cubed, P.override(store="3"), ordered=False))
    cells = comparisons.landing_values(r, cubed, P)
    assert "lineitem" not in plan(cells) and cells.count() > 0
    for name in ("SP_TopStoresbySales", "SP_WeekdayWeekendSales", "SP_CategoryTrends", "SP_StorewiseActualVsTarget_Vertical_SortedByActual"):
        assert r.call(name, cubed, P).collect() == r.call(name, model, P).collect()
    assert reshape.pick_columns(["Store"])


def test_hot_product_is_summed_before_it_moves(spark):
    """A third of all lines in one product and one store: each task sends one row per key and set."""
    m, _ = hot_model(spark, 20000)
    p = P.override(year=1996)
    cubed = m.cubed(p)
    counts = {r.kind: r.n for r in cubed.cube.rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[1] == 20 and counts[0] <= 50 * 12 and counts[3] <= 366
    assert widgets.top_products(cubed, p).collect() == widgets.top_products(m, p).collect()
    assert widgets.top_employees(cubed, p).collect() == widgets.top_employees(m, p).collect()
    text = plan(m.sums(p, "store_key"))
    assert "partial_sum" in text


def test_sheets_of_all_drops_share_written_facts(spark, folder):
    """Lines are joined with orders once, whatever the number of sheets that arrive."""
    written = lambda: {n for n in os.listdir(work_dir(spark)) if n.startswith("facts-")}
    before = written()
    assert CHECKS["arrivals_all_layouts"](spark, folder).count() == 9
    assert len(written() - before) == 1
