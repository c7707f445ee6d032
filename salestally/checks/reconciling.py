"""Reconciliations of derived exports with the queries they come from."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.checks import cells as cx
from salestally.checks.analytics import BOTH, MONTH, kpi_rows
from salestally.checks.base import P, YEAR, cents, check, model_check, with_fact
from salestally.model import MONEY, bind_folder, read_table
from salestally.operators import kpis, reconcile, report, reshape, widgets
from salestally.plans import comparisons, sinks
from salestally.session import scratch
from salestally.sources.registry import default_registry, kpi_values

STORES, STAFF = cx.entity_sql("stores"), cx.entity_sql("staff")


def _export(m, kind):
    return reshape.sheet_cells(cx.entity_export(m, P, kind), "entity")


def _long(m, kind, **options):
    return reconcile.reconcile_long(_export(m, kind), cx.entity_db(m, P, kind), **options)


# --- long reports ----------------------------------------------------------------------

model_check("reconcile_long_stores", with_fact(cx.long_sql("stores"), *STORES))(
    lambda m: _long(m, "stores"))
model_check("reconcile_long_staff", with_fact(cx.long_sql("staff"), *STAFF))(
    lambda m: _long(m, "staff"))
model_check("reconcile_missing_as_not_found", with_fact(
    f"""SELECT * REPLACE (CASE WHEN db_value = 'Not Found' THEN 'Not Found' ELSE status END AS status)
FROM ({cx.long_sql('staff')})""", *STAFF))(
    lambda m: _long(m, "staff", missing_status=fv.NOT_FOUND))


@model_check("reconcile_summary", with_fact(
    f"""SELECT sheet, count(*) AS total, count(*) FILTER (WHERE status = 'Match') AS matches,
  count(*) FILTER (WHERE status = 'Mismatch') AS mismatches, CAST(0 AS BIGINT) AS not_found,
  printf('%.1f%%', count(*) FILTER (WHERE status = 'Match') * 100.0 / count(*)) AS success_rate
FROM ({cx.long_sql('stores')} UNION ALL {cx.long_sql('staff')}) GROUP BY 1""", *STORES, *STAFF))
def _(m):
    """Status counts per sheet over two sheets reconciled together."""
    export = _export(m, "stores").unionByName(_export(m, "staff"))
    db = cx.entity_db(m, P, "stores").unionByName(cx.entity_db(m, P, "staff"))
    return report.sheet_summary(reconcile.reconcile_long(export, db))


@model_check("reconcile_with_itself", with_fact(
    f"""SELECT count(*) AS total, count(*) AS matches, '100.0%' AS success_rate FROM (
{cx.sheet_cells_sql({n: n for n in fv.CATALOGUE})})"""))
def _(m):
    """Every cell of the catalogue against itself: all match."""
    pinned = m.pinned(P)
    r = default_registry()
    db = reconcile.override_union([
        reshape.format_result(d, n, reshape_shape(d)) for n, d in
        ((n, r.call(n, pinned, P)) for n in fv.CATALOGUE)])
    export = db.select("sheet", F.lit(0).cast("bigint").alias("row_ord"), "identifier", "metric",
                       F.col("value").alias("value_raw"))
    return report.kpi_summary(reconcile.reconcile_long(export, db)).select(
        "total", "matches", "success_rate")


def reshape_shape(df):
    from salestally.operators.match import output_shape_of

    return output_shape_of(df.columns)


# --- metric/value pairs -------------------------------------------------------------------

_PAIR_DB = f"""p AS (SELECT store_key AS k, store AS identifier,
  CAST(sum(s) FILTER (WHERE y = {YEAR}) AS DECIMAL(28,2)) AS actual,
  CAST(sum(s) FILTER (WHERE y = {YEAR - 1}) * CAST(1.10 AS DECIMAL(3,2)) AS DECIMAL(28,2)) AS target
  FROM fact WHERE {BOTH} GROUP BY 1, 2)"""


@model_check("reconcile_pairs", with_fact(
    """SELECT identifier, metric, CAST(CAST(CASE WHEN k % 13 = 0 THEN NULL WHEN k % 7 = 0 THEN v + 1 ELSE v END AS DECIMAL(28,2)) AS VARCHAR) AS excel_value,
  CAST(v AS VARCHAR) AS db_value, CASE WHEN k % 13 = 0 OR k % 7 = 0 THEN 'Mismatch' ELSE 'Match' END AS status
FROM (SELECT k, identifier, 'Actual Sales' AS metric, actual AS v FROM p UNION ALL SELECT k, identifier, 'Target', target FROM p)""",
    _PAIR_DB))
def _(m):
    """Metric text is data; an empty exported value is kept and does not match."""
    db = reshape.format_result(
        widgets.store_actual_vs_target(m, P), "Store Sales", "metric_value_pairs")
    k = F.col("store_key")
    rows = db.join(m.stores, F.col("identifier") == F.col("store")).select(
        F.lit("Store Sales").alias("sheet"), k.alias("row_ord"),
        F.col("identifier").alias("Identifier/Label"), F.col("metric").alias("Metric"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .when(k % 7 == 0, (F.col("value").cast(MONEY) + 1).cast(MONEY).cast("string"))
        .otherwise(F.col("value")).alias("Excel Value"))
    return reconcile.reconcile_long(reshape.sheet_cells(rows, "metric"), db).select(
        "identifier", "metric", "excel_value", "db_value", "status")


# --- wide reports ----------------------------------------------------------------------------

def _wide_status(v: str, d: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 'Match' WHEN {d} IS NULL THEN 'Not Found' WHEN {v} = {d} THEN 'Match' ELSE 'Mismatch' END"


model_check("reconcile_wide_standard", with_fact(
    f"""SELECT x.sheet, x.row_ord, x.identifier, x.raw AS "Excel Actual Sales",
  coalesce(CAST(d.amount AS VARCHAR), 'Not Found') AS "DB Actual Sales",
  {_wide_status('x.v', 'd.amount')} AS "Actual Sales Status", x.v IS NOT NULL AS compared
FROM staff_x x LEFT JOIN staff_db d ON d.identifier = x.identifier""", *STAFF))(
    lambda m: reconcile.reconcile_wide(
        cx.entity_export(m, P, "staff").withColumnRenamed("Identifier", "identifier"),
        cx.entity_db(m, P, "staff"), ["Actual Sales"]))


@model_check("reconcile_wide_targets", with_fact(
    f"""SELECT identifier, CAST(xa AS VARCHAR) AS "Excel Actual Sales", CAST(actual AS VARCHAR) AS "DB Actual Sales",
  {_wide_status('xa', 'actual')} AS "Actual Sales Status",
  CAST(xt AS VARCHAR) AS "Excel Target", CAST(target AS VARCHAR) AS "DB Target",
  {_wide_status('xt', 'target')} AS "Target Status", xa IS NOT NULL AND xt IS NOT NULL AS compared
FROM (SELECT *, CAST(CASE WHEN k % 13 = 0 THEN NULL WHEN k % 7 = 0 THEN actual + 1 ELSE actual END AS DECIMAL(28,2)) AS xa,
             CAST(CASE WHEN k % 6 = 0 THEN target - 1 ELSE target END AS DECIMAL(28,2)) AS xt FROM p)""", _PAIR_DB))
def _(m):
    """Actual and target per store, a status for each."""
    both = widgets.store_targets(m, P)
    db = reshape.format_result(both, "Store Sales", "store_sales")
    k = F.col("store_key")
    export = both.join(m.stores, F.col("Identifier") == F.col("store")).select(
        F.lit("Store Sales").alias("sheet"), k.alias("row_ord"), F.col("Identifier").alias("identifier"),
        F.when(k % 13 == 0, None).when(k % 7 == 0, F.col("Actual Sales") + 1)
        .otherwise(F.col("Actual Sales")).cast(MONEY).cast("string").alias("Actual Sales"),
        F.when(k % 6 == 0, F.col("Target") - 1).otherwise(F.col("Target"))
        .cast(MONEY).cast("string").alias("Target"))
    return reconcile.reconcile_wide(export, db, ["Actual Sales", "Target"]).drop("sheet", "row_ord")


_MONTHS = f"""mo AS (SELECT {MONTH} AS identifier, month(d) AS k,
  CAST(coalesce(sum(s) FILTER (WHERE y = {YEAR}), 0) AS DECIMAL(28,2)) AS now,
  CAST(coalesce(sum(s) FILTER (WHERE y = {YEAR - 1}), 0) AS DECIMAL(28,2)) AS before
  FROM fact WHERE {BOTH} GROUP BY 1, 2)"""


@model_check("reconcile_wide_years", with_fact(
    f"""SELECT identifier, CAST(before AS VARCHAR) AS "Excel Previous Year", CAST(before AS VARCHAR) AS "DB Previous Year",
  'Match' AS "Previous Year Status", CAST(CAST(now + CASE WHEN identifier LIKE 'J%' THEN 2 ELSE 0 END AS DECIMAL(28,2)) AS VARCHAR) AS "Excel Current Year",
  CAST(now AS VARCHAR) AS "DB Current Year", CASE WHEN identifier LIKE 'J%' THEN 'Mismatch' ELSE 'Match' END AS "Current Year Status",
  true AS compared FROM mo""", _MONTHS))
def _(m):
    """Month by month; the months that begin with J are exported two too high."""
    result = widgets.monthly_trend(m, P)
    db = reshape.format_result(result, "Sales Trends", "monthly_trends")
    off = F.when(F.col("Month").startswith("J"), 2).otherwise(0)
    export = result.select(
        F.lit("Sales Trends").alias("sheet"), F.lit(0).cast("bigint").alias("row_ord"),
        F.col("Month").alias("identifier"), F.col("PreviousYearSales").cast("string").alias("Previous Year"),
        (F.col("CurrentYearSales") + off).cast(MONEY).cast("string").alias("Current Year"))
    return reconcile.reconcile_wide(export, db, ["Previous Year", "Current Year"]).drop("sheet", "row_ord")


@model_check("wide_status_counts", with_fact(
    f"""SELECT 'Actual Sales' AS metric, {_wide_status('x.v', 'd.amount')} AS status, count(*) AS n
FROM staff_x x LEFT JOIN staff_db d ON d.identifier = x.identifier GROUP BY 2""", *STAFF))
def _(m):
    wide = reconcile.reconcile_wide(
        cx.entity_export(m, P, "staff").withColumnRenamed("Identifier", "identifier"),
        cx.entity_db(m, P, "staff"), ["Actual Sales"])
    return report.wide_status_counts(wide, ["Actual Sales"])


# --- KPIs ---------------------------------------------------------------------------------------

def _kpi_export(m):
    """KPI values as a card list: one renamed, one changed, one unknown, one repeated."""
    name, text = F.col("kpi_name"), kpis.value_text(F.col("value"))
    cards = kpis.kpi_set(m, P).select(
        F.when(name == "Avg. Bill Value", F.lit("avg bill  value")).otherwise(name).alias("kpi_name"),
        F.when(name == "Total Customers", (F.col("value") + 1).cast("bigint").cast("string"))
        .otherwise(text).alias("value_raw"), F.lit(1).alias("ord"))
    more = cards.filter("kpi_name = 'Total Sales'").select(
        F.explode(F.array(F.lit("Gross Margin"), F.lit("Total Sales"))).alias("kpi_name"),
        F.lit("1").alias("value_raw"), F.lit(0).alias("ord"))
    return cards.unionByName(more)


def _kpi_registry():
    r = default_registry()
    del r.queries["SalesPerSqftKPI"], r.kpi_labels["SalesPerSqftKPI"]
    r.register("SP_NewCustomersKPI", lambda m, p: m.orders.select("no_such_column"))
    return r


_KPI_SQL = f"""WITH_V AS (SELECT kpi_name, regexp_replace(CAST(CAST(value AS DECIMAL(28,2)) AS VARCHAR), '\\.00$', '') AS v,
  value FROM ({kpi_rows()})),
report AS (SELECT CASE WHEN kpi_name = 'Avg. Bill Value' THEN 'avg bill  value' ELSE kpi_name END AS kpi_name,
  CASE WHEN kpi_name = 'Total Customers' THEN CAST(CAST(value + 1 AS BIGINT) AS VARCHAR) ELSE v END AS excel_value,
  CASE kpi_name WHEN 'Sales per Sqft' THEN 'SP Not Found' WHEN 'New Customers' THEN 'DB Error' ELSE v END AS db_value,
  CASE kpi_name WHEN 'Sales per Sqft' THEN 'SP Missing' WHEN 'New Customers' THEN 'DB Error'
    WHEN 'Total Customers' THEN 'Mismatch' ELSE 'Match' END AS status,
  CASE kpi_name WHEN 'Sales per Sqft' THEN 'Stored procedure does not exist in database'
    WHEN 'New Customers' THEN 'Database error occurred' WHEN 'Total Customers' THEN 'Values do not match'
    ELSE 'Values match perfectly' END AS notes FROM WITH_V
UNION ALL SELECT 'Gross Margin', '1', 'Not Found', 'No SP Mapping', 'No stored procedure mapped for this KPI')""".replace("WITH_V", "kv")

model_check("reconcile_kpis", with_fact("SELECT * FROM report", _KPI_SQL))(
    lambda m: comparisons.compare_kpis(_kpi_export(m), _kpi_registry(), m, P)[0])
model_check("reconcile_kpis_summary", with_fact(
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Match') AS matches,
  count(*) FILTER (WHERE status = 'Mismatch') AS mismatches,
  count(*) FILTER (WHERE status = 'No SP Mapping') AS no_mapping,
  count(*) FILTER (WHERE status IN ('SP Missing', 'DB Error')) AS sp_errors,
  printf('%.1f%%', count(*) FILTER (WHERE status = 'Match') * 100.0 / count(*)) AS success_rate,
  CAST(count(*) FILTER (WHERE status = 'Match') AS DOUBLE) * 100 / count(*) AS success_percent FROM report""", _KPI_SQL))(
    lambda m: comparisons.compare_kpis(_kpi_export(m), _kpi_registry(), m, P)[1])


@model_check("reconcile_kpis_numeric", with_fact(
    f"SELECT kpi_name, 'Match' AS status FROM ({kpi_rows('store_key = 17', 's_suppkey = 17')})"))
def _(m):
    """Amounts written with signs and separators match when compared as numbers."""
    p = replace(P, store="17")
    export = kpis.kpi_set(m, p).select(
        "kpi_name", F.concat(F.lit("$"), F.format_number("value", 2)).alias("value_raw"))
    db = kpi_values(default_registry(), m, p)
    return reconcile.reconcile_kpis(export, db, numeric=True).select("kpi_name", "status")


model_check("kpi_values_by_name", with_fact(
    f"""SELECT kpi_name, regexp_replace(CAST(CAST(value AS DECIMAL(28,2)) AS VARCHAR), '\\.00$', '') AS value
FROM ({kpi_rows('store_key = 17', 's_suppkey = 17')})
WHERE kpi_name IN ('Total Sales', 'Total Units Sold', 'Avg. Bill Value', 'Total No. of Bills', 'Total Customers')"""))(
    lambda m: kpi_values(default_registry(), m, replace(P, store="17"), fv.DRILL_KPIS))


@model_check("first_value_or_text", with_fact(
    f"""SELECT 'sales' AS what, {cents('sum(s)')} AS value FROM fact WHERE y = {YEAR}
UNION ALL SELECT 'nothing', 'No Data'"""))
def _(m):
    """First cell of a result; a text where it has no rows."""
    some = reshape.first_value(kpis.kpi(m, P, "Total Sales"))
    none = reshape.first_value(widgets.top_stores(m, replace(P, channel="no such channel")))
    return some.select(F.lit("sales").alias("what"), "value").unionByName(
        none.select(F.lit("nothing").alias("what"), "value"))


# --- ordered fallbacks -------------------------------------------------------------------------------

@model_check("first_hit_of_keys", f"""SELECT c_custkey, v AS value FROM (
  SELECT c.c_custkey, CASE WHEN c.c_custkey % 2 = 0 THEN a.v ELSE coalesce(b.v, a.v) END AS v FROM customer c
  LEFT JOIN (SELECT c_custkey, CAST(count(*) AS VARCHAR) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) a USING (c_custkey)
  LEFT JOIN (SELECT c_custkey, 'urgent ' || count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey
             WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b USING (c_custkey))""")
def _(m):
    """Per customer an ordered list of keys; the first that exists gives the value."""
    orders = m.orders.groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("channel") == "1-URGENT").alias("u"))
    db = orders.select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("all "), F.col("customer_key").cast("string")).alias("key"),
                     F.col("n").cast("string").alias("value")),
            F.struct(F.concat(F.lit("urgent "), F.col("customer_key").cast("string")).alias("key"),
                     F.when(F.col("u") > 0, F.concat(F.lit("urgent "), F.col("u").cast("string"))).alias("value")),
        )).alias("e")).select("e.key", "e.value").filter("value IS NOT NULL")
    k = F.col("customer_key").cast("string")
    keys = F.array_compact(F.array(
        F.concat(F.lit("never "), k),
        F.when(F.col("customer_key") % 2 == 1, F.concat(F.lit("urgent "), k)),
        F.concat(F.lit("all "), k)))
    return reconcile.first_hit(m.customers, keys, db, ["customer_key"]).select(
        F.col("customer_key").alias("c_custkey"), "value")


def _by_where(where: str) -> str:
    return cx.query_cells_sql("SP_WeekdayWeekendSales", where)


@model_check("reconcile_store_bundle", with_fact(
    f"""SELECT sheet, metric, status, count(*) AS n FROM (
SELECT 'Sales Summary_Sales Trends' AS sheet, metric, 'Match' AS status FROM ({cx.query_cells_sql('SP_SalesTrend', 'store_key = 17')})
UNION ALL SELECT 'Sales Summary_Top Performing Em', metric, 'Match' FROM ({cx.query_cells_sql('SP_TopPerformingEmployee', 'store_key = 17')})
UNION ALL SELECT 'Sales Summary_Sales by Product', metric, 'Match' FROM ({cx.query_cells_sql('SP_TopProductsBySales', 'store_key = 17')})
UNION ALL SELECT 'Day Report', metric, 'Match' FROM ({_by_where('store_key = 17')})
UNION ALL SELECT 'Day Report', metric, 'Mismatch' FROM ({_by_where('store_key = 17')})
) GROUP BY 1, 2, 3"""))
def _(m):
    """Sheets of one store; a sheet of another name finds its values by its other keys."""
    p, r = replace(P, store="17"), default_registry()

    def cells(query, sheet, shape, identifier=None):
        c = reshape.format_result(r.call(query, m, p), sheet, shape)
        return c.withColumn("identifier", identifier) if identifier is not None else c

    parts = [
        cells("SP_SalesTrend", "Sales Summary_Sales Trends", "monthly_trends"),
        cells("SP_TopPerformingEmployee", "Sales Summary_Top Performing Employee", "employee_performance"),
        cells("SP_TopProductsBySales", "Sales Summary_Sales by Product", "product_sales"),
        cells("SP_WeekdayWeekendSales", "Day Report", "weekday_weekend"),
        cells("SP_WeekdayWeekendSales", "Day Report", "weekday_weekend",
              F.concat(F.col("identifier"), F.lit(" ?"))),
    ]
    export = reshape.union_all(parts).select(
        "sheet", F.lit(0).cast("bigint").alias("row_ord"), "identifier", "metric",
        F.col("value").alias("value_raw"))
    return comparisons.compare_bundle(export, r, m, p).groupBy("sheet", "metric", "status").agg(
        F.count(F.lit(1)).alias("n"))


# --- keys -------------------------------------------------------------------------------------------------

_SIDES = """sides AS (SELECT coalesce(x.identifier, d.identifier) AS identifier,
  CASE WHEN x.identifier IS NULL THEN 'db_only' WHEN d.identifier IS NULL THEN 'export_only' ELSE 'common' END AS side
  FROM (SELECT * FROM staff_x WHERE v IS NOT NULL) x FULL JOIN staff_db d ON d.identifier = x.identifier)"""


def _sides(m):
    return reconcile.key_sides(_export(m, "staff"), cx.entity_db(m, P, "staff"))


model_check("key_sides", with_fact("SELECT identifier, side FROM sides", *STAFF, _SIDES))(
    lambda m: _sides(m).select("identifier", "side"))
model_check("key_side_counts", with_fact(
    """SELECT count(*) FILTER (WHERE side = 'common') AS common, count(*) FILTER (WHERE side = 'export_only') AS export_only,
  count(*) FILTER (WHERE side = 'db_only') AS db_only FROM sides""", *STAFF, _SIDES))(
    lambda m: reconcile.key_side_counts(_sides(m)))
model_check("key_side_sample", with_fact(
    "SELECT identifier FROM sides WHERE side = 'export_only' ORDER BY 1 LIMIT 3", *STAFF, _SIDES))(
    lambda m: reconcile.key_side_sample(_sides(m), "export_only").select("identifier"))
model_check("keys_common", with_fact("SELECT identifier FROM sides WHERE side = 'common'", *STAFF, _SIDES))(
    lambda m: reconcile.common_keys(_export(m, "staff"), cx.entity_db(m, P, "staff")).select("identifier"))
model_check("keys_missing", with_fact("SELECT identifier FROM sides WHERE side = 'export_only'", *STAFF, _SIDES))(
    lambda m: reconcile.keys_missing_from(
        _export(m, "staff"), cx.entity_db(m, P, "staff")).select("identifier"))
model_check("equal_preview", with_fact(
    """SELECT x.identifier, x.raw AS value_raw, CAST(d.amount AS VARCHAR) AS value, x.raw = CAST(d.amount AS VARCHAR) AS equal
FROM staff_x x JOIN staff_db d ON d.identifier = x.identifier WHERE x.v IS NOT NULL ORDER BY 1 LIMIT 3""", *STAFF))(
    lambda m: reconcile.equal_preview(
        _export(m, "staff"), cx.entity_db(m, P, "staff")).drop("sheet", "metric"))
model_check("first_keys", with_fact(
    f"""(SELECT CAST(0 AS BIGINT) AS ord, '{cx.STAFF_SHEET} - ' || identifier AS text FROM staff_db ORDER BY 2 LIMIT 10)
UNION ALL SELECT 1, '... and ' || (count(*) - 10) || ' more keys' FROM staff_db""", *STAFF))(
    lambda m: reconcile.first_keys(cx.entity_db(m, P, "staff")).withColumn("ord", F.col("ord").cast("bigint")))


@model_check("near_keys", with_fact(
    f"""SELECT identifier, near_key FROM (
  SELECT w.identifier, '{cx.STAFF_SHEET} - ' || d.identifier AS near_key,
    row_number() OVER (PARTITION BY w.identifier ORDER BY d.identifier) AS r
  FROM (SELECT DISTINCT replace(replace(identifier, ' X', ''), 'Customer#00000', '') AS identifier FROM staff_x WHERE identifier LIKE '% X') w
  JOIN staff_db d ON contains('{cx.STAFF_SHEET} - ' || d.identifier, w.identifier)) WHERE r <= 3""", *STAFF))
def _(m):
    """Unmatched names cut down to their number: the first keys that contain it."""
    missing = _export(m, "staff").filter(F.col("identifier").endswith(" X")).select(
        F.replace(F.replace("identifier", F.lit(" X"), F.lit("")), F.lit("Customer#00000"), F.lit("")).alias("identifier"))
    return reconcile.near_keys(missing, cx.entity_db(m, P, "staff")).select("identifier", "near_key")


@model_check("override_union", with_fact(
    f"""SELECT identifier, CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(amount AS VARCHAR) END AS value FROM staff_db""", *STAFF))
def _(m):
    """Two sources of the same keys; the later one wins where it has a value."""
    db = cx.entity_db(m, P, "staff")
    later = db.join(m.customers, F.col("identifier") == F.col("customer")).filter(
        "customer_key % 3 = 0").select("sheet", "identifier", "metric", F.lit("0").alias("value"))
    return reconcile.override_union([db, later]).select("identifier", "value")


model_check("side_counts", with_fact(
    "SELECT (SELECT count(*) FROM staff_x WHERE v IS NOT NULL) AS excel_count, (SELECT count(*) FROM staff_db) AS db_count", *STAFF))(
    lambda m: report.side_counts(_export(m, "staff"), cx.entity_db(m, P, "staff")))


@check("sheet_widget", """SELECT sheet, widget, count(*) AS n FROM (
  SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Sales Summary_Weekly Trends' WHEN 1 THEN 'SALES SUMMARY weekly trends'
    WHEN 2 THEN 'My Sales Summary_Top Brands by Sal (2)' ELSE 'Other' END AS sheet,
  CASE o_orderkey % 4 WHEN 0 THEN 'Sales Summary_Weekly Trends' WHEN 1 THEN 'Sales Summary_Weekly Trends'
    WHEN 2 THEN 'Sales Summary_Top Brands by Sal' END AS widget FROM orders) GROUP BY 1, 2""")
def _(spark, folder):
    """Sheet names to widget names: equal, contained, unknown."""
    names = F.array(F.lit("Sales Summary_Weekly Trends"), F.lit("SALES SUMMARY weekly trends"),
                    F.lit("My Sales Summary_Top Brands by Sal (2)"), F.lit("Other"))
    rows = read_table(spark, folder, "orders").select(
        F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("sheet"))
    return rows.groupBy(
        "sheet", reconcile.sheet_widget(F.col("sheet"), list(fv.LANDING_SHEETS)).alias("widget")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- cells of query results -----------------------------------------------------------------------------------

@model_check("cells_of_every_shape", with_fact(cx.sheet_cells_sql({n: n for n in fv.CATALOGUE})))
def _(m):
    """Each catalogue query in keyed form, by the shape of its columns."""
    r, pinned = default_registry(), m.pinned(P)
    parts = []
    for name in fv.CATALOGUE:
        result = r.call(name, pinned, P)
        parts.append(reshape.format_result(result, name, reshape_shape(result)))
    return reshape.union_all(parts)


model_check("cells_of_landing_sheets", with_fact(cx.sheet_cells_sql(fv.LANDING_SHEETS)))(
    lambda m: comparisons.landing_values(default_registry(), m.pinned(P), P))


@model_check("cells_generic", with_fact(
    f"""SELECT 'Plain' AS sheet, store AS identifier, 'Actual Sales' AS metric, CAST(count(DISTINCT bill) AS VARCHAR) AS value
FROM fact WHERE y = {YEAR} GROUP BY store"""))
def _(m):
    """A result of unknown columns: the first is the identifier, the second the value."""
    bills = m.line_sales(P).groupBy("store_key").agg(F.count_distinct("order_key").alias("n"))
    return reshape.format_result(
        bills.join(m.stores, "store_key").select("store", "n"), "Plain", "generic")


@model_check("cells_day_type_columns", with_fact(_by_where("true")))
def _(m):
    """The day type under its other column name and without suffix."""
    result = widgets.weekday_weekend(m, P).select(
        F.replace("WeekCategory", F.lit(" SALES"), F.lit("")).alias("DayType"),
        "CurrentYearSales", "PreviousYearSales")
    return reshape.format_result(result, "Days", "weekday_weekend").drop("sheet")


_DRILL_TABLE = {"Sales Summary_Sales Trends": "SP_SalesTrend",
                "Sales Summary_Top Performing Employee": "SP_TopPerformingEmployee",
                "Sales Summary_Sales by Product": "SP_TopProductsBySales",
                "Sales Summary_Top Brands by Sales": "SP_TopBrandsBySales",
                "Sales Summary_Weekday Weekend": "SP_WeekdayWeekendSales",
                "Weekly Trends": "SP_WeekdayWeekendSales",
                "Sales Summary_Weekwise Sales": "SP_WeekwiseSalesComparison",
                "Generic_SP_TopStoresbySales": "SP_TopStoresbySales"}


@model_check("cells_of_drill_through", with_fact(cx.sheet_cells_sql(_DRILL_TABLE)))
def _(m):
    """Drill-through queries under their fixed sheets, weekday rows under two of them."""
    r, pinned = default_registry(), m.pinned(P)
    names = fv.DRILL_PROBE + ["SP_TopStoresbySales"]
    return reshape.union_all([reshape.drill_cells(r.call(n, pinned, P), n) for n in names])


@model_check("columns_by_role", with_fact(
    f"""SELECT store AS identifier, {cents(f'sum(s) FILTER (WHERE y = {YEAR})')} AS value,
  {cents(f'sum(s) FILTER (WHERE y = {YEAR - 1}) * CAST(1.10 AS DECIMAL(3,2))')} AS target FROM fact WHERE {BOTH} GROUP BY 1"""))
def _(m):
    """Recognised columns under the names of their roles."""
    named = reshape.rename_by_role(widgets.store_targets(m, P))
    return named.select(*[F.col(c).cast("string").alias(c) for c in named.columns])


@model_check("values_out_of_range", with_fact(
    """SELECT identifier, CAST(v AS DOUBLE) AS amount FROM staff_x WHERE v > 900000""", *STAFF))
def _(m):
    return report.violations(_export(m, "staff"), high="900000").select("identifier", "amount")


model_check("rows_per_sheet", with_fact(
    f"SELECT sheet, count(*) AS n FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)}) GROUP BY 1"))(
    lambda m: report.sheet_rows(comparisons.landing_values(default_registry(), m.pinned(P), P)))


# --- whole comparisons -------------------------------------------------------------------------------------------

def _marked_export(m, table, shapes=None):
    """Cells of the landing queries as export; identifiers that end with 7 are one too high."""
    db = comparisons.landing_values(default_registry(), m, P, table)
    value = F.when(F.col("identifier").endswith("7"), (F.col("value").cast(MONEY) + 1).cast(MONEY).cast("string"))
    return db.select(
        "sheet", F.lit(0).cast("bigint").alias("row_ord"), "identifier", "metric",
        F.coalesce(value, F.col("value")).alias("value_raw"))


_MARKED = f"""SELECT sheet, count(*) AS total, count(*) FILTER (WHERE identifier NOT LIKE '%7') AS matches,
  count(*) FILTER (WHERE identifier LIKE '%7') AS mismatches, CAST(0 AS BIGINT) AS not_found,
  printf('%.1f%%', count(*) FILTER (WHERE identifier NOT LIKE '%7') * 100.0 / count(*)) AS success_rate
FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)}) GROUP BY 1"""


@model_check("landing_fixed", with_fact(_MARKED))
def _(m):
    """All landing sheets against their fixed queries."""
    pinned = m.pinned(P)
    export = _marked_export(pinned, fv.LANDING_SHEETS)
    return report.sheet_summary(comparisons.compare_landing(export, default_registry(), m, P))


@model_check("landing_checked", with_fact(
    f"""SELECT 'common' AS what, count(*) AS n FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)})
UNION ALL SELECT 'numeric', count(*) FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)})
UNION ALL SELECT 'Match', count(*) FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)}) WHERE identifier NOT LIKE '%7'
UNION ALL SELECT 'Mismatch', count(*) FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)}) WHERE identifier LIKE '%7'"""))
def _(m):
    """Landing comparison with key sets, value kinds and normalised database values."""
    pinned = m.pinned(P)
    found = comparisons.check_landing(_marked_export(pinned, fv.LANDING_SHEETS), default_registry(), m, P)
    sides = found.sides.select(F.lit("common").alias("what"), F.col("common").alias("n"))
    kinds = found.kinds.select(F.col("kind").alias("what"), "n")
    status = found.report.groupBy(F.col("status").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return sides.unionByName(kinds).unionByName(status)


# --- written reports ------------------------------------------------------------------------------------------------

@check("report_long_written", with_fact(
    f"""SELECT substr(sheet, 1, 31) AS title, identifier AS "Identifier/Label", metric AS "Metric",
  excel_value AS "Excel Value", db_value AS "DB Value", status AS "Status" FROM ({cx.long_sql('staff')})""", *STAFF))
def _(spark, folder):
    """Long report in folders by sheet, as CSV, read back."""
    path = scratch(spark, "long-report")
    sinks.write_long_report(_long(bind_folder(spark, folder), "staff"), path, "csv")
    return sinks.read_report(spark, path, "csv").select(
        "title", "Identifier/Label", "Metric", "Excel Value", "DB Value", "Status")


@check("report_wide_written", with_fact(
    f"""SELECT 'standard' AS layout, x.identifier, {_wide_status('x.v', 'd.amount')} AS "Actual Sales Status"
FROM staff_x x LEFT JOIN staff_db d ON d.identifier = x.identifier""", *STAFF))
def _(spark, folder):
    m, path = bind_folder(spark, folder), scratch(spark, "wide-report")
    wide = reconcile.reconcile_wide(
        cx.entity_export(m, P, "staff").withColumnRenamed("Identifier", "identifier"),
        cx.entity_db(m, P, "staff"), ["Actual Sales"])
    sinks.write_wide_report({"standard": wide}, path)
    return sinks.read_report(spark, path).select("layout", "identifier", "Actual Sales Status")


@check("report_kpis_written", with_fact(
    """SELECT 'Total KPIs' AS "Metric", CAST(count(*) AS VARCHAR) AS "Count" FROM report
UNION ALL SELECT 'Matches', CAST(count(*) FILTER (WHERE status = 'Match') AS VARCHAR) FROM report
UNION ALL SELECT 'Mismatches', CAST(count(*) FILTER (WHERE status = 'Mismatch') AS VARCHAR) FROM report
UNION ALL SELECT 'No SP Mapping', CAST(count(*) FILTER (WHERE status = 'No SP Mapping') AS VARCHAR) FROM report
UNION ALL SELECT 'SP Errors', CAST(count(*) FILTER (WHERE status IN ('SP Missing', 'DB Error')) AS VARCHAR) FROM report
UNION ALL SELECT 'Success Rate', printf('%.1f%%', count(*) FILTER (WHERE status = 'Match') * 100.0 / count(*)) FROM report""", _KPI_SQL))
def _(spark, folder):
    """KPI report and summary written, the summary read back."""
    m, path = bind_folder(spark, folder), scratch(spark, "kpi-report")
    rows, _ = comparisons.compare_kpis(_kpi_export(m), _kpi_registry(), m, P)
    sinks.write_kpi_report(rows, path)
    return sinks.read_report(spark, f"{path}/summary").select("Metric", "Count")


@check("kpi_snapshot_written", with_fact(
    f"SELECT kpi_name, CAST(CAST(value AS DECIMAL(28,2)) AS VARCHAR) AS value_raw FROM ({kpi_rows()})"))
def _(spark, folder):
    path = scratch(spark, "kpi-snapshot")
    sinks.write_kpi_snapshot(kpis.kpi_set(bind_folder(spark, folder), P), path)
    return spark.read.parquet(path)


