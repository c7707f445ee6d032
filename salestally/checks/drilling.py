"""Drill-through requests, parameters, and logs, over names from the tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.checks import cells as cx
from salestally.checks.base import P, YEAR, check, model_check, with_fact
from salestally.model import read_table
from salestally.operators import drill, report, widgets
from salestally.params import validated
from salestally.plans import comparisons, sinks
from salestally.session import scratch
from salestally.sources.exports import config_table
from salestally.sources.registry import default_registry

_TITLES = list(fv.DRILL_TARGETS) + ["Sales by Region"]


def _requests(spark, folder):
    """One request per order: a widget title by the order's key, a target by its customer."""
    titles = F.array(*[F.lit(t) for t in _TITLES])
    return read_table(spark, folder, "orders").select(
        "o_orderkey", F.get(titles, (F.col("o_orderkey") % len(_TITLES)).cast("int")).alias("title"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("Love Library"))
        .when(F.col("o_custkey") % 3 == 1, F.col("o_custkey").cast("string"))
        .otherwise(F.lit("Elsewhere")).alias("target"))


_REQUESTS = f"""requests AS (SELECT o_orderkey, ({_TITLES!r})[o_orderkey % {len(_TITLES)} + 1] AS title,
  CASE o_custkey % 3 WHEN 0 THEN 'Love Library' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE 'Elsewhere' END AS target FROM orders)"""


def _case(column: str, table: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


_DEFAULTS = {t: q for t, s, q in fv.DRILL_QUERIES if s is None}


@check("drill_requests", f"""WITH {_REQUESTS}
SELECT title, target, {_case('title', fv.DRILL_TARGETS, "split_part(title, ' ', -1)")} AS default_target,
  {_case('title', _DEFAULTS, "'DR_' || replace(title, ' ', '')")} AS query,
  CASE WHEN target = 'Love Library' THEN 'store' ELSE 'none' END AS kind, target <> 'Love Library' AS warning, count(*) AS n
FROM requests GROUP BY 1, 2, 3, 4, 5, 6""")
def _(spark, folder):
    """Default target, query, filter kind and scope warning of each request."""
    return _requests(spark, folder).groupBy(
        "title", "target", drill.drill_target("title").alias("default_target"),
        drill.query_name(F.col("title"), F.col("target")).alias("query"),
        drill.filter_kind("target").alias("kind"), drill.scope_warning("target").alias("warning"),
    ).agg(F.count(F.lit(1)).alias("n"))


@check("drill_params", f"""WITH {_REQUESTS}
SELECT o_orderkey, CASE WHEN target = 'Love Library' THEN CAST(2024 AS BIGINT) ELSE {YEAR} END AS year,
  CASE WHEN target = 'Love Library' THEN '717' WHEN target <> 'Elsewhere' THEN target END AS store,
  CASE WHEN target = 'Love Library' THEN '717' END AS extra_store FROM requests""")
def _(spark, folder):
    """Parameters per request: a preset, a store's id, or the defaults."""
    presets = spark.createDataFrame(
        [(t, v.get("year"), None, v.get("store"), None, None, None, None) for t, v in fv.DRILL_PARAMS.items()],
        "target string, year int, month int, store string, state string, channel string, fromdate date, todate date")
    stores = config_table(spark, fv.STORE_IDS, "name", "id")
    out = drill.with_params(_requests(spark, folder), "target", presets, stores, P)
    return drill.extra_store(out, "target", stores).select(
        "o_orderkey", F.col("year").cast("bigint").alias("year"), "store", "extra_store")


@check("store_ids", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) END AS store_id
FROM orders LEFT JOIN supplier ON s_name = 'Supplier#' || lpad(CAST(o_orderkey % 50 AS VARCHAR), 9, '0')""")
def _(spark, folder):
    """Store names from the store table become ids, digits stay, other names have none."""
    k = F.col("o_orderkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 50).cast("string"), 9, "0"))).when(
        k % 3 == 1, k.cast("string")).otherwise(F.lit("no store"))
    requests = read_table(spark, folder, "orders").select("o_orderkey", asked.alias("target"))
    stores = read_table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("id"))
    return drill.with_store_id(requests, "target", stores).select("o_orderkey", "store_id")


@check("title_queries", f"""SELECT title, query, count(*) AS n FROM (SELECT o_orderkey % 8 AS k FROM orders) JOIN (VALUES
  (0, 'Top Stores by Sales', 'SP_TopStoresbySales'), (1, 'Top Brands by Sales', 'SP_TopBrandsBySales'),
  (2, 'Top Categories by Sales', 'SP_TopCategoriesBySaleswidget'), (3, 'Top Sub Categories by Sales', 'SP_TopCategoriesBySaleswidget'),
  (4, 'Top Products by Sales', 'SP_TopProductsBySaleswidget'), (5, 'Weekly View', 'SP_WeeklyTrendswidget'),
  (6, 'Store Target', 'SP_StorewiseActualVsTarget_Vertical_SortedByActual'), (7, 'Other', 'SP_TopStoresbySales')) v(k, title, query) USING (k)
GROUP BY 1, 2""")
def _(spark, folder):
    titles = F.array(*[F.lit(t) for t in (
        "Top Stores by Sales", "Top Brands by Sales", "Top Categories by Sales", "Top Sub Categories by Sales",
        "Top Products by Sales", "Weekly View", "Store Target", "Other")])
    rows = read_table(spark, folder, "orders").select(
        F.get(titles, (F.col("o_orderkey") % 8).cast("int")).alias("title"))
    return rows.groupBy("title", drill.title_query("title").alias("query")).agg(F.count(F.lit(1)).alias("n"))


@check("distinct_titles", """SELECT p_name AS title, min(p_partkey) AS ord FROM part WHERE p_name NOT LIKE 'red%' GROUP BY 1""")
def _(spark, folder):
    """Part names as titles, those that begin with red blanked."""
    rows = read_table(spark, folder, "part").select(
        F.when(F.col("p_name").startswith("red"), F.lit(" ")).otherwise(F.col("p_name")).alias("title"),
        F.col("p_partkey").alias("ord"))
    return drill.distinct_titles(rows)


@check("params_validated", """SELECT valid, count(*) AS n FROM (SELECT
  (k % 4 = 0 OR y BETWEEN 1996 AND 1999) AND (k % 5 = 0 OR m + (k % 2) BETWEEN 1 AND 12) AND (k % 6 = 0 OR length(c) <= 10) AS valid
  FROM (SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority AS c FROM orders)) GROUP BY 1""")
def _(spark, folder):
    """Parameters taken from orders, some of them null, checked against bounds."""
    k = F.col("o_orderkey")
    rows = read_table(spark, folder, "orders").select(
        F.when(k % 4 != 0, F.year("o_orderdate")).alias("year"),
        F.when(k % 5 != 0, F.month("o_orderdate") + (k % 2).cast("int")).alias("month"),
        F.when(k % 6 != 0, F.col("o_orderpriority")).alias("store"))
    return validated(rows, year_range=(1996, 1999)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


_TOP = """SELECT brand AS "BrandName", CAST(CAST(sum(s) AS DECIMAL(28,2)) AS DOUBLE) AS "Sales" FROM fact WHERE {} GROUP BY 1"""

model_check("params_fresh", with_fact(_TOP.format("year(d) = 1998 AND month(d) = 5")))(
    lambda m: widgets.top_brands(m, P.fresh(date(1998, 5, 20))))
model_check("params_override", with_fact(_TOP.format(f"y = {YEAR} AND store_key = 17")))(
    lambda m: widgets.top_brands(m, P.override(store="17", month=None)))


@model_check("sheets_by_priority", with_fact(
    f"""SELECT sheet, count(*) AS n, CAST(CASE sheet WHEN 'Sales Summary_Weekly Trends' THEN 1
  WHEN 'Sales Summary_Top Products by S' THEN 2 WHEN 'Sales Summary_Top Brands by Sal' THEN 3
  WHEN 'Sales Summary_Top Categories by' THEN 4 WHEN 'Sales Summary_Top Sub Categorie' THEN 5
  WHEN 'Sales Summary_Top Stores by Sal' THEN 6 WHEN 'Sales Summary_Store Sales with' THEN 7 END AS BIGINT) AS priority
FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)}) GROUP BY 1"""))
def _(m):
    cells = comparisons.landing_values(default_registry(), m.pinned(P), P)
    return drill.by_priority(report.sheet_rows(cells), "landing_page").withColumn(
        "priority", F.col("priority").cast("bigint"))


# --- drill-through comparisons -------------------------------------------------------------

@model_check("drill_through_brand", with_fact(
    f"""SELECT 'legacy' AS method, status, count(*) AS n FROM (
SELECT 'Match' AS status FROM ({cx.query_cells_sql('SP_SalesTrend', "brand = 'Brand#7'")})
UNION ALL SELECT 'Match' FROM ({cx.query_cells_sql('SP_TopProductsBySales', "brand = 'Brand#7'")})) GROUP BY 2"""))
def _(m):
    """One brand pinned: no sheet profile given, so the four-query bundle answers."""
    p, r = replace(P, brand="Brand#7"), default_registry()
    db = comparisons.bundle_cells(r, m, p, ["SP_SalesTrend", "SP_TopProductsBySales"])
    export = db.select("sheet", F.lit(0).cast("bigint").alias("row_ord"), "identifier", "metric",
                       F.col("value").alias("value_raw"))
    shapes = m.stores.limit(0).select(
        F.col("store").alias("sheet"), F.array(F.lit("x")).alias("headers"), F.lit(0).alias("data_volume"))
    method, rows = comparisons.compare_drill_through(
        export, {}, shapes, "Top Brands by Sales", "Brand#7", r, m, p)
    return rows.groupBy(F.lit(method).alias("method"), "status").agg(F.count(F.lit(1)).alias("n"))


# --- issues and runs, from the event table -------------------------------------------------------

def _issues(spark, folder):
    level = F.when(F.col("value") > 50, "error").otherwise("warning")
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), level.alias("level"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("component"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("widget_name"),
        F.lit("Value").alias("type"), F.col("props").alias("message"), F.lit(None).cast("string").alias("path"))


_LEVEL = "CASE WHEN value > 50 THEN 'error' ELSE 'warning' END"

check("issue_totals", f"SELECT {_LEVEL} AS level, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, folder: report.issue_totals(_issues(spark, folder)))
check("issues_by_component", f"SELECT {_LEVEL} AS level, event_type AS component, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda spark, folder: report.issues_by_component(_issues(spark, folder)))
check("last_issues", f"""SELECT event_id AS seq, event_type AS component, props AS message FROM events
WHERE {_LEVEL} = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5""")(
    lambda spark, folder: report.last_issues(_issues(spark, folder), "error").select("seq", "component", "message"))


@check("issue_log_appended", f"""SELECT level, count(*) * 2 AS n FROM (SELECT {_LEVEL} AS level FROM events) GROUP BY 1
UNION ALL SELECT 'note', CAST(1 AS BIGINT)""")
def _(spark, folder):
    """Records appended twice by a job and once by the driver."""
    path, issues = scratch(spark, "issues"), _issues(spark, folder)
    sinks.append_issue_rows(issues, path)
    sinks.append_issue_rows(issues, path)
    sinks.append_issues(spark, path, [(0, "note", None, "run", "", "Start", "", None)])
    return report.issue_totals(spark.read.parquet(path))


@check("issue_report_written", f"""SELECT 'component' AS part, {_LEVEL} AS level, event_type AS component, count(*) AS n FROM events GROUP BY 2, 3
UNION ALL SELECT 'total', {_LEVEL}, NULL, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'printed', 'error', max(strftime(ts, '%Y-%m-%d %H:%M:%S')), count(*) FROM events WHERE {_LEVEL} = 'error'""")
def _(spark, folder):
    """Error report: the counts and the printed errors, read back."""
    path = scratch(spark, "issue-report")
    sinks.write_issue_report(_issues(spark, folder), path)
    printed = spark.read.parquet(f"{path}/errors").agg(
        F.lit("printed").alias("part"), F.lit("error").alias("level"),
        F.max("Timestamp").alias("component"), F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{path}/summary").unionByName(printed)


@check("run_counts", """SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, count(*) AS n
FROM orders GROUP BY 1""")
def _(spark, folder):
    """Outcomes of runs, one run per order."""
    status = F.col("o_orderstatus")
    runs = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("task_id"),
        F.when(status == "F", "completed").when(status == "O", "queued").otherwise("failed").alias("status"))
    return report.run_counts(runs)


