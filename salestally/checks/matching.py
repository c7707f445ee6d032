"""Profiles of sheets and the queries they are matched with."""

from __future__ import annotations

from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.checks import cells as cx
from salestally.checks.base import P, check, model_check, with_fact
from salestally.model import read_table
from salestally.operators import match, reshape, widgets
from salestally.plans import comparisons
from salestally.session import cut
from salestally.sources.exports import sample_rows, shapes_of
from salestally.sources.registry import default_registry

# sheet -> (query whose result fills it, headers)
ENTITY = ["Identifier", "Actual Sales"]
YEARS = ["Identifier", "Previous Year", "Current Year"]
SHEETS = {
    "Sales Summary_Top Stores by Sal": ("SP_TopStoresbySales", ENTITY),
    "Sales Summary_Top Brands by Sal": ("SP_TopBrandsBySales", ENTITY),
    "Sales Summary_Top Categories by": ("SP_TopCategoriesBySaleswidget", ENTITY),
    "Sales Summary_Top Sub Categorie": ("SP_TopSubCategoriesBySales", ENTITY),
    "Sales Summary_Top Products by S": ("SP_TopProductsBySales", ENTITY),
    "Sales Summary_Weekly Trends": ("SP_WeeklyTrendswidget", YEARS),
    "Sales Summary_Store Sales with": (
        "SP_StorewiseActualVsTarget_Vertical_SortedByActual", ENTITY + ["Targets"]),
    "Sales Summary_Sales Trends": ("SP_SalesTrend", YEARS),
    "Sales Summary_Sales by Product": ("SP_TopProductsBySales", ENTITY),
    "Sales Summary_Top Performing Em": ("SP_TopPerformingEmployee", ["Identifier", "Sales"]),
    "Sales Summary_Weekwise Sales": ("SP_WeekwiseSalesComparison", YEARS),
    "Sales Summary_Weekday Weekend": (
        "SP_WeekdayWeekendSales", ["Identifier/Label", "Metric", "Excel Value"]),
}
# sheet -> query, confidence, queries with that score
EXPECTED = {
    "Sales Summary_Top Stores by Sal": ("SP_TopStoresbySales", 1.0, 1),
    "Sales Summary_Top Brands by Sal": ("SP_TopBrandsBySales", 1.0, 1),
    "Sales Summary_Top Categories by": ("SP_TopCategoriesBySaleswidget", 1.0, 1),
    "Sales Summary_Top Sub Categorie": ("SP_TopSubCategoriesBySales", 0.9, 1),
    "Sales Summary_Top Products by S": ("SP_TopProductsBySales", 1.0, 1),
    "Sales Summary_Weekly Trends": ("SP_WeeklyTrendswidget", 1.0, 1),
    "Sales Summary_Store Sales with": ("SP_StorewiseActualVsTarget_Vertical_SortedByActual", 1.0, 1),
    "Sales Summary_Sales Trends": ("SP_SalesTrend", 1.0, 1),
    "Sales Summary_Sales by Product": ("SP_TopProductsBySales", 1.0, 1),
    "Sales Summary_Top Performing Em": ("SP_SalesTrend", 0.6, 9),
    "Sales Summary_Weekwise Sales": ("SP_SalesTrend", 0.6, 4),
}


def sheet_rows(m, sheet: str):
    """The sheet's rows in its own columns, filled from its query."""
    query, headers = SHEETS[sheet]
    base = [F.lit(sheet).alias("sheet"), F.lit(0).cast("bigint").alias("row_ord")]
    if "Targets" in headers:
        result = widgets.store_targets(m, P).withColumnRenamed("Target", "Targets")
    else:
        result = default_registry().call(query, m, P, ordered=False)
    if headers[0] == "Identifier/Label":
        cells = reshape.format_result(result, sheet, "weekday_weekend")
        return cells.select(*base, F.col("identifier").alias("Identifier/Label"),
                            F.col("metric").alias("Metric"), F.col("value").alias("Excel Value"))
    label, *values = result.columns
    named = {"Current Year": "CurrentYearSales", "Previous Year": "PreviousYearSales"}
    return result.select(*base, F.col(label).alias("Identifier"), *[
        F.col(f"`{named.get(h, h if h in values else values[0])}`").cast("string").alias(h)
        for h in headers[1:]])


def all_shapes(m, names=None):
    return reshape.union_all([
        shapes_of(sheet_rows(m, s), SHEETS[s][1]) for s in (names or SHEETS)])


def rows_sql(sheet: str) -> str:
    query, headers = SHEETS[sheet]
    distinct = "" if headers[0] == "Identifier/Label" else "DISTINCT "
    what = "identifier, metric" if headers[0] == "Identifier/Label" else "identifier"
    return f"SELECT {distinct}{what} FROM ({cx.query_cells_sql(query)})"


_VOLUMES = "\nUNION ALL ".join(
    f"SELECT '{s}' AS sheet, '{', '.join(SHEETS[s][1]).lower()}' AS headers, count(*) AS data_volume, "
    f"CAST({len(SHEETS[s][1])} AS BIGINT) AS n_columns FROM ({rows_sql(s)})" for s in SHEETS)


@model_check("sheet_shapes", with_fact(_VOLUMES))
def _(m):
    """Rows, columns and headers of every sheet."""
    return all_shapes(m.pinned(P)).select(
        "sheet", F.array_join("headers", ", ").alias("headers"), "data_volume",
        F.col("n_columns").cast("bigint").alias("n_columns"))


_TAGS = {
    tuple(ENTITY): ("sales_data", "actual_sales=1 identifier=0"),
    tuple(YEARS): ("year_comparison", "current_year=2 identifier=0 previous_year=1"),
    tuple(ENTITY + ["Targets"]): ("sales_data target_data", "actual_sales=1 identifier=0 target=2"),
    ("Identifier", "Sales"): ("sales_data", "identifier=0 sales=1"),
    ("Identifier/Label", "Metric", "Excel Value"): ("generic_data", "excel_value=2 identifier=0 metric=1"),
}


def _suggested(sheet: str, headers: list[str]) -> str:
    import re

    text = f"{sheet} {' '.join(headers)}".lower()
    found = [q for pattern, q in fv.NAME_PATTERNS if re.search(pattern, text)]
    return " ".join(found)


_PROFILES = "\nUNION ALL ".join(
    f"""SELECT '{s}' AS sheet, '{''.join(c for c in s.lower() if c.isalnum())}' AS normalized_name,
  '{_TAGS[tuple(SHEETS[s][1])][0]}' AS tags, '{_TAGS[tuple(SHEETS[s][1])][1]}' AS keys,
  '{_suggested(s, SHEETS[s][1])}' AS suggested, count(*) AS data_volume FROM ({rows_sql(s)})""" for s in SHEETS)


@model_check("sheet_profiles", with_fact(_PROFILES))
def _(m):
    """Tags, key columns and suggested queries of every sheet."""
    profiles = match.sheet_profiles(all_shapes(m.pinned(P)))
    keys = F.concat_ws(" ", *[
        F.concat(F.lit(f"{role}="), F.col(f"key_columns.{role}").cast("string"))
        for role in sorted(match.KEY_ROLES)])
    return profiles.select(
        "sheet", "normalized_name", F.array_join("data_patterns", " ").alias("tags"), keys.alias("keys"),
        F.array_join(F.transform("suggested_sps", lambda s: s["sp_name"]), " ").alias("suggested"),
        "data_volume")


_MATCHES = "\nUNION ALL ".join(
    f"SELECT '{s}' AS sheet, '{q}' AS sp_name, CAST({c} AS DOUBLE) AS confidence, CAST({n} AS BIGINT) AS ties, "
    f"(SELECT count(*) FROM ({cx.query_cells_sql(q)})) AS db_cells" for s, (q, c, n) in EXPECTED.items())


@model_check("match_sheets", with_fact(_MATCHES))
def _(m):
    """Every sheet with its best query, the score, ties, and the query's cells."""
    pinned = m.pinned(P)
    shapes = cut(all_shapes(pinned), "sheet-shapes")
    mapping = comparisons.map_sheets(shapes, default_registry(), pinned, P)
    counts = comparisons.mapped_cells(mapping).groupBy("sheet").agg(F.count(F.lit(1)).alias("db_cells"))
    return mapping.table.select(
        "sheet", "sp_name", "confidence", F.col("ties").cast("bigint").alias("ties")
    ).join(counts, "sheet")


_MORE_RULES = fv.DIRECT_NAMES + [
    ("performing em", "SP_TopPerformingEmployee"), ("weekwise", "SP_WeekwiseSalesComparison"),
    ("weekday", "SP_WeekdayWeekendSales")]


@model_check("match_with_more_rules", with_fact("\nUNION ALL ".join(
    f"SELECT '{s}' AS sheet, '{q}' AS sp_name, (SELECT count(*) FROM ({cx.query_cells_sql(q)})) AS db_cells"
    for s, q in [("Sales Summary_Top Performing Em", "SP_TopPerformingEmployee"),
                 ("Sales Summary_Weekwise Sales", "SP_WeekwiseSalesComparison"),
                 ("Sales Summary_Weekday Weekend", "SP_WeekdayWeekendSales")])))
def _(m):
    """Three sheets the fixed rules miss, found with name rules of one's own."""
    pinned = m.pinned(P)
    wanted = ["Sales Summary_Top Performing Em", "Sales Summary_Weekwise Sales", "Sales Summary_Weekday Weekend"]
    shapes = cut(all_shapes(pinned, wanted), "sheet-shapes")
    mapping = comparisons.map_sheets(shapes, default_registry(), pinned, P, rules=_MORE_RULES)
    counts = comparisons.mapped_cells(mapping).groupBy("sheet").agg(F.count(F.lit(1)).alias("db_cells"))
    return mapping.table.select("sheet", "sp_name").join(counts, "sheet")


def _compared_sql() -> str:
    parts = []
    for sheet in ("Sales Summary_Top Stores by Sal", "Sales Summary_Top Brands by Sal",
                  "Sales Summary_Top Categories by", "Sales Summary_Top Sub Categorie",
                  "Sales Summary_Top Products by S", "Sales Summary_Weekly Trends",
                  "Sales Summary_Store Sales with"):
        query, _ = SHEETS[sheet]
        parts.append(f"SELECT '{sheet}' AS sheet, metric, 'Match' AS status, count(*) AS n "
                     f"FROM ({cx.query_cells_sql(query)}) GROUP BY metric")
    return "\nUNION ALL ".join(parts)


@model_check("landing_by_profile", with_fact(_compared_sql()))
def _(m):
    """The seven landing sheets matched by profile and compared in their own layout."""
    pinned = m.pinned(P)
    wanted = list(fv.LANDING_SHEETS)
    shapes = cut(all_shapes(pinned, wanted), "sheet-shapes")
    groups = {}
    for sheet in wanted:
        layout = reshape.layout_of(SHEETS[sheet][1])
        groups.setdefault(comparisons.WIDE_OF[layout], []).append(
            reshape.sheet_wide(sheet_rows(pinned, sheet), layout))
    wide = {kind: reshape.union_all(parts) for kind, parts in groups.items()}
    reports = comparisons.compare_mapped(wide, shapes, default_registry(), m, P)
    parts = []
    for kind, out in reports.items():
        metrics = comparisons.WIDE_LAYOUTS[kind]
        named = out.select("sheet", *[F.col(f"`{x} Status`").alias(x) for x in metrics])
        parts.append(named.unpivot(["sheet"], metrics, "metric", "status"))
    return reshape.union_all(parts).groupBy("sheet", "metric", "status").agg(F.count(F.lit(1)).alias("n"))


_CUBE_QUERIES = ["SP_SalesTrend", "SP_TopPerformingEmployee", "SP_TopProductsBySales", "SP_WeekdayWeekendSales", "SP_WeekwiseSalesComparison",
                 "SP_TopStoresbySales", "SP_TopBrandsBySales", "SP_TopCategoriesBySaleswidget", "SP_TopSubCategoriesBySales",
                 "SP_WeeklyTrendswidget", "SP_StorewiseActualVsTarget_Vertical_SortedByActual", "SP_TopProductsBySaleswidget"]


@model_check("catalogue_cube", with_fact(cx.sheet_cells_sql({q: q for q in _CUBE_QUERIES})))
def _(m):
    """Twelve queries of the catalogue, all from one table of sums."""
    cubed, r = m.cubed(P), default_registry()
    results = {q: r.call(q, cubed, P, ordered=False) for q in _CUBE_QUERIES}
    cells = [reshape.format_result(df, q, match.output_shape_of(df.columns)) for q, df in results.items()]
    return reshape.union_all(cells).select("sheet", "identifier", "metric", "value")


@model_check("catalogue_cube_of_a_state", with_fact(cx.sheet_cells_sql({q: q for q in _CUBE_QUERIES[:6]}, "state = 'NATION_3' AND channel = '1-URGENT'")))
def _(m):
    """The same with the parameters' filters in the sums."""
    p = P.override(state="NATION_3", channel="1-URGENT")
    cubed, r = m.cubed(p), default_registry()
    results = {q: r.call(q, cubed, p, ordered=False) for q in _CUBE_QUERIES[:6]}
    cells = [reshape.format_result(df, q, match.output_shape_of(df.columns)) for q, df in results.items()]
    return reshape.union_all(cells).select("sheet", "identifier", "metric", "value")


# copies of the seven landing sheets and a sheet whose metrics are data, under names of their own
_COPIES = 60
_METRIC_SHEET = "Sales Summary_Sales Trends by Metric"


@model_check("landing_of_many_sheets", with_fact(f"""SELECT sheet, status, count(*) AS n FROM (
  SELECT c.sheet || ' ' || k AS sheet, status FROM (
    SELECT sheet, 'Match' AS status FROM ({cx.sheet_cells_sql(fv.LANDING_SHEETS)})) c, range({_COPIES}) t(k)
  UNION ALL SELECT '{_METRIC_SHEET}', 'Match' FROM ({cx.query_cells_sql('SP_SalesTrend')})) GROUP BY 1, 2"""))
def _(m):
    """Hundreds of sheets matched by profile: a query's result is compared once for all that it answers."""
    pinned = m.pinned(P)
    wanted = list(fv.LANDING_SHEETS)
    copy = F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1)))
    named = lambda df: df.withColumn("k", copy).withColumn("sheet", F.concat_ws(" ", "sheet", "k")).drop("k")
    shapes = named(all_shapes(pinned, wanted))
    trend = reshape.format_result(default_registry().call("SP_SalesTrend", pinned, P), _METRIC_SHEET, "monthly_trends")
    long = trend.select("sheet", F.lit(0).cast("bigint").alias("row_ord"), "identifier", "metric", F.col("value").alias("value_raw"))
    more = long.groupBy("sheet").agg(F.count(F.lit(1)).alias("data_volume")).select(
        "sheet", F.array(*[F.lit(h) for h in ("identifier/label", "metric", "excel value", "month", "current year")]).alias("headers"),
        "data_volume", F.lit(5).alias("n_columns"))
    groups = {}
    for sheet in wanted:
        layout = reshape.layout_of(SHEETS[sheet][1])
        groups.setdefault(comparisons.WIDE_OF[layout], []).append(named(reshape.sheet_wide(sheet_rows(pinned, sheet), layout)))
    wide = {kind: reshape.union_all(parts) for kind, parts in groups.items()}
    method, reports = comparisons.compare_landing_any(
        long, wide, cut(shapes.unionByName(more), "sheet-shapes"), default_registry(), m, P, long)
    parts = [reports["metric"].select("sheet", "status")]
    for kind in groups:
        metrics = comparisons.WIDE_LAYOUTS[kind]
        statuses = reports[kind].select("sheet", *[F.col(f"`{x} Status`").alias(x) for x in metrics])
        parts.append(statuses.unpivot(["sheet"], metrics, "metric", "status").select("sheet", "status"))
    return reshape.union_all(parts).groupBy("sheet", "status").agg(F.count(F.lit(1)).alias("n"))


@model_check("sheet_samples", with_fact(
    f"""SELECT sheet, row_ord, lower('Identifier') || '=' || identifier || ' actual sales=' || raw AS sample FROM (
  SELECT *, row_number() OVER (ORDER BY row_ord) AS r FROM (
    SELECT sheet, k AS row_ord, identifier, CAST(amount AS VARCHAR) AS raw FROM staff_db)) WHERE r <= 3""",
    *cx.entity_sql("staff")))
def _(m):
    """The first rows of each sheet, as maps from header to text."""
    rows = cx.entity_db(m, P, "staff").join(m.customers, F.col("identifier") == F.col("customer")).select(
        "sheet", F.col("customer_key").alias("row_ord"), F.col("identifier").alias("Identifier"),
        F.col("value").alias("Actual Sales"))
    text = F.array_join(F.transform(
        F.map_entries("sample"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return sample_rows(rows, ENTITY).select("sheet", "row_ord", text.alias("sample"))


@check("suggested_queries", """SELECT suggested, count(*) AS n, CAST(max(c) AS DOUBLE) AS confidence FROM (
  SELECT CASE WHEN p_type = 'ECONOMY' THEN 'SP_TopBrandsBySales' WHEN p_type = 'STANDARD' THEN 'SP_TopProductsBySales' ELSE '' END AS suggested,
    CASE WHEN p_type = 'ECONOMY' THEN 0.8 WHEN p_type = 'STANDARD' THEN 0.5 END AS c FROM part) GROUP BY 1""")
def _(spark, folder):
    """Pattern hits over names from the part table; plain sales text falls back, other text has none."""
    parts = read_table(spark, folder, "part")
    word = F.when(F.col("p_type") == "ECONOMY", F.lit(" sales")).when(F.col("p_type") == "STANDARD", F.lit("sales")).otherwise(F.lit("no"))
    sheet = F.when(F.col("p_type") == "ECONOMY", F.col("p_brand")).otherwise(F.lit("Sheet"))
    found = match.suggestions(sheet, F.array(word))
    return parts.groupBy(
        F.array_join(F.transform(found, lambda s: s["sp_name"]), " ").alias("suggested")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.try_element_at(F.transform(found, lambda s: s["confidence"]), F.lit(1))).alias("confidence"))


@check("result_shapes", """SELECT shape, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'monthly_trends'
  WHEN 1 THEN 'store_sales' WHEN 2 THEN 'metric_value_pairs' WHEN 3 THEN 'generic_sales' ELSE 'generic' END AS shape FROM orders) GROUP BY 1""")
def _(spark, folder):
    """Column lists carried as data, classified row by row."""
    lists = F.array(*[F.array(*[F.lit(c) for c in columns]) for columns in (
        ["Month", "CurrentYearSales", "PreviousYearSales"], ["Identifier", "Actual Sales"],
        ["Identifier", "Metric", "Excel Value"], ["Label", "Sales"], ["Label", "Amount"])])
    rows = read_table(spark, folder, "orders").select(
        F.get(lists, (F.col("o_orderkey") % 5).cast("int")).alias("columns"))
    return rows.groupBy(match.output_shape(F.col("columns")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))

