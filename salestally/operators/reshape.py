"""Query results and export sheets in one keyed form.

``cells`` are rows of (sheet, identifier, metric, value). The metrics are
"Actual Sales" for the plain value, "Target", "Previous Year", "Current Year"
or, where the metric is itself data, its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.functions.names import (
    day_type, first_present, identifier_or_blank, identifier_or_unknown, short_month,
    with_sales_suffix,
)
from salestally.functions.values import without_thousands

ACTUAL, TARGET = "Actual Sales", "Target"
PREVIOUS, CURRENT = "Previous Year", "Current Year"
CELL_COLUMNS = ["sheet", "identifier", "metric", "value"]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def _melt(df: DataFrame, sheet: Column | str, identifier: Column, measures: dict[str, Column]) -> DataFrame:
    """One row per measure that has a value; without measures no rows."""
    sheet = F.lit(sheet) if isinstance(sheet, str) else sheet
    if not measures:
        return no_cells(df)
    wide = df.select(
        sheet.alias("sheet"), identifier.alias("identifier"),
        *[_text(c).alias(m) for m, c in measures.items()],
    )
    return (
        wide.unpivot(["sheet", "identifier"], list(measures), "metric", "value")
        .filter(F.col("value").isNotNull())
    )


def no_cells(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in CELL_COLUMNS))


# --- roles of result columns ------------------------------------------------------

# a column gets the first role one of whose words it contains
_ROLE_WORDS = [
    ("previous", ["previous"]),
    ("current", ["current"]),
    ("identifier", ["identifier", "store"]),
    ("value", ["actual", "sales"]),
    ("target", ["target"]),
    ("week", ["week"]),
]
_ENTITY_WORDS = ["name", "product", "brand", "category"]


def pick_columns(columns: list[str]) -> dict[str, str]:
    """Role -> column name. Year columns are told from plain sales columns."""
    roles: dict[str, str] = {}
    for column in columns:
        low = column.lower()
        if low in ("metric", "excel value"):
            roles[low] = column
            continue
        for role, words in _ROLE_WORDS:
            if any(w in low for w in words):
                roles[role] = column
                break
        else:
            if any(w in low for w in _ENTITY_WORDS):
                roles.setdefault("entity", column)
    if "identifier" not in roles:
        for stand_in in ("entity", "week"):
            if stand_in in roles:
                roles["identifier"] = roles[stand_in]
                break
    return roles


def rename_by_role(df: DataFrame) -> DataFrame:
    """Give the recognised columns of a result their role names."""
    return df.withColumnsRenamed({v: k for k, v in pick_columns(df.columns).items() if v != k})


# --- one formatter per result shape --------------------------------------------------


def _years(df: DataFrame) -> dict[str, Column]:
    names = {PREVIOUS: "PreviousYearSales", CURRENT: "CurrentYearSales"}
    return {m: _c(n) for m, n in names.items() if n in df.columns}


def _label(df: DataFrame, *names: str) -> Column:
    present = [_c(n).cast("string") for n in names if n in df.columns]
    return F.trim(first_present(*present)) if present else F.lit(fv.UNKNOWN)


def monthly(df: DataFrame, sheet) -> DataFrame:
    return _melt(df, sheet, short_month(_label(df, "Month")), _years(df))


def weekly(df: DataFrame, sheet) -> DataFrame:
    years = {m: without_thousands(c.cast("string")) for m, c in _years(df).items()}
    return _melt(df, sheet, _label(df, "Week", "WeekCategory"), years)


def weekday(df: DataFrame, sheet) -> DataFrame:
    label = with_sales_suffix(day_type(_label(df, "DayType", "WeekCategory")))
    return _melt(df, sheet, label, _years(df))


def entity(name: str):
    """Formatter for (name, Sales) results."""
    def format_entity(df: DataFrame, sheet) -> DataFrame:
        return _melt(df, sheet, _label(df, name), {ACTUAL: _c("Sales")} if "Sales" in df.columns else {})
    return format_entity


def generic_sales(df: DataFrame, sheet) -> DataFrame:
    """Identifier, sales and target found by the words in their names."""
    roles = pick_columns(df.columns)
    if "identifier" not in roles or "value" not in roles:
        return no_cells(df)
    measures = {ACTUAL: _c(roles["value"])}
    if "target" in roles:
        measures[TARGET] = _c(roles["target"])
    identifier = F.trim(F.coalesce(_c(roles["identifier"]).cast("string"), F.lit(fv.UNKNOWN)))
    return _melt(df, sheet, identifier, measures)


def metric_pairs(df: DataFrame, sheet) -> DataFrame:
    if not {"Metric", "Excel Value"} <= set(df.columns):
        return no_cells(df)
    metric = F.trim(F.coalesce(_c("Metric"), F.lit("")))
    known = (
        F.when(F.lower(metric) == "actual sales", F.lit(ACTUAL))
        .when(F.lower(metric) == "target", F.lit(TARGET))
        .otherwise(metric)
    )
    sheet = F.lit(sheet) if isinstance(sheet, str) else sheet
    return df.select(
        sheet.alias("sheet"), _label(df, "Identifier").alias("identifier"), known.alias("metric"),
        _text(without_thousands(_c("Excel Value").cast("string"))).alias("value"),
    ).filter(F.col("value").isNotNull())


def generic(df: DataFrame, sheet) -> DataFrame:
    """First column is the identifier, second the value; null is 0. One column gives no cells."""
    if len(df.columns) < 2:
        return no_cells(df)
    sheet = F.lit(sheet) if isinstance(sheet, str) else sheet
    first, second = df.columns[:2]
    return df.select(
        sheet.alias("sheet"),
        identifier_or_unknown(_c(first).cast("string")).alias("identifier"),
        F.lit(ACTUAL).alias("metric"),
        F.coalesce(_text(_c(second)), F.lit("0")).alias("value"),
    )


FORMATTERS = {
    "monthly_trends": monthly,
    "weekly_trends": weekly,
    "weekday_weekend": weekday,
    "product_sales": entity("ProductName"),
    "brand_sales": entity("BrandName"),
    "store_sales": generic_sales,
    "employee_performance": entity("EmployeeName"),
    "metric_value_pairs": metric_pairs,
    "category_sales": entity("CategoryName"),
    "generic_sales": generic_sales,
    "generic": generic,
}


def format_result(df: DataFrame, sheet, shape: str) -> DataFrame:
    """Cells of a result, by its shape."""
    return df.transform(FORMATTERS.get(shape, generic), sheet)


def landing_cells(df: DataFrame, sheet: str) -> DataFrame:
    """Cells of a landing query: keyed measures, metric pairs, or one scalar."""
    roles = pick_columns(df.columns)
    if "identifier" in roles and {"metric", "excel value"} <= roles.keys():
        return metric_pairs(
            df.withColumnsRenamed({roles["identifier"]: "Identifier", roles["metric"]: "Metric",
                                   roles["excel value"]: "Excel Value"}), sheet)
    measures = {
        m: _c(roles[r])
        for m, r in [(ACTUAL, "value"), (TARGET, "target"), (PREVIOUS, "previous"), (CURRENT, "current")]
        if r in roles
    }
    if "identifier" in roles and measures:
        named = df.filter(_c(roles["identifier"]).isNotNull() & (_c(roles["identifier"]) != ""))
        return _melt(named, sheet, _text(_c(roles["identifier"])), measures)
    return scalar_cell(df, sheet)


def first_value(df: DataFrame, missing: str = fv.NO_DATA) -> DataFrame:
    """First cell of the first row as (value), a text where there is no row."""
    return df.limit(1).agg(
        F.coalesce(_text(F.first(_c(df.columns[0]))), F.lit(missing)).alias("value")
    )


def scalar_cell(df: DataFrame, sheet: str, missing: str = fv.NO_DATA) -> DataFrame:
    return first_value(df, missing).select(
        F.lit(sheet).alias("sheet"), F.lit(None).cast("string").alias("identifier"),
        F.lit(ACTUAL).alias("metric"), "value",
    )


def drill_cells(df: DataFrame, query: str) -> DataFrame:
    """Cells of a drill-through query under the fixed sheet names.

    Weekday and weekend rows are also known under the weekly sheet, with and
    without the suffix; those aliases are exploded from the row itself.
    """
    columns = set(df.columns)
    if {"CurrentYearSales", "PreviousYearSales"} <= columns:
        if "Month" in columns:
            return monthly(df, fv.DRILL_SHEETS["monthly_trends"])
        if columns & {"DayType", "WeekCategory"}:
            return _weekday_aliases(df)
        if "Week" in columns:
            return weekly(df, fv.DRILL_SHEETS["weekly_trends"])
    for name, shape in [("ProductName", "product_sales"), ("BrandName", "brand_sales"),
                        ("EmployeeName", "employee_performance")]:
        if {name, "Sales"} <= columns:
            return FORMATTERS[shape](df, fv.DRILL_SHEETS[shape])
    return generic(df, f"Generic_{query}")


def _weekday_aliases(df: DataFrame) -> DataFrame:
    label = _label(df, "DayType", "WeekCategory")
    upper = day_type(label)
    is_day = upper.rlike("WEEKDAY|WEEKEND")

    def key(sheet: str, identifier: Column) -> Column:
        return F.struct(F.lit(sheet).alias("sheet"), identifier.alias("identifier"))

    keys = F.when(
        is_day,
        F.array_compact(F.array(
            key(fv.WEEKDAY_SHEET, upper),
            key(fv.WEEKLY_ALIAS_SHEET, upper),
            F.when(upper.isin("WEEKDAY", "WEEKEND"),
                   key(fv.WEEKLY_ALIAS_SHEET, F.concat(upper, F.lit(fv.SALES_SUFFIX)))),
        )),
    ).otherwise(F.array(key(fv.DRILL_SHEETS["weekly_trends"], label)))
    exploded = df.withColumn("alias_key", F.explode(keys))
    return _melt(exploded, F.col("alias_key.sheet"), F.col("alias_key.identifier"), _years(df))


# --- export layouts --------------------------------------------------------------------

LAYOUTS = {
    "target": ["identifier", "actual sales", "targets"],
    "entity": ["identifier", "actual sales"],
    "week_metric": ["week", "metric", "value"],
    "metric": ["identifier/label", "metric", "excel value"],
    "year": ["previous year", "current year"],
    "employee": ["identifier", "sales"],
}


def layout_of(headers: list[str]) -> str | None:
    """Layout whose columns a header list has; the one with targets comes first."""
    have = {h.strip().lower() for h in headers}
    if "target" in have:
        have.add("targets")
    return next((name for name, need in LAYOUTS.items() if set(need) <= have), None)


def pick_header(headers: list[str], *wanted: str, position: int = 0) -> str:
    """First wanted header that is present, else the one at a position."""
    by_low = {h.strip().lower(): h for h in headers}
    return next((by_low[w] for w in wanted if w in by_low), headers[position])


MEASURES = {
    "target": {ACTUAL: "actual sales", TARGET: "targets"},
    "entity": {ACTUAL: "actual sales"},
    "employee": {ACTUAL: "sales"},
    "year": {PREVIOUS: "previous year", CURRENT: "current year"},
}


def _own_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("sheet", "row_ord")]


def sheet_wide(df: DataFrame, layout: str | None) -> DataFrame:
    """Export rows of a layout with measures in columns, under the metrics' names.

    ``df`` has the columns sheet and row_ord besides the sheet's own. Without a
    layout the measure is null.
    """
    own = _own_columns(df)
    low = {c.strip().lower(): c for c in own}
    low.setdefault("targets", low.get("target"))
    name = _c(pick_header(own, "identifier", "identifier/label", "week"))
    return df.select(
        F.trim("sheet").alias("sheet"), "row_ord", identifier_or_unknown(name).alias("identifier"),
        *([_text(_c(low[h])).alias(m) for m, h in MEASURES[layout].items()]
          if layout else [F.lit(None).cast("string").alias(ACTUAL)]),
    )


def sheet_cells(df: DataFrame, layout: str, null_as_zero: bool = False) -> DataFrame:
    """Cells of export rows of one layout: sheet, row_ord, identifier, metric, value_raw.

    Empty measures are skipped, or read as "0" with ``null_as_zero``; a
    metric/value row is kept even when it is empty.
    """
    if layout in ("metric", "week_metric"):
        own = _own_columns(df)
        low = {c.strip().lower(): c for c in own}
        name = _c(pick_header(own, "identifier", "identifier/label", "week"))
        value = _text(_c(low["excel value" if layout == "metric" else "value"]))
        return df.select(
            F.trim("sheet").alias("sheet"), "row_ord", identifier_or_unknown(name).alias("identifier"),
            identifier_or_blank(_c(low["metric"])).alias("metric"),
            (F.coalesce(value, F.lit("0")) if null_as_zero else value).alias("value_raw"),
        )
    long = sheet_wide(df, layout).unpivot(
        ["sheet", "row_ord", "identifier"], list(MEASURES[layout]), "metric", "value_raw"
    )
    if null_as_zero:
        return long.withColumn("value_raw", F.coalesce("value_raw", F.lit("0")))
    return long.filter(F.col("value_raw").isNotNull())


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
