"""Whole comparisons: KPIs, landing sheets, drill-throughs.

Each plan sums the facts of its parameters once, by every key that its queries group
by, runs each query a single time on those sums (queries that need more than sums run
on the facts, written once), and hands written query results to the comparison.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.functions.names import sheet_title, single_spaced, title_collisions
from salestally.functions.values import normalised
from salestally.model import SalesModel
from salestally.operators import drill, reconcile, report, reshape
from salestally.operators.match import match_sheets
from salestally.operators.reshape import ACTUAL, CURRENT, PREVIOUS, TARGET
from salestally.params import Params
from salestally.session import cut
from salestally.sources import exports
from salestally.sources.registry import Registry, kpi_values, probe

log = logging.getLogger("salestally")

WIDE_LAYOUTS = {
    "target": [ACTUAL, TARGET],
    "year": [PREVIOUS, CURRENT],
    "standard": [ACTUAL],
}


# --- KPIs -----------------------------------------------------------------------------


def compare_kpis(export: DataFrame, registry: Registry, model: SalesModel, p: Params,
                 drill_through: bool = False, numeric: bool = False) -> tuple[DataFrame, DataFrame]:
    """KPI report and its summary."""
    table = fv.DRILL_KPIS if drill_through else fv.LANDING_KPIS
    db = kpi_values(registry, model, p, table)
    out = reconcile.reconcile_kpis(export, db, numeric)
    return out, report.kpi_summary(out)


# --- sheets found by their profile ----------------------------------------------------------


@dataclass
class Mapping:
    """Chosen query per sheet, a written table, and the written results of the queries."""

    table: DataFrame
    results: dict[str, DataFrame]

    def routes(self) -> DataFrame:
        """The mapping as data: sheet -> query."""
        return self.table.select("sheet", F.col("sp_name").alias("query"))

    def queries(self) -> list[tuple[str, str]]:
        """The chosen queries with their shapes: at most as many as the catalogue has."""
        found = self.table.select("sp_name", "output_pattern").distinct().orderBy("sp_name", "output_pattern")
        return [tuple(row) for row in found.collect()]


def map_sheets(sheets: DataFrame, registry: Registry, model: SalesModel, p: Params,
               names: list[str] | None = None, rules=None, boosts=None) -> Mapping:
    """Profile the sheets, try the catalogue, choose a query per sheet.

    sheets: one row per sheet (sheet, headers, data_volume). The choice stays a
    table; what comes to the driver is which queries of the catalogue it holds.
    """
    found = probe(registry, model, p, names)
    working = [(o, n, shape, rows, cols) for o, n, ok, rows, cols, shape, _, _ in found.rows if ok]
    return Mapping(cut(match_sheets(sheets, working, rules, boosts), "sheet-queries"), found.results)


def query_cells(mapping: Mapping) -> DataFrame | None:
    """Cells of every chosen query under the query's own name, once however many sheets it has."""
    parts = [reshape.format_result(mapping.results[query], query, shape) for query, shape in mapping.queries()]
    return reconcile.override_union(parts) if parts else None


def mapped_cells(mapping: Mapping) -> DataFrame | None:
    """Cells of every mapped query under the names of its sheets."""
    cells = query_cells(mapping)
    if cells is None:
        return None
    routes = mapping.routes().withColumnRenamed("sheet", "title")
    return cells.join(routes, F.col("sheet") == F.col("query")).select(
        F.col("title").alias("sheet"), "identifier", "metric", "value")


def routed(export: DataFrame, mapping: Mapping) -> DataFrame:
    """``export`` with the query of each row's sheet, null where none was found."""
    # a single sheet's name can be a constant of the plan, which as a key would leave the join without one
    name = F.when(F.monotonically_increasing_id() >= 0, F.col("sheet"))
    routes = mapping.routes().withColumnRenamed("sheet", "title")
    return export.withColumn("own", name).join(routes, F.col("own") == F.col("title"), "left").drop("own", "title")


def compare_mapped(wide: dict[str, DataFrame], sheets: DataFrame, registry: Registry,
                   model: SalesModel, p: Params, long: DataFrame | None = None,
                   **match) -> dict[str, DataFrame] | None:
    """Compare sheets with the queries their profile leads to.

    wide: layout -> export rows in columns; long: cells of the sheets whose
    metrics are data. Returns a wide report per layout, and a long one under
    "metric"; or None when no sheet finds a query.

    Rows meet values on (query, identifier, metric): the plan grows with the layouts and
    the catalogue, not with the sheets, and a result is there once for all sheets it answers.
    """
    if sheets.isEmpty():
        return None
    pinned = model.pinned(p).cubed(p)
    mapping = map_sheets(sheets, registry, pinned, p, **match)
    cells = query_cells(mapping)
    if cells is None:
        return None
    db = cut(cells, "db-cells")
    out = {
        layout: reconcile.reconcile_wide(routed(df, mapping), db, WIDE_LAYOUTS[layout], "query")
        for layout, df in wide.items()
    }
    if long is not None:
        out["metric"] = reconcile.reconcile_long(routed(long, mapping), db, route="query")
    return out


# --- sheets with a fixed query ----------------------------------------------------------------


def landing_values(registry: Registry, model: SalesModel, p: Params,
                   table: dict[str, str] | None = None) -> DataFrame:
    """Cells of the landing queries under their sheets' names.

    A query that fails is one cell with the value Error; the others go on.
    """
    def values(sheet: str, query: str) -> DataFrame:
        try:
            cells = reshape.landing_cells(registry.call(query, model, p, ordered=False), sheet.strip())
            return cut(cells, f"query-{query}")  # written here, so that it fails here if it fails
        except Exception:  # one bad query must not end the run
            log.warning("query %s failed", query, exc_info=True)
            return model.spark.range(1).select(
                F.lit(sheet.strip()).alias("sheet"), F.lit(None).cast("string").alias("identifier"),
                F.lit(ACTUAL).alias("metric"), F.lit("Error").alias("value"),
            )

    return reconcile.override_union(_each(model, values, (table or fv.LANDING_SHEETS).items()))


def _each(model: SalesModel, make, items, workers: int = 4) -> list:
    """``make`` of every item, a few at a time: small queries leave most of a cluster idle."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(inheritable_thread_target(model.spark)(lambda item: make(*item)), list(items)))


def compare_landing(export: DataFrame, registry: Registry, model: SalesModel, p: Params,
                    table: dict[str, str] | None = None, normalise: bool = False) -> DataFrame:
    """Long report of the landing sheets against their fixed queries."""
    table = table or fv.LANDING_SHEETS
    widget = F.coalesce(reconcile.sheet_widget(F.col("sheet"), list(table)), F.col("sheet"))
    keyed = export.withColumn("sheet", widget)
    db = landing_values(registry, model.cubed(p), p, table)
    if normalise:
        db = normalised_cells(db)
    return reconcile.reconcile_long(keyed, cut(db, "db-cells"))


def _mapped_or_none(*args) -> dict[str, DataFrame] | None:
    """Comparison by profile; a failure is logged and leaves the fixed queries to answer."""
    try:
        return compare_mapped(*args)
    except Exception:
        log.warning("comparison by profile failed, fixed queries are used", exc_info=True)
        return None


def compare_landing_any(export: DataFrame, wide: dict[str, DataFrame], sheets: DataFrame,
                        registry: Registry, model: SalesModel, p: Params, long: DataFrame | None = None):
    """By profile; when that finds nothing or fails, by the fixed table: (method, result).

    ``long`` holds the cells of sheets whose metrics are data, which have no wide report.
    """
    found = _mapped_or_none(wide, sheets, registry, model, p, long)
    if found is not None:
        return "dynamic_engine", found
    return "legacy", compare_landing(export, registry, model, p)


def normalised_cells(cells: DataFrame) -> DataFrame:
    """Keys with single spaces, values in canonical text, the last of equal keys kept."""
    tidy = cells.select(
        *[single_spaced(c).alias(c) for c in reconcile.KEYS], normalised("value").alias("value")
    )
    return reconcile.last_wins(tidy, reconcile.KEYS, "value", "value")


@dataclass
class LandingCheck:
    """What the landing comparison reports besides the rows."""

    params: Params
    report: DataFrame
    sides: DataFrame
    kinds: DataFrame
    preview: DataFrame


def check_landing(export: DataFrame, registry: Registry, model: SalesModel, p: Params,
                  as_of: date | None = None) -> LandingCheck:
    """Landing comparison with fresh dates, key sets, value kinds and a preview."""
    if as_of is not None:
        p = p.fresh(as_of)
    raw = cut(landing_values(registry, model.cubed(p), p), "db-cells")
    tidy = cut(normalised_cells(raw), "db-tidy")
    sides = reconcile.key_sides(export, raw)
    return LandingCheck(
        params=p,
        report=reconcile.reconcile_long(export, tidy),
        sides=reconcile.key_side_counts(sides),
        kinds=report.value_kinds(raw),
        preview=reconcile.equal_preview(export, raw),
    )


# --- drill-throughs --------------------------------------------------------------------------------


def bundle_cells(registry: Registry, model: SalesModel, p: Params, queries: list[str]) -> DataFrame:
    """Cells of several drill-through queries under their sheets' full names; later ones override earlier ones."""
    def cells(query: str) -> DataFrame | None:
        try:
            return cut(reshape.drill_cells(registry.call(query, model, p, ordered=False), query), f"query-{query}")
        except Exception:  # a missing query leaves its sheet without values
            log.warning("query %s failed", query, exc_info=True)
            return None

    parts = [part for part in _each(model, cells, [(q,) for q in queries]) if part is not None]
    if not parts:
        return reshape.no_cells(model.lines)
    return reconcile.override_union(parts)


def with_titles(db: DataFrame) -> DataFrame:
    """Cells under their sheets' full names and, where only one of them is so cut, under the cut
    name that an exported file may have."""
    names = db.select("sheet").distinct()
    titles = names.groupBy(sheet_title("sheet").alias("title")).agg(
        F.count(F.lit(1)).alias("names"), F.max("sheet").alias("full")).where("names = 1 and length(full) > length(title)")
    short = db.join(titles.select("title", F.col("full").alias("sheet")), "sheet")
    return db.select(*reconcile.KEYS, "value").unionByName(
        short.select(F.col("title").alias("sheet"), "identifier", "metric", "value"))


def with_shown_titles(report: DataFrame) -> DataFrame:
    """Sheets shown under their cut names; those that agree so far keep their full ones."""
    twice = title_collisions(report).select(F.col("title").alias("twice"))
    return report.join(twice, sheet_title("sheet") == F.col("twice"), "left").withColumn(
        "sheet", F.when(F.col("twice").isNull(), sheet_title("sheet")).otherwise(F.col("sheet"))).drop("twice")


def compare_bundle(export: DataFrame, registry: Registry, model: SalesModel, p: Params,
                   queries: list[str] | None = None) -> DataFrame:
    """Long report of a drill-through's sheets, with the weekly sheets' other names.

    Sheets are compared under their full names, so that two that agree in their first letters
    stay apart; a name that was cut when it was exported still finds its only full one.
    """
    db = cut(with_titles(bundle_cells(registry, model.cubed(p), p, queries or fv.STORE_BUNDLE)), "db-cells")
    return with_shown_titles(reconcile.reconcile_long(export, db, weekly_fallbacks=True))


def compare_drill_through(export: DataFrame, wide: dict[str, DataFrame], sheets: DataFrame,
                          title: str, target: str, registry: Registry, model: SalesModel,
                          p: Params | None = None, stores: dict[str, str] | None = None,
                          long: DataFrame | None = None):
    """One drill-through: (method, result).

    A store target runs the one-store bundle; other targets are matched by
    profile, and failing that run the four-query bundle.
    """
    p = p or drill.target_params(title, target, stores)
    if p.store is not None:
        return "bundle", compare_bundle(export, registry, model, p, fv.STORE_BUNDLE)
    found = _mapped_or_none(wide, sheets, registry, model, p, long)
    if found is not None:
        return "dynamic_engine", found
    return "legacy", compare_bundle(export, registry, model, p, fv.DRILL_BUNDLE)


def compare_folder(spark, folder: str, title: str, target: str, registry: Registry,
                   model: SalesModel, p: Params | None = None, pattern: str | None = None,
                   stores: dict[str, str] | None = None):
    """Compare the sheet files of a folder as one drill-through; every sheet is reported, those of headers
    that are not known without values."""
    sheets = exports.read_sheets(spark, folder, pattern)
    if not sheets:
        raise FileNotFoundError(f"no sheets in {folder}")
    cells = exports.cells_of(spark, sheets, every_row=True)
    shapes = exports.shapes_of_all(sheets)
    wide = wide_layouts(sheets)
    long = metric_cells(sheets)
    return compare_drill_through(cells, wide, shapes, title, target, registry, model, p, stores, long)


# export layout -> layout of the wide report
WIDE_OF = {"target": "target", "year": "year", "entity": "standard", "employee": "standard"}
METRIC_LAYOUTS = ("metric", "week_metric")


def wide_layouts(sheets: dict[tuple, DataFrame]) -> dict[str, DataFrame]:
    """Sheets as read, grouped by the layout of their wide report.

    A sheet of unknown headers is a standard one without a measure; sheets
    whose metrics are data have no wide report (see ``metric_cells``).
    """
    groups: dict[str, list[DataFrame]] = {}
    for header, df in sheets.items():
        layout = reshape.layout_of(list(header))
        if layout not in METRIC_LAYOUTS:
            groups.setdefault(WIDE_OF.get(layout, "standard"), []).append(reshape.sheet_wide(df, layout))
    return {kind: reshape.union_all(parts) for kind, parts in groups.items()}


def metric_cells(sheets: dict[tuple, DataFrame]) -> DataFrame | None:
    """Cells of the sheets whose metrics are data, if there are any."""
    found = [(df, reshape.layout_of(list(header))) for header, df in sheets.items()]
    parts = [reshape.sheet_cells(df, layout) for df, layout in found if layout in METRIC_LAYOUTS]
    return reshape.union_all(parts) if parts else None
