"""Named queries: call one by name, list their columns, try them out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from salestally import fixed_values as fv
from salestally.functions.values import row_map
from salestally.model import SalesModel
from salestally.operators import kpis, widgets
from salestally.operators.match import output_shape_of
from salestally.params import Params
from salestally.session import cut

Builder = Callable[[SalesModel, Params], DataFrame]


class UnknownQuery(KeyError):
    """No query of that name is registered."""


@dataclass
class Registry:
    """Query name -> function of (model, params). Insertion order is catalogue order."""

    queries: dict[str, Builder] = field(default_factory=dict)
    kpi_labels: dict[str, str] = field(default_factory=dict)
    sorted_queries: set[str] = field(default_factory=set)

    def register(self, name: str, build: Builder, sorted_rows: bool = False) -> None:
        """Add or replace a query; with ``sorted_rows`` it takes ``ordered=False``."""
        self.queries[name] = build
        self.kpi_labels.pop(name, None)
        self.sorted_queries.discard(name)
        if sorted_rows:
            self.sorted_queries.add(name)

    def register_kpi(self, name: str, label: str) -> None:
        """A built-in KPI; several of them are computed in one pass."""
        self.register(name, lambda model, p: kpis.kpi(model, p, label))
        self.kpi_labels[name] = label

    def call(self, name: str, model: SalesModel, p: Params, ordered: bool = True) -> DataFrame:
        """Result of a query. A comparison looks rows up by key and takes them unsorted."""
        try:
            build = self.queries[name]
        except KeyError:
            raise UnknownQuery(name) from None
        if not ordered and name in self.sorted_queries:
            return build(model, p, ordered=False)
        return build(model, p)

    def call_with(self, name: str, model: SalesModel, *values, **named) -> DataFrame:
        """Call with the seven filters by position or by name."""
        if values:
            named = dict(zip(fv.PARAM_FIELDS, values, strict=True))
        return self.call(name, model, Params(**named))

    def columns(self, name: str, model: SalesModel, p: Params) -> list[str]:
        """Column names of a query, from its plan: nothing is run."""
        return self.call(name, model, p).columns


def default_registry() -> Registry:
    r = Registry()
    r.register("SP_SalesTrend", widgets.monthly_trend)
    r.register("SP_TopPerformingEmployee", widgets.top_employees, sorted_rows=True)
    r.register("SP_TopProductsBySales", widgets.top_products, sorted_rows=True)
    r.register("SP_WeekdayWeekendSales", widgets.weekday_weekend)
    r.register("SP_WeekwiseSalesComparison", widgets.weekwise_comparison)
    r.register("SP_TopStoresbySales", widgets.top_stores, sorted_rows=True)
    r.register("SP_TopBrandsBySales", widgets.top_brands, sorted_rows=True)
    r.register("SP_TopCategoriesBySaleswidget", widgets.top_categories, sorted_rows=True)
    r.register("SP_TopSubCategoriesBySales", widgets.top_sub_categories, sorted_rows=True)
    r.register("SP_WeeklyTrendswidget", widgets.weekly_trends)
    r.register("SP_StorewiseActualVsTarget_Vertical_SortedByActual", widgets.store_actual_vs_target, sorted_rows=True)
    r.register("SP_TopProductsBySaleswidget", widgets.top_products, sorted_rows=True)
    for name, dimension in [
        ("SP_BrandTrends", "brand"), ("SP_CategoryTrends", "category"),
        ("SP_SubCategoryTrends", "sub_category"), ("SP_ProductTrends", "product"),
    ]:
        r.register(name, lambda m, p, d=dimension: widgets.dimension_trend(m, p, d))
    for name in ("SP_BrandProductAnalysis", "SP_CategoryProductAnalysis", "SP_ProductDetailAnalysis"):
        r.register(name, widgets.product_detail)
    for table in (fv.LANDING_KPIS, fv.DRILL_KPIS):
        for label, name in table.items():
            r.register_kpi(name, label)
    return r


# --- probing ------------------------------------------------------------------

PROBE_SCHEMA = (
    "ord int, sp_name string, works boolean, row_count bigint, columns array<string>, "
    "output_pattern string, sample map<string,string>, error string"
)


@dataclass
class Probe:
    """What a probe found: one row per query, and the results of those that ran."""

    rows: list[tuple]
    results: dict[str, DataFrame]
    spark: SparkSession

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, PROBE_SCHEMA)

    def working(self) -> DataFrame:
        """Only queries that returned rows."""
        return self.table().filter("works and row_count > 0")


def probe(registry: Registry, model: SalesModel, p: Params, names: list[str] | None = None,
          limit: int | None = None, workers: int = 4) -> Probe:
    """Run each query of a catalogue once; a failure becomes a row.

    Every result is written and kept, so what the probe computed is what a
    comparison reads later; rows are counted while they are written. The loop
    runs over the catalogue, whose length is fixed by the code. A few queries
    run at a time, since most of them leave part of a cluster idle.
    """
    spark = model.spark

    def attempt(ord_: int, name: str) -> tuple[tuple, DataFrame | None]:
        try:
            result = registry.call(name, model, p, ordered=False)
            counted = Observation()
            kept = cut(result.observe(counted, F.count(F.lit(1)).alias("n")), f"query-{name}")
            head = kept.limit(1).select(row_map(kept).alias("m")).collect()
            return (ord_, name, True, counted.get["n"], kept.columns, output_shape_of(kept.columns),
                    head[0]["m"] if head else None, None), kept
        except Exception as error:  # one bad query must not end the run
            return (ord_, name, False, None, None, None, None, str(error).splitlines()[0]), None

    wanted = list(enumerate((names or fv.CATALOGUE)[:limit]))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(lambda w: attempt(*w)), wanted))
    results = {row[1]: kept for row, kept in found if kept is not None}
    return Probe([row for row, _ in found], results, spark)


def profile(registry: Registry, model: SalesModel, p: Params, names: list[str] | None = None,
            limit: int | None = None, run: bool = False) -> DataFrame:
    """Row counts only, no stored results: one lazy query, in which a query that cannot be planned
    is a row. One that fails while it runs ends the whole query; with ``run`` each is counted in a
    job of its own, a few at a time, and such a failure is a row too."""
    if run:
        return _counted(registry, model, p, names, limit)
    out = None
    for ord_, name in enumerate((names or fv.CATALOGUE)[:limit]):
        try:
            result = registry.call(name, model, p)
            part = result.select(F.lit(1).alias("one")).agg(
                F.count("one").alias("row_count")
            ).select(
                F.lit(ord_).alias("ord"), F.lit(name).alias("sp_name"), F.lit(True).alias("works"),
                "row_count", F.lit(" ".join(result.columns)).alias("columns"),
                F.lit(output_shape_of(result.columns)).alias("output_pattern"),
                F.lit(None).cast("string").alias("error"),
            )
        except Exception as error:
            part = model.spark.range(1).select(
                F.lit(ord_).alias("ord"), F.lit(name).alias("sp_name"), F.lit(False).alias("works"),
                F.lit(None).cast("bigint").alias("row_count"),
                F.lit(None).cast("string").alias("columns"),
                F.lit(None).cast("string").alias("output_pattern"),
                F.lit(str(error).splitlines()[0]).alias("error"),
            )
        out = part if out is None else out.unionByName(part)
    return out


def _counted(registry: Registry, model: SalesModel, p: Params, names: list[str] | None, limit: int | None,
             workers: int = 4) -> DataFrame:
    def count(ord_: int, name: str) -> tuple:
        try:
            result = registry.call(name, model, p, ordered=False)
            # every column of every row, so that what fails in one of them fails here
            n = result.select(F.xxhash64(*[F.col(f"`{c}`") for c in result.columns]).alias("h")).agg(
                F.count(F.lit(1)).alias("n"), F.bit_xor("h")).first().n
            return ord_, name, True, n, " ".join(result.columns), output_shape_of(result.columns), None
        except Exception as error:  # one bad query must not end the run
            return ord_, name, False, None, None, None, str(error).splitlines()[0]

    wanted = list(enumerate((names or fv.CATALOGUE)[:limit]))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        rows = list(pool.map(inheritable_thread_target(model.spark)(lambda w: count(*w)), wanted))
    return model.spark.createDataFrame(
        rows, "ord int, sp_name string, works boolean, row_count bigint, columns string, output_pattern string, error string")


# --- KPI values with their failures ----------------------------------------------


def kpi_values(registry: Registry, model: SalesModel, p: Params,
               table: dict[str, str] | None = None) -> DataFrame:
    """(kpi_name, value text); a missing query or a failing one becomes a text.

    KPIs registered to the built-in functions share one pass over the bills;
    the others are called one by one.
    """
    table = table or fv.LANDING_KPIS
    spark = model.spark
    parts = []
    shared = [label for label, name in table.items() if registry.kpi_labels.get(name) == label]
    if shared:
        parts.append(
            kpis.kpi_set(model, p, shared).select(
                "kpi_name",
                F.coalesce(kpis.value_text(F.col("value")), F.lit(fv.NULL_TEXT)).alias("value"),
            )
        )
    for label, name in table.items():
        if label in shared:
            continue
        try:
            result = registry.call(name, model, p)
            first = F.col(f"`{result.columns[0]}`").cast("string")
            # a query without rows still has to give one row
            part = cut(result.agg(F.first(first).alias("v"), F.count(F.lit(1)).alias("n")).select(
                F.lit(label).alias("kpi_name"),
                F.when(F.col("n") == 0, F.lit(fv.NO_RESULT))
                .otherwise(F.trim(F.coalesce("v", F.lit(fv.NULL_TEXT)))).alias("value"),
            ), f"kpi-{name}")
        except UnknownQuery:
            part = _constant_kpi(spark, label, "SP Not Found")
        except Exception:
            part = _constant_kpi(spark, label, "DB Error")
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _constant_kpi(spark: SparkSession, label: str, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(label).alias("kpi_name"), F.lit(text).alias("value"))


# --- queries kept outside Spark -----------------------------------------------------


def sql_query(spark: SparkSession, text: str, p: Params | None = None,
              tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """A SQL text with named markers (``:year``) over named tables (``{orders}``).

    Values are bound, they never enter the text.
    """
    values = dict(zip(fv.PARAM_FIELDS, p.as_row())) if p else {}
    return spark.sql(text, args={**values, **args}, **(tables or {}))


def database_query(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
                   bounds: tuple | None = None, partitions: int = 1, **options) -> DataFrame:
    """A query against an external database, read in parallel by a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    low, high = bounds
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", str(low)).option("upperBound", str(high))
        .option("numPartitions", str(partitions))
        .load()
    )
