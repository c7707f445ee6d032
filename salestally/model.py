"""The sales model: facts and dimensions every query is written against.

``SalesModel`` holds five tables with canonical columns; ``bind`` makes them
from the order tables in a folder. The two ways of reading the facts decide
how a query scales:

* ``bills`` sums the lines of an order first and joins the orders after. The
  sum is combined on the map side, so a single order with a third of all
  lines reaches the shuffle as one row per task, and the join meets unique
  keys on both sides.
* ``line_sales`` joins line by line, for queries that need the store or the
  product of a line. Both sides of that join are plain shuffles, the form in
  which AQE can split a hot order key. Aggregations above it run on store or
  product keys and are combined on the map side before they shuffle.

Dimensions are joined after aggregation wherever the result allows, so their
size never multiplies with the facts. No broadcast is forced: whether a
dimension is small enough is decided by its measured size.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salestally.params import Params, all_of, in_period, in_week
from salestally.session import cut

MONEY = "decimal(28,2)"


def amount(total: Column) -> Column:
    """Sum of ``sales`` in currency units, exact to four places."""
    return total.cast("decimal(28,0)") * F.lit(Decimal("0.0001"))


def money(total: Column) -> Column:
    """Sum of ``sales`` in currency units, rounded to cents."""
    return amount(total).cast(MONEY)


def pieces(total: Column) -> Column:
    """Sum of ``units`` in whole units and two places."""
    return (total.cast("decimal(28,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def _is_store(p: Params) -> Column:
    """Stores are asked for by id; any other text is no store."""
    return F.col("store_key") == int(p.store) if p.store.isdigit() else F.lit(False)


@dataclass(frozen=True)
class SalesModel:
    """Canonical tables.

    lines: order_key, product_key, store_key, units (hundredths, bigint),
        sales (net, ten-thousandths of the currency unit, decimal(18,0))
    orders: order_key, customer_key, order_ts, channel
    stores: store_key, store, state_key, area
    states: state_key, state, region_key
    regions: region_key, region
    products: product_key, product, brand, category, sub_category
    customers: customer_key, customer
    facts: the joined facts when they have been written once (``pinned``)
    cube: sums of one set of parameters by every key that queries group by (``cubed``)
    """

    lines: DataFrame
    orders: DataFrame
    stores: DataFrame
    states: DataFrame
    regions: DataFrame
    products: DataFrame
    customers: DataFrame
    facts: DataFrame | None = None
    cube: "Cube | None" = None

    @property
    def spark(self) -> SparkSession:
        return self.lines.sparkSession

    # --- filters ----------------------------------------------------------

    def scoped_stores(self, p: Params) -> DataFrame:
        """Stores within the store and state filters."""
        stores = self.stores
        if p.store is not None:
            stores = stores.filter(_is_store(p))
        if p.state is not None:
            wanted = self.states.filter(F.col("state") == p.state).select("state_key")
            stores = stores.join(wanted, "state_key", "left_semi")
        return stores

    def scoped_products(self, p: Params) -> DataFrame:
        """Products within the pinned brand, category, sub-category or product."""
        products = self.products
        for column in ("brand", "category", "sub_category", "product"):
            value = getattr(p, column)
            if value is not None:
                products = products.filter(F.col(column) == value)
        return products

    def _in_scope(self, lines: DataFrame, p: Params) -> DataFrame:
        """Only the filters that are set become predicates or semi-joins."""
        if p.store is not None:
            lines = lines.filter(_is_store(p))
        if p.state is not None:
            keys = self.scoped_stores(replace(p, store=None)).select("store_key")
            lines = lines.join(keys, "store_key", "left_semi")
        if any((p.brand, p.category, p.sub_category, p.product)):
            keys = self.scoped_products(p).select("product_key")
            lines = lines.join(keys, "product_key", "left_semi")
        return lines

    @staticmethod
    def _when(p: Params, compare: bool) -> Column | None:
        """Order predicate; with ``compare`` the previous year's period as well."""
        day = F.col("order_ts")
        period = in_period(p, day)
        if compare:
            period = period | in_period(p.previous_year(), day)
        channel = None if p.channel is None else F.col("channel") == p.channel
        return all_of([period, channel, in_week(p, day)])

    def _orders(self, p: Params, compare: bool) -> DataFrame:
        test = self._when(p, compare)
        return self.orders if test is None else self.orders.filter(test)

    # --- facts ------------------------------------------------------------

    def line_sales(self, p: Params, compare: bool = False) -> DataFrame:
        """One row per sold line in scope, with the order's day and customer."""
        if self.facts is not None:
            test = self._when(p, compare)
            facts = self.facts if test is None else self.facts.filter(test)
            return self._in_scope(facts, p)
        return self._in_scope(self.lines, p).join(self._orders(p, compare), "order_key")

    def bills(self, p: Params, compare: bool = False) -> DataFrame:
        """One row per order with a line in scope: its sums, day and customer."""
        sums = [F.sum("sales").alias("sales"), F.sum("units").alias("units")]
        if self.facts is not None:
            return (
                self.line_sales(p, compare)
                .groupBy("order_key")
                .agg(*sums, F.first("order_ts").alias("order_ts"),
                     F.first("customer_key").alias("customer_key"))
            )
        per_order = self._in_scope(self.lines, p).groupBy("order_key").agg(*sums)
        return per_order.join(self._orders(p, compare), "order_key")

    def day_sales(self, p: Params, compare: bool = False) -> DataFrame:
        """Rows whose sums per day or customer are right, in the cheapest form."""
        return self.line_sales(p, compare) if self.facts is not None else self.bills(p, compare)

    # --- sums ---------------------------------------------------------------

    def sums(self, p: Params, *keys: str, compare: bool = False) -> DataFrame:
        """``now``, ``before`` and ``units`` (of the period) summed by keys of one of the sets in ``CUBE_SETS``.

        From the cube they come by the whole set, and what asks for fewer keys sums them up. Without ``compare`` only keys that occur in the period, and no ``before``. Read
        from the cube where there is one for these parameters, else summed from the facts, in
        the cheapest form for the keys.
        """
        own = next((i for i, every in enumerate(CUBE_SETS) if set(keys) <= set(every)), None)
        if own is None:
            raise ValueError(f"no sums by {keys}")
        if self.cube is not None and self.cube.params == p:
            rows = self.cube.rows.where(F.col("kind") == own)
            if compare:
                return rows.select(*keys, "now", "before", "units")
            return rows.where("bought > 0").select(*keys, "now", "units")
        by_order = set(keys) <= {"customer_key", "day"}
        rows = self.day_sales(p, compare) if by_order else self.line_sales(p, compare)
        return _measured(rows, p, compare).groupBy(*keys).agg(*_cube_sums(compare))

    def cubed(self, p: Params) -> "SalesModel":
        """The sums of ``p``, both years, by all sets of keys, in one pass over the facts.

        The catalogue's queries read this table instead of the facts: each of them the rows of
        its own set, which lie in a folder of their own. Rows are summed in each task before
        they move, once per set, so a hot product or store costs one row per task.
        """
        columns = list(dict.fromkeys(k for keys in CUBE_SETS for k in keys))
        rows = _measured(self.line_sales(p, compare=True), p, True)
        sums = rows.groupingSets([[F.col(k) for k in keys] for keys in CUBE_SETS], *[F.col(k) for k in columns]).agg(
            *_cube_sums(True), F.count_if(F.col("current")).alias("bought"), F.grouping_id().alias("id"))
        # the id has a bit for each column that a set lacks, the first column's highest
        ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for keys in CUBE_SETS]
        kind = F.array_position(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("id")) - 1
        return replace(self, cube=Cube(p, cut(sums.withColumn("kind", kind.cast("int")).drop("id"), "cube", "kind")))

    def pinned(self, p: Params, compare: bool = True) -> "SalesModel":
        """The joined facts of a period and scope written once, for several queries.

        A comparison runs up to eighteen queries with the same parameters; written
        once, each of them reads two or three columns of one table and the
        join of lines with orders is paid a single time. What the parameters leave
        out, such as all other stores of a drill-through, is not written. Queries with
        further filters can run on it, queries with others cannot.
        """
        facts = self.line_sales(p, compare).select(
            "order_key", "order_ts", "customer_key", "channel",
            "store_key", "product_key", "units", "sales",
        )
        return replace(self, facts=cut(facts, "facts"))


# the keys by which queries sum, each a set of the cube
CUBE_SETS = [("product_key", "month"), ("store_key",), ("customer_key",), ("day",)]


@dataclass(frozen=True)
class Cube:
    """Sums of the facts in the scope of ``params``: a row per key of every set, marked by ``kind``."""

    params: Params
    rows: DataFrame


def _measured(rows: DataFrame, p: Params, compare: bool) -> DataFrame:
    return rows.withColumns({
        "day": F.to_date("order_ts"), "month": F.month("order_ts"),
        "current": is_current(p) if compare else F.lit(True)})


def _cube_sums(compare: bool) -> list[Column]:
    now = F.col("current")
    if not compare:
        return [F.sum("sales").alias("now"), F.sum("units").alias("units")]
    return [F.sum(F.when(now, F.col("sales"))).alias("now"), F.sum(F.when(~now, F.col("sales"))).alias("before"),
            F.sum(F.when(now, F.col("units"))).alias("units")]


def is_current(p: Params) -> Column:
    """Whether a row of a two-year read belongs to the period itself."""
    return F.coalesce(in_period(p, F.col("order_ts")), F.lit(True))


def bind(read) -> SalesModel:
    """Bind the order tables. ``read(name)`` returns one of them.

    Prices, discounts and quantities have two places. They become whole
    numbers before they are multiplied, so every sum is exact; rounding to the
    nearest whole number undoes the inexactness of the stored doubles and is
    several times cheaper than a cast to decimal. Sums of sales are kept in
    decimals, since over very many lines they outgrow a bigint.
    """
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    paid = 100 - F.rint(F.col("l_discount") * 100).cast("bigint")
    lines = read("lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("product_key"),
        F.col("l_suppkey").alias("store_key"),
        F.rint(F.col("l_quantity") * 100).cast("bigint").alias("units"),
        (cents * paid).cast("decimal(18,0)").alias("sales"),
    )
    orders = read("orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer_key"),
        F.col("o_orderdate").alias("order_ts"),
        F.col("o_orderpriority").alias("channel"),
    )
    stores = read("supplier").select(
        F.col("s_suppkey").alias("store_key"),
        F.col("s_name").alias("store"),
        F.col("s_nationkey").alias("state_key"),
        (500 + 25 * F.pmod("s_suppkey", F.lit(40))).alias("area"),
    )
    states = read("nation").select(
        F.col("n_nationkey").alias("state_key"),
        F.col("n_name").alias("state"),
        F.col("n_regionkey").alias("region_key"),
    )
    regions = read("region").select(
        F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region")
    )
    products = read("part").select(
        F.col("p_partkey").alias("product_key"),
        F.col("p_name").alias("product"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat("p_type", F.lit(" / "), F.col("p_size").cast("string")).alias("sub_category"),
    )
    customers = read("customer").select(
        F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("customer")
    )
    return SalesModel(lines, orders, stores, states, regions, products, customers)


# Column types of the order tables. Stated, so that opening a table costs no
# job that reads file footers.
TABLE_SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(os.path.join(folder, f"{name}.parquet"))


def bind_folder(spark: SparkSession, folder: str) -> SalesModel:
    """Bind Parquet tables named after the order schema."""
    return bind(lambda name: read_table(spark, folder, name))


def to_doubles(df: DataFrame) -> DataFrame:
    """Exact decimals become doubles, for callers that cannot take decimals."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
