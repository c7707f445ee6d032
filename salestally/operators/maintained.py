"""Tables kept up to date by day, from which KPIs are read without the whole history.

* Sketches of the customers per day and store: fixed-size, and any selection of them is united
  into an estimate of the distinct customers, which sums of counts could not give.
* The first day on which each customer bought: new days only lower what is known, so an
  increment reads the new days and the table, never the orders of the past.

Both are advanced by whole days. Running an increment again leaves the same table.
"""

from __future__ import annotations

import os
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salestally.model import MONEY, SalesModel
from salestally.params import Params

SKETCH = 14  # logarithm of a sketch's registers
ERROR = 4 * 0.83 / 2 ** (SKETCH / 2)  # four standard errors of an estimate


def days(start: date, stop: date) -> Params:
    """The days from ``start`` to before ``stop``."""
    return Params(fromdate=start, todate=date.fromordinal(stop.toordinal() - 1))


# --- sketches ---------------------------------------------------------------------------


def customer_sketches(model: SalesModel, p: Params) -> DataFrame:
    """day, store_key, sketch of the customers who bought there. Customers are sketched in each task
    before anything moves, so a busy store costs a sketch per task."""
    return (
        model.line_sales(p).groupBy(F.to_date("order_ts").alias("day"), "store_key")
        .agg(F.hll_sketch_agg("customer_key", F.lit(SKETCH)).alias("sketch"))
    )


def advance_sketches(model: SalesModel, path: str, start: date, stop: date) -> None:
    """Write the sketches of some days, in place of what was there for them."""
    rows = customer_sketches(model, days(start, stop))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def customers_by_sketch(model: SalesModel, path: str, p: Params) -> DataFrame:
    """Estimate of the distinct customers in a period and scope of stores: (Value).

    Only the folders of the period's days are read. Sketches know days and stores; other
    filters cannot be answered from them.
    """
    if any((p.channel, p.brand, p.category, p.sub_category, p.product, p.week, p.year_week)):
        raise ValueError("sketches are kept by day and store; filter by period, store or state")
    kept = model.spark.read.schema("store_key bigint, sketch binary, day date").parquet(path)
    start, stop = p.period()
    if start is not None:
        kept = kept.where(F.col("day") >= F.lit(start))
    if stop is not None:
        kept = kept.where(F.col("day") < F.lit(stop))
    if p.store is not None or p.state is not None:
        kept = kept.join(model.scoped_stores(p).select("store_key"), "store_key", "left_semi")
    return kept.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast(MONEY).alias("Value"))


# --- first purchases ------------------------------------------------------------------------

_FIRST = "customer_key bigint, first_day date"


def _version(path: str, until: date) -> str:
    return os.path.join(path, f"until={until.isoformat()}")


def advance_first_purchases(model: SalesModel, path: str, start: date | None, stop: date, scope: Params | None = None) -> None:
    """The table as of ``stop``, from that as of ``start`` (none: from nothing) and the days between.

    The new version lies beside the old one, so a run that is lost or repeated spoils neither.
    Customers meet by key after each side is reduced to one row per customer and task.
    """
    scope = scope or Params()
    period = Params(**{**scope.__dict__, "fromdate": start, "todate": date.fromordinal(stop.toordinal() - 1)})
    fresh = model.bills(period).select("customer_key", F.to_date("order_ts").alias("first_day"))
    if start is not None:
        fresh = fresh.unionByName(read_first_purchases(model.spark, path, start))
    fresh.groupBy("customer_key").agg(F.min("first_day").alias("first_day")).write.mode("overwrite").parquet(_version(path, stop))


def read_first_purchases(spark: SparkSession, path: str, until: date) -> DataFrame:
    return spark.read.schema(_FIRST).parquet(_version(path, until))


def new_customers(spark: SparkSession, path: str, until: date, p: Params) -> DataFrame:
    """Customers whose first day lies in the period: (Value)."""
    start, stop = p.period()
    test = F.lit(True)
    if start is not None:
        test = test & (F.col("first_day") >= F.lit(start))
    if stop is not None:
        test = test & (F.col("first_day") < F.lit(stop))
    return read_first_purchases(spark, path, until).agg(F.count_if(test).cast(MONEY).alias("Value"))
