"""Registration of queries and the parts their SQL texts share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salestally.model import bind_folder, to_doubles
from salestally.params import Params

CHECKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

YEAR = 1997
P = Params(year=YEAR)

# the facts with every dimension, as one SQL view
FACT = """
fact AS (
  SELECT l.l_orderkey AS bill, l.l_suppkey AS store_key, l.l_partkey AS product_key,
         CAST(l.l_quantity AS DECIMAL(12,2)) AS units,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS s,
         o.o_custkey AS customer_key, CAST(o.o_orderdate AS DATE) AS d, year(o.o_orderdate) AS y,
         o.o_orderpriority AS channel, c.c_name AS employee,
         s.s_name AS store, n.n_name AS state, r.r_name AS region,
         p.p_name AS product, p.p_brand AS brand, p.p_type AS category,
         p.p_type || ' / ' || p.p_size AS sub_category
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  JOIN part p ON p.p_partkey = l.l_partkey
)"""


def with_fact(query: str, *more: str) -> str:
    return "WITH " + ",\n".join([FACT, *more]) + "\n" + query


def money(expression: str) -> str:
    """Exact sum rounded to cents, as a double."""
    return f"CAST(CAST({expression} AS DECIMAL(28,2)) AS DOUBLE)"


def cents(expression: str) -> str:
    """Exact amount with two places as text."""
    return f"CAST(CAST({expression} AS DECIMAL(28,2)) AS VARCHAR)"


def check(name: str, sql: str | None = None):
    """Register ``build(spark, folder)`` under a name, with its SQL text."""
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return to_doubles(build(spark, folder))
        run.__name__ = name
        run.__doc__ = build.__doc__
        CHECKS[name] = run
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def model_check(name: str, sql: str | None = None):
    """The same for a query over the sales model."""
    def register(build):
        check(name, sql)(lambda spark, folder: build(bind_folder(spark, folder)))
        return build
    return register
