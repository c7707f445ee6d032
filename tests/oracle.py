"""Compare registered queries with their SQL in DuckDB.

Run as a script: ``python tests/oracle.py FOLDER [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# no pairs of rows, no Python in the hot path
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas")


def compare(spark, con, folder: str, name: str, build, sql: str | None) -> str | None:
    """None when plan and rows are as they should be, else a short text on the difference."""
    df = build(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in UNWANTED:
        if word in plan:
            return f"{word} in the plan"
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return None if mine else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}
    for (column, kind), described in zip(df.dtypes, df.columns):
        theirs = next(str(d[1]) for d in cursor.description if d[0] == described)
        if theirs not in ("STRING", "NUMBER", "bool") and kind in kinds and theirs not in kinds[kind]:
            return f"type of {column}: {kind} != {theirs}"
    theirs = rows_of(columns, cursor.fetchall())
    if mine == theirs:
        return None
    only = [r for r in mine if r not in set(theirs)][:2]
    other = [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} rows / {len(theirs)} rows; only here {only}; only there {other}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from salestally import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(folder), oracle_sql(), 0
    for name, build in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, build, sql.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in sql else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{bad} problems")
