"""Rows of sheets in their order, over blocks and drops, and sheets that many queries answer."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from salestally.operators import match
from salestally.plans import comparisons
from salestally.session import scratch
from salestally.sources import exports, sheets
from salestally.streaming import arrivals


def put(folder, name, text, time=None):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    if time:
        os.utime(path, (time, time))
    return path


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_fields():
    assert sheets.fields_of('a,"b, c",,"d ""e""","f\\"g"') == ["a", "b, c", None, 'd "e"', 'f"g']
    assert sheets.headers_of("﻿Identifier, Actual Sales ,") == ["Identifier", "Actual Sales", "_c2"]


@pytest.mark.parametrize("block", ["100", "134217728"])
def test_rows_are_numbered_over_blocks_and_files(spark, folder, conf, block):
    """A file read in many blocks, part files of unequal size, an empty one, and other headers beside them."""
    conf(spark__sql__files__maxPartitionBytes=block, spark__sql__files__openCostInBytes="0")
    put(folder, "Long.csv", "Identifier,Actual Sales\r\n" + "".join(f"k{i},{i}\r\n" + "\r\n" * (i % 3 == 0) for i in range(400)))
    at = 0
    for part, size in enumerate((3, 0, 150, 1, 40)):
        put(folder, f"Parts.csv/part-{part:05d}.csv", "Identifier,Actual Sales,Targets\n" + "".join(f"p{at + i},{at + i},1\n" for i in range(size)))
        at += size
    put(folder, "Parts.csv/part-00009.csv", "")
    put(folder, "Odd.csv", "﻿Area,Remark\nnorth,\n")
    rows = sheets.numbered(sheets.read_rows(spark, folder))
    got = {(r.sheet, r.row): (r.fields[0], len(r.headers)) for r in rows.collect()}
    want = {("Long", i + 1): (f"k{i}", 2) for i in range(400)} | {("Parts", i + 1): (f"p{i}", 3) for i in range(at)} | {("Odd", 1): ("north", 2)}
    assert got == want
    assert sheets.read_rows(spark, folder).select("path", "block").distinct().count() > (15 if block == "100" else 0)


@pytest.mark.parametrize("block", ["64", "134217728"])
def test_cells_of_rows_are_those_of_sheets(spark, folder, conf, block):
    conf(spark__sql__files__maxPartitionBytes=block, spark__sql__files__openCostInBytes="0")
    put(folder, "A+b 1.csv", "Identifier,Actual Sales\nx,\"1,000\"\n,2\nz,\n")
    put(folder, "T.csv", "Identifier,Actual Sales,Targets\nx,1,2\ny,,3\n")
    put(folder, "U.csv", "Identifier,Target,Actual Sales\nx,1,2\n")
    put(folder, "W.csv", "Week,Metric,Value\nWeek1,Current Year,\n")
    put(folder, "M.csv", "Identifier/Label,Metric,Excel Value\na,Target,5\n,,\n")
    put(folder, "Y.csv", "Label,Previous Year,Current Year\nJan,1,2\nFeb\n")
    put(folder, "E.csv", "Identifier,Sales\nme,7\n")
    put(folder, "N.csv", "Area,Remark\nnorth,?\n")
    names = ["sheet", "identifier", "metric", "value_raw"]
    for zero in (False, True):
        for every in (False, True):
            old = exports.cells_of(spark, exports.read_sheets(spark, folder), zero, every).select(names)
            new = sheets.cells_of_rows(sheets.read_rows(spark, folder), zero, every).select(names)
            assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))
            assert (new.where("sheet = 'N'").count() == 1) == every
    shapes = {r.sheet: r for r in sheets.sheet_shapes(sheets.read_rows(spark, folder)).collect()}
    assert all(shapes[r.sheet] == r for r in exports.sheet_shapes(spark, folder).collect())


def test_headers_take_one_job(spark, folder):
    for i in range(30):
        put(folder, f"S{i}.csv", f"Identifier,{'Sales' if i % 2 else 'Actual Sales'}\na,{i}\n")
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    try:
        groups = exports.header_groups(spark, folder)
        jobs = len(context.statusTracker().getJobIdsForGroup("headers"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(len, groups.values())) == [15, 15] and jobs <= 4


def test_parquet_sheets(spark, folder):
    """Columns by each file's footer, values as text, rows in their order."""
    spark.range(50).selectExpr("concat('k', id) Identifier", "id * 1.5 `Actual Sales`").coalesce(1).write.parquet(f"{folder}/A.parquet")
    spark.range(3).selectExpr("concat('w', id) Week", "'m' Metric", "id Value").coalesce(1).write.parquet(f"{folder}/B.parquet")
    put(folder, "C.csv", "Identifier,Actual Sales\nx,1\n")
    cells = exports.read_cells(spark, folder)
    assert {(r.sheet, r.n) for r in cells.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).collect()} == {("A", 50), ("B", 3), ("C", 1)}
    rows = sheets.numbered(sheets.read_rows(spark, folder, "*.parquet", "parquet")).orderBy("sheet", "row").collect()
    assert [r.fields for r in rows[:2]] == [["k0", "0.0"], ["k1", "1.5"]] and rows[-1].headers == ["Week", "Metric", "Value"]
    assert [r.row for r in rows] == [*range(1, 51), 1, 2, 3]


def test_last_cell_wins_by_file_and_row(spark, folder):
    """Within a file the later row, among files the one changed last, also if it arrives earlier."""
    db = spark.createDataFrame([("S", "a", "Actual Sales", "3")], "sheet string, identifier string, metric string, value string")
    out, log = scratch(spark, "out"), scratch(spark, "log")

    def run():
        cells = arrivals.stream_sheets(spark, folder, "d*/*.csv", places=True)
        arrivals.reconcile_latest(cells, db, out, log).awaitTermination()
        return {(r.identifier, r.excel_value, r.status) for r in arrivals.read_latest(spark, out).collect()}

    put(folder, "d1/S.csv", "Identifier,Actual Sales\na,1\nb,5\na,2\n", 2000)
    assert run() == {("a", "2.00", "Mismatch"), ("b", "5.00", "Mismatch")}
    put(folder, "d2/S.csv", "Identifier,Actual Sales\na,3\n", 3000)
    assert run() == {("a", "3.00", "Match"), ("b", "5.00", "Mismatch")}
    put(folder, "d3/S.csv", "Identifier,Actual Sales\na,9\nb,6\n", 1000)  # late
    assert run() == {("a", "3.00", "Match"), ("b", "5.00", "Mismatch")}
    assert run() == {("a", "3.00", "Match"), ("b", "5.00", "Mismatch")}
    batch = sheets.last_cells(sheets.cells_of_rows(sheets.read_rows(spark, folder, "d*/*.csv")))
    assert {(r.identifier, r.value_raw) for r in batch.collect()} == {("a", "3"), ("b", "5")}


def test_state_is_combined_before_it_moves(spark, folder):
    put(folder, "S.csv", "Identifier,Actual Sales\na,1\n")
    plan = sheets.last_cells(sheets.cells_of_rows(sheets.read_rows(spark, folder)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "PythonUDF" not in plan


def test_plan_does_not_grow_with_sheets(spark):
    """Three sheets or five hundred: the same joins."""
    def size(n):
        table = spark.range(n).select(F.concat(F.lit("Top Stores "), "id").alias("sheet"), F.lit("Q").alias("sp_name"),
                                      F.lit("store_sales").alias("output_pattern"))
        results = {"Q": spark.createDataFrame([("a", 1.0), ("b", 2.0)], "Identifier string, `Actual Sales` double")}
        mapping = comparisons.Mapping(table, results)
        export = spark.range(n).select(F.concat(F.lit("Top Stores "), "id").alias("sheet"), F.col("id").alias("row_ord"),
                                       F.lit("a").alias("identifier"), F.lit("1").alias("Actual Sales"))
        db = comparisons.query_cells(mapping)
        out = comparisons.reconcile.reconcile_wide(comparisons.routed(export, mapping), db, ["Actual Sales"], "query")
        assert out.where("`Actual Sales Status` = 'Match'").count() == n
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in text and db.count() == 2
        return len(text.splitlines())

    assert size(3) == size(500)


def test_scores_need_no_pairs(spark):
    shapes = spark.range(500).select(F.concat(F.lit("Top Stores by Sal "), "id").alias("sheet"),
                                     F.array(F.lit("identifier"), F.lit("actual sales")).alias("headers"), F.lit(1).alias("data_volume"))
    table = match.match_sheets(shapes, [(0, "SP_TopStoresbySales", "store_sales", 5, ["Identifier", "Actual Sales"])])
    assert table.count() == 500 and "Join" not in table._jdf.queryExecution().executedPlan().toString()
