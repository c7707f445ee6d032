"""Files in, files out, files that arrive."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from salestally.operators import reconcile
from salestally.plans import sinks
from salestally.session import scratch, work_dir
from salestally.sources import exports
from salestally.streaming import arrivals


def put(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def new_folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_sheets_of_all_layouts(spark):
    folder = new_folder()
    put(folder, "Sales Summary_A+b 1.csv", "Identifier,Actual Sales\nx,\"1,000\"\n,2\nz,\n")
    put(folder, "Sales Summary_T.csv", "Identifier,Actual Sales,Targets\nx,1,2\ny,,3\n")
    put(folder, "Sales Summary_W.csv", "Week,Metric,Value\nWeek1,Current Year,\n")
    put(folder, "Sales Summary_M.csv", "Identifier/Label,Metric,Excel Value\na,Target,5\n")
    put(folder, "Sales Summary_Y.csv", "Label,Previous Year,Current Year\nJan,1,2\n")
    put(folder, "Sales Summary_Empty.csv", "")
    put(folder, "Unfit.csv", "Identifier,Actual Sales\nq,1\n")
    cells = exports.read_cells(spark, folder, "Sales Summary_*")
    got = {(r.sheet, r.identifier, r.metric, r.value_raw) for r in cells.collect()}
    assert got == {
        ("Sales Summary_A+b 1", "x", "Actual Sales", "1,000"), ("Sales Summary_A+b 1", "Unknown", "Actual Sales", "2"),
        ("Sales Summary_T", "x", "Actual Sales", "1"), ("Sales Summary_T", "x", "Target", "2"),
        ("Sales Summary_T", "y", "Target", "3"), ("Sales Summary_W", "Week1", "Current Year", None),
        ("Sales Summary_M", "a", "Target", "5"), ("Sales Summary_Y", "Jan", "Previous Year", "1"),
        ("Sales Summary_Y", "Jan", "Current Year", "2"),
    }
    zeros = exports.read_cells(spark, folder, "Sales Summary_[AW]*", null_as_zero=True)
    assert {r.value_raw for r in zeros.filter("identifier in ('z', 'Week1')").collect()} == {"0"}
    shapes = {r.sheet: (r.data_volume, r.n_columns) for r in exports.sheet_shapes(spark, folder, "Sales Summary_*").collect()}
    assert shapes["Sales Summary_A+b 1"] == (3, 2) and shapes["Sales Summary_T"] == (2, 3)
    files = exports.export_files(spark, folder)
    assert files.filter("sheet = 'Sales Summary_Empty'").count() == 0 and files.count() == 5


def test_row_order_is_kept(spark):
    folder = new_folder()
    put(folder, "S.csv", "Identifier,Actual Sales\n" + "".join(f"k,{i}\n" for i in range(50)))
    cells = exports.read_cells(spark, folder)
    last = reconcile.last_wins(cells, ["sheet", "identifier"], "value_raw", "row_ord").first()
    assert last.value_raw == "49"


def test_newest_and_new(spark):
    folder = new_folder()
    for i, name in enumerate(["a.csv", "b.csv", "kpis.csv"]):
        put(folder, name, "x\n1\n")
        os.utime(os.path.join(folder, name), (1000 + i, 1000 + i))
    files = exports.export_files(spark, folder, "*")
    assert exports.newest(files).first().sheet == "kpis"
    fresh = exports.new_files(files, files.filter("sheet = 'a'"))
    assert [r.sheet for r in fresh.collect()] == ["b"]


def test_samples_skip_empty_rows(spark):
    rows = spark.createDataFrame(
        [("S", i, None if i == 1 else str(i), None) for i in range(10)],
        "sheet string, row_ord bigint, Identifier string, Sales string")
    got = exports.sample_rows(rows, ["Identifier", "Sales"]).orderBy("row_ord").collect()
    assert [r["sample"]["identifier"] for r in got] == ["0", "2", "3"]


def test_config(spark):
    folder = new_folder()
    put(folder, "c.json", json.dumps({"a": {"x": "1"}}))
    table = exports.config_table(spark, exports.load_config(f"{folder}/c.json")["a"], "name", "id")
    assert table.collect() == [("x", "1")]


def test_report_per_sheet(spark):
    path = scratch(spark, "by-sheet")
    df = spark.createDataFrame([("a" * 40, 1), ("b", 2)], "sheet string, v int")
    sinks.write_by_sheet(df, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("title=")) == ["title=" + "a" * 31, "title=b"]
    assert spark.read.parquet(path).count() == 2


def test_arrivals_once_each(spark):
    db = spark.createDataFrame([("S", "a", "Actual Sales", "1")], "sheet string, identifier string, metric string, value string")
    drop, out, log = new_folder(), scratch(spark, "out"), scratch(spark, "log")

    def run():
        arrivals.reconcile_arrivals(arrivals.stream_sheets(spark, drop, "*"), db, out, log).awaitTermination()
        return arrivals.read_arrivals(spark, out).count()

    put(drop, "S.csv", "Identifier,Actual Sales\na,1\nb,2\n")
    assert run() == 2
    put(drop, "T.csv", "Identifier,Actual Sales\na,1\n")
    assert run() == 3 and run() == 3
    assert arrivals.read_arrivals(spark, out, "summary").agg(F.sum("total")).first()[0] == 3


def test_work_folder_is_the_clusters():
    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://shared/work"})

    assert work_dir(Session) == "hdfs://shared/work"
    assert scratch(Session, "a").startswith("hdfs://shared/work/a-")
