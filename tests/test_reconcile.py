"""Reconciliations: what is changed is what is reported."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from salestally import Params, default_registry
from salestally.operators import kpis, reconcile, report, reshape
from salestally.plans import comparisons, sinks
from salestally.session import scratch
from salestally.sources import registry as reg

EXPORT = "sheet string, row_ord bigint, identifier string, metric string, value_raw string"
DB = "sheet string, identifier string, metric string, value string"


def tables(spark, n=60):
    db = [("S", f"id{i}", "Actual Sales", f"{i}.50") for i in range(n)]
    export = [(s, i, k, m, v) for i, (s, k, m, v) in enumerate(db)]
    return export, db


def statuses(spark, export, db, **options):
    out = reconcile.reconcile_long(
        spark.createDataFrame(export, EXPORT), spark.createDataFrame(db, DB), **options)
    return {r.row_ord: r.status for r in out.collect()}


def test_itself(spark):
    export, db = tables(spark)
    assert set(statuses(spark, export, db).values()) == {"Match"}


@pytest.mark.parametrize("k", [1, 7])
def test_changed_rows(spark, k):
    export, db = tables(spark)
    changed = [(s, i, x, m, "0.01" if i < k else v) for s, i, x, m, v in export]
    out = statuses(spark, changed, db)
    assert {i for i, s in out.items() if s == "Mismatch"} == set(range(k))
    assert len(out) == len(export)


@pytest.mark.parametrize("k", [1, 9])
def test_dropped_rows(spark, k):
    export, db = tables(spark)
    out = statuses(spark, export, db[k:], missing_status="Not Found")
    assert {i for i, s in out.items() if s == "Not Found"} == set(range(k))


def test_repeated_export_rows_are_all_kept(spark):
    export, db = tables(spark, 5)
    many = [("S", i, "Unknown", "Actual Sales", "1") for i in range(40)]
    out = statuses(spark, export + [(s, i + 100, *r) for s, i, *r in many], db)
    assert len(out) == 45


def test_last_value_wins(spark):
    df = spark.createDataFrame([("a", "1", 0), ("a", "2", 2), ("a", "3", 1)], "k string, v string, o int")
    assert reconcile.last_wins(df, ["k"], "v", "o").collect() == [("a", "2")]


def test_first_hit_against_brute_force(spark):
    rng = random.Random(3)
    db = {f"k{i}": f"v{i}" for i in range(0, 40, 2)}
    rows = [(i, [f"k{rng.randrange(40)}" for _ in range(rng.randrange(5))]) for i in range(50)]
    left = spark.createDataFrame(rows, "i int, keys array<string>")
    right = spark.createDataFrame(list(db.items()), "key string, value string")
    out = {r.i: r.value for r in reconcile.first_hit(left, F.col("keys"), right, ["i"]).collect()}
    assert out == {i: next((db[k] for k in keys if k in db), None) for i, keys in rows}


def test_weekly_fallbacks_against_brute_force(spark):
    bases = ["WEEKDAY", "WEEKEND", "Week1"]
    ids = bases + [b + " SALES" for b in bases] + ["Other"]
    every = [(s, i) for s in ("Weekly Trends", "Sales Summary_Weekday Weekend") for i in ids]
    rng = random.Random(5)
    for _ in range(3):
        db = [(s, i, "Current Year", str(n)) for n, (s, i) in enumerate(rng.sample(every, 6))]
        known = {(s, i): v for s, i, _, v in db}
        export = [("Sheet", n, i, "Current Year", "-1") for n, i in enumerate(ids)]
        out = reconcile.reconcile_long(
            spark.createDataFrame(export, EXPORT), spark.createDataFrame(db, DB), weekly_fallbacks=True)
        got = {r.identifier: r.db_value for r in out.collect()}
        for i in ids:
            base = i.replace(" SALES", "")
            tries = [("Weekly Trends", i), ("Sales Summary_Weekday Weekend", i),
                     ("Weekly Trends", base), ("Weekly Trends", base + " SALES")]
            want = next((known[t] for t in tries if t in known), None)
            assert got[i] == (f"{want}.00" if want is not None else "Not Found")


def test_near_keys_against_brute_force(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    wanted = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(12)})
    db = spark.createDataFrame([("S", n, "Actual Sales", "1") for n in names], DB)
    missing = spark.createDataFrame([(w,) for w in wanted], "identifier string")
    out = {}
    for r in reconcile.near_keys(missing, db).collect():
        out.setdefault(r.identifier, []).append(r.near_key)
    for w in wanted:
        hits = sorted(k for k in (f"S - {n}" for n in names) if w in k)[:3]
        assert sorted(out.get(w, [])) == hits


def test_wide_statuses(spark):
    export = spark.createDataFrame(
        [("S", 0, "a", "1", "5"), ("S", 1, "b", "2", None), ("S", 2, "c", "3", "7")],
        "sheet string, row_ord bigint, identifier string, `Actual Sales` string, Target string")
    db = spark.createDataFrame(
        [("S", "a", "Actual Sales", "1.001"), ("S", "a", "Target", "6"), ("S", "b", "Actual Sales", "2")], DB)
    out = {r.identifier: r for r in reconcile.reconcile_wide(export, db, ["Actual Sales", "Target"]).collect()}
    assert out["a"]["Actual Sales Status"] == "Match" and out["a"]["Target Status"] == "Mismatch"
    assert out["b"]["Target Status"] == "Match" and out["b"]["compared"] is False
    assert out["c"]["Actual Sales Status"] == "Not Found" and out["c"]["DB Target"] == "Not Found"


def test_kpi_ladder(spark):
    export = spark.createDataFrame(
        [("Total Sales", "1"), ("Avg. Bill", "2"), ("X", "3"), ("Y", "4"), ("Z", "5")], "kpi_name string, value_raw string")
    db = spark.createDataFrame(
        [("total sales", "1"), ("Avg Bill", "No Result"), ("Y", "SP Not Found"), ("Z", "DB Error")],
        "kpi_name string, value string")
    out = reconcile.reconcile_kpis(export, db)
    assert {r.kpi_name: r.status for r in out.collect()} == {
        "Total Sales": "Match", "Avg. Bill": "Mismatch", "X": "No SP Mapping", "Y": "SP Missing", "Z": "DB Error"}
    total = report.kpi_summary(out).first()
    assert (total.total, total.matches, total.mismatches, total.no_mapping, total.sp_errors) == (5, 1, 1, 1, 2)
    assert total.success_rate == "20.0%"
    assert report.kpi_summary(out.limit(0)).first().success_rate == "0%"


def test_status_counts_sum_to_total(spark):
    export, db = tables(spark)
    out = reconcile.reconcile_long(
        spark.createDataFrame(export, EXPORT), spark.createDataFrame(db[5:], DB), missing_status="Not Found")
    row = report.sheet_summary(out).first()
    assert row.matches + row.mismatches + row.not_found == row.total == 60


def test_key_sides(spark):
    export, db = tables(spark, 10)
    sides = reconcile.key_sides(
        spark.createDataFrame(export[:8] * 2, EXPORT), spark.createDataFrame(db[3:], DB))
    row = reconcile.key_side_counts(sides).first()
    assert (row.common, row.export_only, row.db_only) == (5, 3, 2)


def test_layouts(spark):
    assert reshape.layout_of(["Identifier", "Actual Sales", "Targets"]) == "target"
    assert reshape.layout_of(["Identifier", "Actual Sales"]) == "entity"
    assert reshape.layout_of(["Week", "Metric", "Value"]) == "week_metric"
    assert reshape.layout_of(["Label", "Previous Year", "Current Year"]) == "year"
    assert reshape.layout_of(["Foo"]) is None
    rows = spark.createDataFrame(
        [("S", 0, None, "1", None), ("S", 1, "b", None, "2")],
        "sheet string, row_ord bigint, Identifier string, `Actual Sales` string, Targets string")
    cells = {(r.identifier, r.metric): r.value_raw for r in reshape.sheet_cells(rows, "target").collect()}
    assert cells == {("Unknown", "Actual Sales"): "1", ("b", "Target"): "2"}


def test_landing_scalar_and_error(spark, model):
    r = default_registry()
    r.register("ONE", lambda m, p: kpis.kpi(m, p, "Total Sales"))
    r.register("NONE", lambda m, p: kpis.kpi(m, p, "Total Sales").limit(0))
    r.register("BAD", lambda m, p: m.orders.select("nothing"))
    out = comparisons.landing_values(
        r, model, Params(year=1997), {"A": "ONE", "B": "NONE", "C": "BAD", "D": "MISSING"})
    got = {row.sheet: row.value for row in out.collect()}
    assert got["B"] == "No Data" and got["C"] == got["D"] == "Error" and float(got["A"]) > 0


def test_failed_query_at_run_time_is_a_row(spark, model):
    r = default_registry()
    r.register("BAD", lambda m, p: m.orders.select(F.raise_error(F.lit("no")).alias("x")))
    found = reg.probe(r, model, Params(year=1997), ["SP_TopBrandsBySales", "BAD"])
    rows = {row.sp_name: row for row in found.table().collect()}
    assert rows["SP_TopBrandsBySales"].works and not rows["BAD"].works and rows["BAD"].error
    assert rows["SP_TopBrandsBySales"]["sample"]["BrandName"].startswith("Brand#")


def test_issue_report(spark):
    path = scratch(spark, "issues-test")
    when = datetime(2024, 1, 2, 3, 4, 5)
    sinks.append_issues(spark, path, [(1, "error", when, "c", "w", "t", "m", None)])
    sinks.append_issues(spark, path, [(2, "error", when, "d", "w", "t", "m", "p")])
    issues = spark.read.parquet(path)
    assert [r.seq for r in report.last_issues(issues, "error", 1).collect()] == [2]
    out = scratch(spark, "issues-report")
    sinks.write_issue_report(issues, out)
    printed = spark.read.parquet(f"{out}/errors").orderBy("seq").first()
    assert printed["Timestamp"] == "2024-01-02 03:04:05" and printed["Screenshot Path"] == ""
    assert {(r.part, r.n) for r in spark.read.parquet(f"{out}/summary").collect()} == {("total", 2), ("component", 1)}


def test_runs(spark):
    path = scratch(spark, "runs-test")
    for i, status in enumerate(["completed", "failed", "completed"]):
        sinks.append_run(spark, path, str(i), "kpi", status)
    out = {r.status: r.n for r in report.run_counts(spark.read.parquet(path)).collect()}
    assert out == {"completed": 2, "failed": 1}


def test_missing_columns(spark):
    df = spark.createDataFrame([("a", "1")], "Identifier string, `Previous Year` string")
    assert report.missing_columns(df, "weekly_trends") == ["Current Year"]
    assert list(itertools.chain(report.missing_columns(df, "store_sales"))) == ["Actual Sales"]
