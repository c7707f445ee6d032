"""Headline queries, timed warm: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from salestally import Params, bind_folder, build_session, default_registry
from salestally.checks import CHECKS
from salestally.operators import kpis, reconcile, widgets
from salestally.plans import comparisons

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
P = Params(year=1997)


def drain(df) -> None:
    """Compute every row and column, keep none."""
    df.write.format("noop").mode("overwrite").save()


def queries(spark):
    model = bind_folder(spark, FOLDER)
    r = default_registry()

    def landing():
        db = comparisons.landing_values(r, model.cubed(P), P)
        export = db.withColumnRenamed("value", "value_raw").selectExpr(
            "sheet", "cast(0 as bigint) row_ord", "identifier", "metric", "value_raw")
        drain(reconcile.reconcile_long(export, db))

    return {
        "top_stores": lambda: drain(widgets.top_stores(model, P, 10)),
        "top_products": lambda: drain(widgets.top_products(model, P, 10)),
        "top_employees": lambda: drain(widgets.top_employees(model, P, 10)),
        "monthly_trend": lambda: drain(widgets.monthly_trend(model, P)),
        "weekly_trends": lambda: drain(widgets.weekly_trends(model, P)),
        "weekday_weekend": lambda: drain(widgets.weekday_weekend(model, P)),
        "brand_trend": lambda: drain(widgets.dimension_trend(model, P, "brand")),
        "product_detail": lambda: drain(widgets.product_detail(model, P)),
        "store_actual_vs_target": lambda: drain(widgets.store_actual_vs_target(model, P)),
        "kpi_set": lambda: drain(kpis.kpi_set(model, P)),
        "new_customers": lambda: drain(kpis.new_customers(model, P)),
        "reconcile_long": lambda: drain(CHECKS["reconcile_long_staff"](spark, FOLDER)),
        "reconcile_wide": lambda: drain(CHECKS["reconcile_wide_standard"](spark, FOLDER)),
        "reconcile_kpis": lambda: drain(CHECKS["reconcile_kpis"](spark, FOLDER)),
        "landing_comparison": landing,
        "mapping": lambda: drain(CHECKS["match_sheets"](spark, FOLDER)),
    }


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", int(CPUS),
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    only = set(sys.argv[1:])
    times = {}
    for name, run in queries(spark).items():
        if only and name not in only:
            continue
        run()
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "total_warm_median", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
