"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data
and cores. Each query is run to completion into the no-op sink, after one untimed
warm-up query; the best of BENCH_RUNS (default 2) runs counts.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "smart_persistence_skill", "recipe_50_features", "feature_table_wide", "rsm_10min_bins", "grd_10min_grid", "win_rolling",
    "jn_asof_tolerance", "jn_asof_on_grid", "jn_interval_aggregate", "jn_nearest_on_grid", "ddp_priority", "anc_rule_flags",
    "seg_ids", "win_runs", "qc_closure", "qc_cross_correlation", "qc_repair_diffuse", "imp_climatology", "agg_exact_quantiles",
    "met_per_horizon", "evl_cloud_regime", "sig_block_bootstrap", "cal_rolling_corrections", "spl_walk_forward_counts",
    "ml_analog_ensemble", "str_tumbling_bins",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from skycadence.session import build_session
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g", "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    from skycadence.plans.catalog import CATALOG
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    CATALOG["grd_10min_grid"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
