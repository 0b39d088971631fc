"""Times the headline queries on local[$BENCH_CPUS] and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_change_days", "e1_max_price_per_cell", "t1_sale_filter_events", "t1_sale_filter_sparse",
    "t2_t4_causal_grid_events", "e15_daily_store_rates", "e21_threshold_sensitivity", "e23_boundary_summary",
    "b1_price_text_to_number", "b6_health_summary", "f23_row_features", "t6_sale_window_sensitivity",
    "r4_rolling_origins", "r8_rule_summary", "h8_h9_subset_evaluation", "h17_policies", "l1_exact_matches", "a5_a7_a8_load_stores", "h25_block_summary",
)


def main() -> None:
    from shelfline.plans import all_queries
    from shelfline.session import build_session, clear_scratch

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()   # start the executors
    queries, times = all_queries(), {}
    for name in (sys.argv[1:] or HEADLINE):
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        clear_scratch(spark)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
