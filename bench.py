"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.registry import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "price_snapshot", "mod_price", "mod_arrival", "sma", "ema", "drawdown", "describe", "outliers", "resample_week", "panel", "asof_join", "nearest_asof",
    "change_by_horizon", "shifted_target", "correlation_matrix", "spearman_pairs", "rolling_corr", "lag_correlogram", "ccf_diff", "elasticity_lags", "thresholds",
    "pair_spread", "benchmark_ratio", "seasonal_index", "decompose_classical", "adf", "kpss", "granger", "johansen", "driver_ols", "merged_header", "parse_long",
    "clean_cells", "validate_report", "score_composite", "sentiment", "features", "similar_periods", "backtest_metrics", "backtest_suppliers", "forecast",
    "stream_daily_totals", "parse_workbook", "insights", "leadership", "rolling_metrics",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    QUERIES["price_snapshot"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM and the code cache
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
