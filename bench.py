"""Time the headline queries on the driver tables and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "standardized_market_state",
    "point_in_time_quality",
    "momentum_signal",
    "low_volatility_signal",
    "triple_barrier_label",
    "trend_scanning_label",
    "research_universe",
    "rank_cross_section",
    "rank_cross_section_range_split",
    "regression_neutralization",
    "rank_ic_summary",
    "quantile_turnover",
    "signal_decay_profile",
    "purged_kfold_split",
    "uniqueness_weights",
    "pairwise_redundancy",
    "composite_signal",
    "overlapping_portfolio_returns",
    "trade_costs_by_date",
    "target_weights_long_short",
    "walk_forward_fold_summary",
    "single_factor_workflow",
    "composite_workflow",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("panelyard-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from panelyard.catalog import registry

    from panelyard.functions.storage import release

    queries = registry.queries()
    queries["rank_ic_summary"](spark, sf_dir).collect()  # start the JVM and the code cache
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
