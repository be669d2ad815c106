"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from lakeops.plans import load_all  # noqa: E402
from lakeops.plans.layout_queries import RULES  # noqa: E402
from lakeops.sources.generate import generate_table  # noqa: E402

GENERATED = 20_000_000  # rows of the generator run, beside the headline queries

HEADLINE = """revenue_rollup_ranked agg_pricing_summary join_star_chain agg_cube agg_count_distinct top_k_per_group
window_running_total window_rank_dense window_lag_lead window_moving_average join_point_in_time join_interval_overlap
merge_upsert merge_composite_key scd_type2_merge history_as_of_version history_change_feed constraint_violation_counts
mask_rule_set flatten_json_explode messages_x12 generate_rule_table layout_z_order spatial_points_in_zones
spatial_nearest_site graph_degree graph_triangle_count graph_pagerank graph_connected_components recipe_time_report""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lakeops-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = load_all()
    queries["agg_pricing_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up cost
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    started = time.perf_counter()
    generate_table(spark, GENERATED, RULES).write.format("noop").mode("overwrite").save()
    rate = GENERATED / (time.perf_counter() - started) / int(cpus)
    line = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "generated_rows_per_sec_core": round(rate)}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
