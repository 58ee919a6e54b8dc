"""Times the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores. Every query runs twice over its
whole result (the noop sink); the second run counts, as the first also compiles.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodeframe import more_queries, queries

HEADLINE = [
    "join_chain_4way", "join_chain_6way", "join_left_bracketed", "join_left_anti", "agg_group", "agg_count_distinct", "agg_first_last", "agg_having_expr", "scan_filter_cmp",
    "filter_ne_two_valued", "project_arith_div_zero", "order_expr_unprojected", "sub_scalar_corr_count", "sub_not_in", "sub_exists", "sub_multilevel", "sub_derived_join", "text_cte",
    "text_scalar_block", "money_sum", "cursor_start_after", "lookup_enrich",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    assert more_queries
    took = {}
    for name in HEADLINE:
        run = queries.queries()[name]
        for _ in range(2):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
