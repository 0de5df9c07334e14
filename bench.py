"""Wall seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. BENCH_QUERIES, a comma-separated list of registered names, replaces the headline
set; ``all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import FEATURES, QUERIES, TARGETS, USERS, _users  # noqa: E402
from gridpulse.operators import forecast  # noqa: E402
from gridpulse.session import configure  # noqa: E402



def linear_fit_60x3(spark, sf_dir):
    """The full-size fit; the registered one is small enough for SQL."""
    model = forecast.linear_fit(_users(spark, sf_dir), USERS, FEATURES, TARGETS, train_on="all")
    return spark.createDataFrame([(model.num_params(),)], "num_params long")


RUNS = {**QUERIES, "g2_linear_fit": linear_fit_60x3}

HEADLINE = [
    "b5_clean_usage",
    "b7_profile",
    "c1_rollup_machine_lines",
    "c3_top_machines",
    "c5_resample_mean",
    "c6_fit_minmax",
    "e4_row_position_lines",
    "e7_split_chronological",
    "e8_prepare",
    "g1_moving_average",
    "g2_linear_fit",
    "g11_forecast_upload",
    "h7_evaluate_all",
    "h8_evaluate_lines",
    "j1_machine_overview_lines",
    "j4_machine_forecast",
    "j9_utilization_series",
    "j15_upload_machines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["b7_profile"](spark, sf_dir).collect()  # start the JVM's machinery once
    seconds = {}
    for name in names:
        start = time.perf_counter()
        RUNS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall seconds of the queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
