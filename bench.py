"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  directory of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from tessera.plans.catalogue import QUERIES
from tessera.session import build_session

HEADLINE = [
    "q01_structure",
    "q01_numeric_summary",
    "q02_top_levels",
    "q03_key_check_subscriptions",
    "q04_multiplicity",
    "q05_missing_pattern",
    "q06_subscriber_event_overlap",
    "q07_campaign_event_overlap",
    "q07_key_presence",
    "q08_clean_addresses",
    "q09_drop_constant_columns",
    "q09_level_dominance",
    "q10_customer_snapshot",
    "q11_clean_accounts",
    "q12_last_code_distribution",
    "q13_last_year_distribution",
    "q14_region_distribution",
    "q15_privacy_1_distribution",
    "q16_bucketed_providers",
    "q17_job_distribution",
    "q20_day_types",
    "q21_email_funnel",
    "q22_campaign_overview",
    "q23_open_rate",
    "q24_open_rate_by_type",
    "q25_stacked_open_share",
    "q26_days_to_open",
    "q27_days_to_open_curve",
    "q28_opens_per_customer",
    "q29_direction_shares",
    "q30_hour_share_by_event_type",
    "q30_hour_share_by_direction",
    "q31_department_share",
    "q32_day_type_share",
    "q33_purchases_per_customer",
    "q34_amounts_per_ticket",
    "q35_amounts_per_customer",
    "q36_article_popularity",
    "q37_gross_histogram",
    "q38_next_purchase_curve",
    "q39_rfm_table",
    "q40_rfm_segments",
    "q41_segment_counts",
    "q42_segment_medians",
    "q43_monetary_heatmap",
    "q44_churn_labels",
    "q45_split_sizes",
    "q46_tree_predictions",
    "q46_forest_predictions",
    "q46_logistic_predictions",
    "q46_logistic_coefficients",
    "q46_model_accuracy",
    "q46_score_table",
    "q46_complexity_table",
    "q46_separated_terms",
    "q47_confusion_matrix",
    "q48_gain_lift_by_frequency",
    "q48_model_gain_lift",
    "q49_auc",
    "q49_model_auc",
    "q50_baskets",
    "q51_association_rules",
    "q51_article_rules",
    "q51_triple_rules",
    "q52_top_rules",
    "q53_item_frequency",
]


def seconds(run, spark, directory: str) -> float:
    started = time.perf_counter()
    run(spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    # one local machine: the folder that a cluster would name is a temporary one here
    checkpoints = tempfile.mkdtemp(prefix="tessera-bench-")
    spark = build_session(
        "tessera-bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": checkpoints,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        seconds(QUERIES[name], spark, directory)
        taken = [seconds(QUERIES[name], spark, directory) for _ in range(runs)]
        timings[name] = round(statistics.median(taken), 3)
        print(f"{timings[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total of median wall-clock seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
