"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sightline.plans import catalog  # noqa: E402
from sightline.session import build_session  # noqa: E402

HEADLINE = (
    "det_00_scan_summary",
    "det_00_rule_scan",
    "det_05_sensitive_log_arguments",
    "det_22_cloud_access_key",
    "det_30_insecure_random",
    "det_41_indicator_report",
    "det_57_path_traversal",
    "jon_01_identity_match",
    "jon_03_dependency_correlation",
    "jon_04_version_ranges",
    "jon_06_patch_level_states",
    "jon_17_catalog_usage",
    "jon_19_module_reach",
    "jon_22_report_difference",
    "agg_02_policy_gate",
    "agg_07_coverage_matrix",
    "agg_09_timeline",
    "agg_25_label_metrics",
    "win_02_content_changes",
    "win_03_round_robin_modules",
    "src_04_lockfile_coordinates",
    "src_15_advisory_mentions",
    "cfg_05_outdated_targets",
    "snk_01_sarif_results",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{folder}/events.parquet").selectExpr("count(*)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
