"""Headline timings: one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Stage tables are built once and timed as their own entries; every
other entry times one full run of a registered query into a discarding sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rttscope.plans import load_catalog  # noqa: E402
from rttscope.session import session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "f5_instant_metrics", "g6_usage", "g2_rtt_baseline", "label_counts", "w1_rolling", "w6_gap_flag",
    "final_dataset", "g15_slice_metrics", "g19_gain", "d12_reference", "d6_feature_block", "g22_drift_slices",
    "d11_report", "j13_late_labels", "m11_verdict", "k6_probe_choice", "k4_quota_anchors", "v4_future_leak",
    "t1_scored_flows", "m3_grid_naive_bayes", "m3_grid_tree",
)
STAGES = ("classes", "instants", "baseline", "candidates")


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # JVM start is not a query
    stages = catalog.stages(spark, SF_DIR)
    for name in STAGES:
        timed(f"stage_{name}", lambda name=name: getattr(stages, name))
    for name in QUERIES:
        timed(name, lambda name=name: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
