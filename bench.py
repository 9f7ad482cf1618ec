"""Wall seconds of the headline queries; prints one JSON line, and each query's seconds to stderr as it ends.

Results go to Spark's no-op sink, so every row is computed and nothing is collected.
``BENCH_QUERIES`` (comma list, or ``all``) replaces the selection. A query that takes more than ``BENCH_LIMIT`` seconds (240) is
cancelled and counts with that time; it is named under ``"stopped"``, as one that fails is.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinlens.session import local_session  # noqa: E402
from twinlens.workload import QUERIES  # noqa: E402

HEADLINE = [
    "entry_centroid_report",
    "smp_stratified_split",
    "smp_three_way",
    "met_auroc_binary",
    "met_auroc_ovr",
    "met_roc_points",
    "agg_quantile",
    "agg_dedupe_first",
    "agg_pivot_multi",
    "flt_min_class_support",
    "jn_paired_predictions",
    "jn_manifest_week",
    "num_quantile_bins",
    "txt_task_prompt",
    "prs_strict",
    "emb_dual_encode",
    "bst_metric_ci",
    "bst_paired_difference",
    "fus_linear",
    "fus_mlp_late",
    "fus_moe",
    "ml_knn",
    "rpt_performance_ci",
    "rpt_pareto_frontier",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not wanted else sorted(QUERIES) if wanted == "all" else wanted.split(",")
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    # starts the workers and loads classes, so that the first query is not charged for it
    spark.read.parquet(f"{sf}/region.parquet").mapInArrow(lambda it: it, "r_regionkey int, r_name string").count()
    limit = float(os.environ.get("BENCH_LIMIT", "240"))
    times: dict[str, float] = {}
    stopped: list[str] = []
    for name in names:
        begin = time.perf_counter()
        late = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
        late.start()
        try:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the other queries' times still count
            stopped.append(name)
            print(f"{name}: {str(error)[:200]}", file=sys.stderr, flush=True)
        finally:
            late.cancel()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    result = {"metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
    print(json.dumps(result | ({"stopped": stopped} if stopped else {})))


if __name__ == "__main__":
    main()
