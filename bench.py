"""Benchmark of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every
query is timed from plan building to its last row, after one small query has
started the Python workers.
"""

from __future__ import annotations

import json
import os
import time

from probewise.plans import catalog
from probewise.session import local_session

HEADLINE = (
    "j1_topk_exact",
    "j2_topk_blocked",
    "j3_ivf_search",
    "j4_pq_search",
    "j5_rescore",
    "j8_score_pairs",
    "d6_summarize_search",
    "v5_validate_vectors",
    "v8_combine_views",
    "a3_rate_curve",
    "a5_equal_error_rate",
    "a9_verification_summary",
    "a11_kfold_summary",
    "b1_topk_overlap",
    "b4_identification_report",
    "b5_latency_summary",
    "p5_quality_gate",
    "p8_nms",
    "g1_gallery_stats",
    "g5_collapse_duplicates",
    "g9_build_plan",
    "g15_split_per_identity",
    "e3_throttle",
    "e6_stabilize_labels",
)


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "j1_topk_exact", folder)
    times = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    probes = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    result = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "exact_probes_per_sec": round(probes / times["j1_topk_exact"], 1),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
