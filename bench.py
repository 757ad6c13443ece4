"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pointloom.plans.catalog import QUERIES
from pointloom.session import local_session

HEADLINE = (
    "voxel_stats", "voxel_downsample", "cov_eigen3", "shape_classes", "topk_per_class", "mutual_topk", "compat_graph_pyramid",
    "max_clique", "kabsch_sums", "yaw_fit", "otsu_threshold", "tls_sweep", "nn_verify", "eval_rollup", "runs_gaps_islands",
    "ground_planes", "plane_regions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
