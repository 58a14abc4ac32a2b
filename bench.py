"""Wall-clock bench of the headline queries.

Runs each query twice in one session (first run: cold, with code generation
and file listing; second: warm) on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Every result is fully
computed through the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kernelspark.plans.flagship import flagship  # noqa: E402
from kernelspark.plans.registry import QUERIES  # noqa: E402
from kernelspark.session import local_session  # noqa: E402

HEADLINE = [
    "signed_rows", "scoring", "gram_lineitem", "gram_embeddings", "tsqr_r", "apply_qt",
    "truncated_svd_values", "row_positions", "random_permutation", "train_test_split",
    "assign_clusters", "lloyd_step", "rank_allocation", "svm_fixed_iterations",
    "svm_newton", "svm_fit_documents", "kmeans_fit", "nystrom_features", "meka_features", "kth_smallest", "apply_q", "label_lines",
    "reflector_products", "pivoted_rank", "top_svd", "kmeans_parallel", "feistel_permutation", "kernel_links", "tiled_gram",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus != "*" else 16)
    times: dict[str, float] = {}
    t0 = time.time()
    run(spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1))   # JVM warm-up, not timed
    warm: dict[str, float] = {}
    todo = {name: QUERIES[name] for name in only or HEADLINE if name in QUERIES}
    if not only or "flagship_newton" in only:
        todo["flagship_newton"] = lambda s, d: flagship(s, d, solver="newton", max_iter=50, tol=1e-9)
    for seen in (times, warm):
        for name, query in todo.items():
            t = time.time()
            run(query(spark, sf_dir))
            seen[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "warm": warm,
                      "warm_total": round(sum(warm.values()), 3), "sf": sf,
                      "elapsed": round(time.time() - t0, 3), "cpus": cpus}))


if __name__ == "__main__":
    main()
