"""Headline queries, timed one by one in a warm session; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

HEADLINE = [
    "marginal_cross", "nway_marginals", "recode_overlapping_range", "kron_weighted", "workload_answers", "workload_tables", "recode_catalog",
    "coarsest_cover_segment", "path_closure", "surrogate_rank", "hierarchical_join", "constraints_to_zero_cells", "zero_mask",
    "marginalised_measurement", "common_coarsening", "own_estimate", "bottom_up", "top_down", "entity_variance", "ci_alphas", "fuse_two_runs",
    "top_down_2cell", "gls_signature", "entity_covariance",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from stemtally.plans import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("stemtally-bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stemtally-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()

    def run(name: str) -> float:
        t = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - t, 3)

    for warm in ("ci_alphas", "top_down_2cell"):
        run(warm)
    took = {name: run(name) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
