"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from propspark.catalog.registry import QUERIES  # noqa: E402
from propspark.session import get_spark  # noqa: E402

HEADLINE = (
    "dedup_mean", "dedup_prefer", "dedup_median", "preferred_rows", "lookup_join", "harvested", "combined_table", "pattern_classifier",
    "standardized_keys", "substructure_bits", "path_bits_documents", "text_profile", "histogram", "percentile_cutoff", "tanimoto_documents",
    "multi_block_texts", "nearest_all_vectors", "dual_ad_summary", "random_folds", "group_folds", "time_splits", "error_metrics", "spearman",
    "kendall", "evaluation", "model_comparison", "random_forest", "nested_cv",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = get_spark("propspark-bench", f"local[{cpus}]", int(cpus))
    spark.read.parquet(f"{root}/nation.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
