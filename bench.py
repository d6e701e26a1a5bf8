"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from gridlens.plans import catalog  # noqa: E402
from gridlens.session import build_session  # noqa: E402

HEADLINE = (
    "paired_contrast_itt", "paired_contrast_by_model", "factorial_terms", "additive_residuals", "fe_ols_length",
    "condition_table", "plan_grid", "schedule_order", "matched_pairs", "side_assignment", "attempt_state",
    "rolling_throughput", "cell_state_machine", "stale_judgments", "dedup_norm_text", "idf_table", "tfidf_recall",
    "fact_coverage", "hard_features", "exclude_prior", "recovered_sections", "contrast_plan_analysis",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="16g")
    # One small query starts the Python workers and compiles common code before anything is timed.
    catalog.QUERIES["normalized_text"](spark, folder).limit(1).collect()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
