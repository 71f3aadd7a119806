"""Times the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from issuelens.catalog import QUERIES  # noqa: E402
from issuelens.session import get_session  # noqa: E402

HEADLINE = [
    "outcomes", "trailing_median", "frozen_rule", "similar", "token_subset_join", "token_overlap_join",
    "expanded_base", "priority_fill", "asof_horizon", "asof_index", "medians", "time_folds",
    "stratified_queue", "ratios", "forensic_flags", "rubric", "overall_score", "section_text",
    "keyword_retrieval", "objects", "gram", "impute_median", "upsert",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = get_session(int(cores), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cores)}))
    spark.stop()


if __name__ == "__main__":
    main()
