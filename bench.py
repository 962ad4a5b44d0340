"""Times the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import time

from ablata.plans.queries import QUERIES
from ablata.session import build

#: One or two of each operator family.
HEADLINE = ("marginal_corr", "marginal_job", "row_dedup", "unique_columns", "incidence_wide", "gram_matrix", "feature_corr", "stratified_sample", "balanced_sample", "running_quota", "rank_features", "confusion_matrix", "roc_auc", "spearman_rank", "coef_summary", "silhouette", "embedding_corr", "ridge_fit", "ridge_job", "elastic_net_fit")


def main() -> None:
    """Runs each query once, first start included."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
