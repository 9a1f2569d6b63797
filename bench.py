"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from coldgraph.plans.catalog import QUERIES
from coldgraph.session import local_session

HEADLINE = [
    "cold_classification",
    "normalize_edges",
    "degrees",
    "cold_split",
    "laplacian_entries",
    "cooccurrence_degrees",
    "cooccurrence_sums",
    "cooccurrence_weights",
    "spectral_moments",
    "spectral_map_coords",
    "spectral_embedding",
    "knn_features",
    "knn_partitioned",
    "neighbor_quality",
    "propagate",
    "sage_mean",
    "neighbor_vote",
    "assign_clusters",
    "negative_samples",
    "topology_scores",
    "link_auc",
    "spectral_link_auc",
    "recommend_links",
    "cold_sweep_spectral",
    "window_degrees",
    "stream_embed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    # start the Python workers and compile common code before the first timed query
    QUERIES["cold_classification"](spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")).count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
