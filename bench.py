"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from keelson.plans.queries import QUERIES
from keelson.session import local_session

HEADLINES = [
    "supplier_quality",
    "supplier_month_risk",
    "time_features",
    "recent_risk_articles",
    "deduplicated_articles",
    "top_articles",
    "identity_matches",
    "event_types",
    "risk_queue",
    "resolved_entities",
    "threshold_sweep",
    "probability_metrics",
    "reliability_curve",
    "class_metrics",
    "tfidf_weights",
    "calibrated_logistic",
    "near_duplicate_titles",
    "entity_evaluation",
    "risk_model_metrics",
    "tree_importances",
    "news_model_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
