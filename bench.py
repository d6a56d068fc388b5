"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans import registry  # noqa: E402

HEADLINE = [
    "q1_shipped_count", "q2_shipped_clerks", "q3_shipped_parts", "q4_shipped_by_nation", "q5_monthly_shipments", "q6_pricing_summary", "q7_unshipped_orders",
    "word_count", "follower_count", "bigram_frequency_pairs", "pmi_pairs_all_lines", "pmi_stripes", "inverted_index", "boolean_retrieval",
    "personalized_pagerank", "global_pagerank", "weak_components", "train_classifier", "apply_classifier", "ensemble_vote", "hourly_counts", "trend_alerts",
]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    registry.QUERIES["q1_shipped_count"](spark, d).collect()
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(d).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
