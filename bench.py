"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
Every query runs once to warm up and is then timed; results go to the no-op
sink, so the work is the query's and not the driver's.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession, functions as F

from voicegrid.operators.sentiment import predict_sentiment
from voicegrid.plans.catalog import QUERIES, _fitted
from voicegrid.sources.driver_tables import feedback

HEADLINES = (
    "canonical_reviews", "ingestion_stats", "quality_summary", "dataset_summary", "length_stats", "common_words",
    "aspect_summary", "dashboard_filtered", "sentiment_trend", "fastest_topic", "topic_summary", "topic_npmi",
    "term_statistics", "stratified_split", "overall_metrics", "findings", "topic_assignments",
)


def run(work) -> float:
    started = time.perf_counter()
    work().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voicegrid-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # The tables are one row group each, which a single task would read.
        .config("spark.voicegrid.inputPartitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        run(lambda: QUERIES[name](spark, folder))
        seconds[name] = round(run(lambda: QUERIES[name](spark, folder)), 3)
    started = time.perf_counter()
    model = _fitted(spark, folder)
    seconds["sentiment_training"] = round(time.perf_counter() - started, 3)
    reviews = feedback(spark, folder)
    rows, size = reviews.agg(F.count("*"), F.sum(F.octet_length("review_text"))).first()
    run(lambda: predict_sentiment(reviews, model))
    seconds["sentiment_scoring"] = round(run(lambda: predict_sentiment(reviews, model)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "scored_rows_per_second": round(rows / seconds["sentiment_scoring"], 1),
                "scored_mb_per_second": round(size / 1e6 / seconds["sentiment_scoring"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
