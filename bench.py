"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list),
BENCH_RUNS (default 1; the median is reported), BENCH_WARM (1 runs every query once before it is timed).
The session itself is warmed by one small query.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "speaker_counts", "sessionize_events", "turns_context", "split_sessions", "leakage_pairs", "length_distribution",
    "punctuation_rates", "top_bigrams", "catchphrases", "conditional_style", "latency_profile", "emoji_contexts",
    "merge_entities", "lexical_score", "evaluation_report", "memory_versions", "memory_retrieve", "bursts",
    "quote_target", "clean_messages",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from colloquy.queries import REGISTRY

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took = {}
    once("speaker_counts")
    for name in names:
        if os.environ.get("BENCH_WARM") == "1":
            once(name)
        took[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
