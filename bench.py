"""Time the headline queries and print one JSON line.

Each query runs once to warm up the session and once for the figure; results go to a
sink that computes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans.queries import QUERIES

HEADLINE = (
    "hash_split",
    "split_counts",
    "weighted_interleave",
    "epoch_mix",
    "build_vocab",
    "tokenize",
    "exact_dedup",
    "near_dedup",
    "pack_sequences",
    "packed_corpus",
    "val_loss",
    "choice_accuracy",
    "loss_ema",
    "throughput",
    "best_so_far",
)


def drain(df: DataFrame) -> None:
    """Compute every row."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        drain(QUERIES[name](spark, folder))
        start = time.perf_counter()
        drain(QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec",
        "queries": seconds, "sf": scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
