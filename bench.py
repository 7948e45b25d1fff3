"""Wall seconds of the headline queries: python bench.py  (BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES, BENCH_REPEAT)."""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = (
    "experiment_report", "paired_bootstrap", "risk_coverage", "nearest_rank", "verdicts", "claim_pairs", "bm25_index", "bm25_rank",
    "selected_pages", "contexts", "text_chunks", "near_tokens", "page_similarity", "scorecard", "line_layout", "located_answers",
    "run_diagnosis", "reusable_answers", "files_with_conversations", "telemetry_stream")


def spread(spark, sf_dir: str, parts: int) -> str:
    """The tables with ``documents`` in several files, as large tables are; the given one is a single row group, which one task reads."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(os.path.join(os.path.abspath(sf_dir), name), os.path.join(folder, name))
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "20g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             # The work per row is heavy: keep enough tasks after each shuffle.
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from lectern.plans.catalog import QUERIES

    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    name_of_sf = os.path.basename(sf_dir.rstrip("/"))
    sf_dir = spread(spark, sf_dir, 2 * int(cpus))
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": name_of_sf}))
    spark.stop()


if __name__ == "__main__":
    main()
