"""Headline queries on the tables at $BENCH_SF_DIR; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (3); the median
counts. What a query writes (a stream's tables, an export) is part of its time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from telemill import configure_session
from telemill.plans.ingest import ingest_batch
from telemill.plans.store import store_batch
from telemill.session import scratch_dir
from workloads import fixtures as fx
from workloads.queries import QUERIES, stored_events

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "split_envelopes_items",
    "validated_items",
    "route_by_type",
    "type_checks",
    "many_types",
    "rejected_by_reason",
    "batch_report",
    "scan_where",
    "summarize_count",
    "time_range_scan",
    "rows_as_json",
    "csv_round_trip",
    "segments_aligned",
    "segments_anchored",
    "lint_definitions_verdicts",
    "schema_drift",
    "stream_report",
]


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    run()
    times = []
    for _ in range(RUNS):
        started = time.monotonic()
        run()
        times.append(time.monotonic() - started)
    return round(statistics.median(times), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure_session(spark)
    seconds: dict[str, float] = {}

    # Bodies as they arrive: text files, one body per line.
    bodies = scratch_dir(spark, "bench-bodies")
    fx.event_bodies(spark, SF_DIR).select("batch_id", "body", "ingest_time").repartition(16).write.parquet(bodies)
    arrived = spark.read.parquet(bodies)

    seconds["ingest_check"] = timed(lambda: consume(ingest_batch(arrived, [fx.USER_EVENT]).checked))
    seconds["ingest_store"] = timed(
        lambda: store_batch(arrived, [fx.USER_EVENT], scratch_dir(spark, "bench-store"), "one")
    )
    stored_events(spark, SF_DIR)
    for name in HEADLINE:
        seconds[name] = timed(lambda name=name: consume(QUERIES[name](spark, SF_DIR)))
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
