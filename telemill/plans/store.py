"""Storing everything an ingest run yields: tables, quarantine and accounts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.definitions import INGEST_TIME, ItemDefinition
from telemill.operators.accounts import (
    ACCOUNT_TYPES,
    INGEST_EVENT,
    WRITER_ERROR,
    WRITER_FLUSH,
    flush_events,
    ingest_events,
)
from telemill.operators.validation import is_accepted
from telemill.plans.ingest import IngestResult, ingest_batch
from telemill.sources.sinks import prepare_tables, write_table

QUARANTINE = "_quarantine"
LEDGER = "_ledger"
PARALLEL_WRITES = 8  # types stored at the same time, so that a slow one holds up no other

# Stores the rows of one type under a load; None if they are stored already.
Put = Callable[[DataFrame, ItemDefinition], "str | None"]


def store_result(result: IngestResult, root: str, load: str, instance: str, put: Put | None = None) -> None:
    """Write accepted rows per type, rejected rows, and the accounts of both.

    ``result.checked`` is read once per defined type that has rows, so it should
    be staged or persisted. Every write replaces the same load of an earlier try.
    """
    started = time.monotonic()
    put = put or (lambda rows, definition: write_table(rows, root, definition, load))
    spark = result.checked.sparkSession
    by_name = {d.name: d for d in result.definitions}
    counts = (
        result.checked.where(is_accepted())
        .groupBy("route")
        .agg(F.count("*").alias("rows"), F.max(INGEST_TIME).alias(INGEST_TIME))
        .collect()  # one row per defined type
    )


    def store(row) -> tuple:
        try:
            return row, put(result.accepted(row.route), by_name[row.route]), None
        except Exception as cause:  # noqa: BLE001 - raised below, once every other type is stored
            when = row[INGEST_TIME]
            record_failure(spark, root, row.route, cause, f"{load}-{row.route}-{time.time_ns()}", when, instance)
            return row, None, cause

    flushed, failed = [], []
    with ThreadPoolExecutor(max_workers=PARALLEL_WRITES) as pool:
        for row, path, cause in pool.map(store, counts):
            if cause is not None:
                failed.append(cause)
            elif path is not None:
                flushed.append((row[INGEST_TIME], row.route, path, row.rows))
    if failed:
        raise failed[0]
    result.ledger.write.mode("overwrite").parquet(f"{root}/{LEDGER}/load={load}")
    result.rejected.write.mode("overwrite").parquet(f"{root}/{QUARANTINE}/load={load}")
    if flushed:
        schema = f"{INGEST_TIME} timestamp_ntz, type_name string, output string, rows bigint"
        put(flush_events(spark.createDataFrame(flushed, schema), instance), WRITER_FLUSH)
    elapsed = F.lit(int((time.monotonic() - started) * 1000))
    put(ingest_events(result.report, instance, elapsed), INGEST_EVENT)


def record_failure(spark, root: str, type_name: str, cause: Exception, load: str, when, instance: str) -> None:
    """Failed writes are an item type too; the failure itself is raised by the caller."""
    columns = "instanceName string, itemType string, operation string, errorMsg string"
    rows = spark.createDataFrame([(instance, type_name, "flush", str(cause))], columns)
    rows = rows.select(F.lit(when).cast("timestamp_ntz").alias(INGEST_TIME), "*")
    write_table(rows, root, WRITER_ERROR, load)


def read_ledger(spark, root: str) -> DataFrame:
    """Rows per type and segment of every load: ``(type_name, segment, rows_written, last_write, load)``."""
    return spark.read.parquet(f"{root}/{LEDGER}")


def store_batch(
    bodies: DataFrame,
    definitions: Iterable[ItemDefinition],
    root: str,
    load: str,
    ingest_time: str | None = None,
    instance: str = "telemill",
) -> None:
    """Ingest ``(batch_id, body)`` rows into the tables under ``root``."""
    definitions = list(definitions)
    prepare_tables(bodies.sparkSession, root, [*definitions, *ACCOUNT_TYPES])
    result = ingest_batch(bodies, definitions, ingest_time).staged()
    try:
        store_result(result, root, load, instance)
    finally:
        result.release()


def read_quarantine(spark, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{QUARANTINE}").drop("load")
