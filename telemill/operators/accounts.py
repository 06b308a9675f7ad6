"""Accounts of what went in and what came out, and their own item types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.definitions import INGEST_TIME, Column, ItemDefinition
from telemill.operators.envelopes import BODY_ERROR, EMPTY_BODY, ITEM, SPLIT_ERROR
from telemill.operators.segments import aligned_window
from telemill.operators.validation import is_accepted

# The accounts are items too, so they are stored, scanned and
# queried like any other type.
INGEST_EVENT = ItemDefinition(
    "ingest-event",
    (
        Column("instanceName", "string"),
        Column("requestId", "string", optional=True),
        Column("itemsIn", "int"),
        Column("ingested", "int"),
        Column("rejected", "int"),
        Column("statusCode", "int"),
        Column("durationMs", "int"),
    ),
    folder="ingest-accounts",
    latency_minutes=5,
    documentation="One item per ingested batch.",
)
WRITER_FLUSH = ItemDefinition(
    "writer-flush",
    (
        Column("instanceName", "string"),
        Column("itemType", "string"),
        Column("output", "string", optional=True),
        Column("itemsFlushed", "int"),
    ),
    folder="writer-accounts",
    latency_minutes=5,
    documentation="One item per successful write to a table.",
)
WRITER_ERROR = ItemDefinition(
    "writer-error",
    (
        Column("instanceName", "string"),
        Column("itemType", "string"),
        Column("operation", "string"),
        Column("errorMsg", "string"),
    ),
    folder="writer-accounts",
    latency_minutes=5,
    documentation="One item per failed write to a table.",
)
ACCOUNT_TYPES = (INGEST_EVENT, WRITER_FLUSH, WRITER_ERROR)


def batch_report(checked: DataFrame) -> DataFrame:
    """Counts and status per batch.

    A body that is no array counts no items but one rejection; an empty one
    counts nothing; both, and a body in which nothing could be parsed, have
    status 400. Every body has at least one row in ``checked``, so no join is
    needed to keep the empty ones, and counts are combined before the shuffle.
    """
    sums = checked.groupBy("batch_id").agg(
        F.max(INGEST_TIME).alias(INGEST_TIME),
        F.count_if(F.col("kind") == ITEM).alias("__items"),
        F.count_if(F.col("kind") == SPLIT_ERROR).alias("__split_errors"),
        F.count_if(F.col("kind") == BODY_ERROR).alias("__body_errors"),
        F.count_if(F.col("kind") == EMPTY_BODY).alias("__empty"),
        F.count_if(is_accepted()).alias("ingested"),
        F.count_if(F.size("errors") > 0).alias("rejected"),
    )
    reason = (
        F.when(F.col("__body_errors") > 0, F.lit("not a JSON array"))
        .when(F.col("__empty") > 0, F.lit("empty input array"))
        .when(F.col("__items") == 0, F.lit("no valid items"))
    )
    return sums.select(
        "batch_id",
        INGEST_TIME,
        (F.col("__items") + F.col("__split_errors")).alias("items_in"),
        "ingested",
        "rejected",
        F.when(F.col("__items") > 0, F.lit(200)).otherwise(F.lit(400)).alias("status"),
        reason.alias("reason"),
    )


def write_ledger(checked: DataFrame, definitions: Iterable[ItemDefinition]) -> DataFrame:
    """Rows per type and aligned segment, and the time of the last one."""
    minutes = {d.name: d.segment_minutes for d in definitions}
    if not minutes:
        width = F.lit(1)
    else:
        width = F.create_map(*[F.lit(x) for pair in minutes.items() for x in pair])[F.col("route")]
    accepted = checked.where(is_accepted())
    return (
        accepted.groupBy(F.col("route").alias("type_name"), aligned_window(F.col(INGEST_TIME), width).alias("segment"))
        .agg(F.count("*").alias("rows_written"), F.max(INGEST_TIME).alias("last_write"))
    )


def ingest_events(report: DataFrame, instance: str, duration_ms: SparkColumn) -> DataFrame:
    """A batch report as rows of ``ingest-event``."""
    return report.select(
        INGEST_TIME,
        F.lit(instance).alias("instanceName"),
        F.col("batch_id").cast("string").alias("requestId"),
        F.col("items_in").alias("itemsIn"),
        "ingested",
        "rejected",
        F.col("status").cast("bigint").alias("statusCode"),
        duration_ms.cast("bigint").alias("durationMs"),
    )


def flush_events(flushes: DataFrame, instance: str) -> DataFrame:
    """``(ingest_time, type_name, output, rows)`` as rows of ``writer-flush``."""
    return flushes.select(
        INGEST_TIME,
        F.lit(instance).alias("instanceName"),
        F.col("type_name").alias("itemType"),
        "output",
        F.col("rows").cast("bigint").alias("itemsFlushed"),
    )
