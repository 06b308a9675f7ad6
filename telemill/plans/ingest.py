"""Batch ingestion: bodies to typed tables, quarantine and accounts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.definitions import INGEST_TIME, ItemDefinition
from telemill.operators.accounts import batch_report, write_ledger
from telemill.operators.envelopes import split_envelopes
from telemill.operators.validation import check_items, is_accepted, rejected_rows, typed_rows
from telemill.session import configure_session, remove_path, scratch_dir


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(sep=" ", timespec="milliseconds")[:23]


def stamp(bodies: DataFrame, ingest_time: str | None = None) -> DataFrame:
    """One UTC millisecond ingest time per batch.

    A column ``ingest_time`` of the batches is used as it is, cut to
    milliseconds; otherwise ``ingest_time`` (text), or the time of this call, so
    that all results of one run agree. A stream takes the time of each trigger.
    """
    if INGEST_TIME in bodies.columns:
        time = F.col(INGEST_TIME).cast("timestamp_ntz")
    elif ingest_time is None and bodies.isStreaming:
        time = F.current_timestamp().cast("timestamp_ntz")
    else:
        time = F.lit(ingest_time or utc_now()).cast("timestamp_ntz")
    return bodies.withColumn(INGEST_TIME, F.date_trunc("MILLISECOND", time).cast("timestamp_ntz"))


@dataclass(frozen=True)
class IngestResult:
    """Everything that one ingest run yields, as lazy DataFrames."""

    checked: DataFrame
    definitions: tuple[ItemDefinition, ...]
    staged_at: str | None = None

    def accepted(self, type_name: str, keep: Iterable[str] = ()) -> DataFrame:
        definition = next(d for d in self.definitions if d.name == type_name)
        return typed_rows(self.checked, definition, keep)

    @property
    def rejected(self) -> DataFrame:
        return rejected_rows(self.checked)

    @property
    def report(self) -> DataFrame:
        return batch_report(self.checked)

    @property
    def ledger(self) -> DataFrame:
        return write_ledger(self.checked, self.definitions)

    def staged(self) -> IngestResult:
        """The same result over a written copy, split by route and verdict.

        Bodies are then parsed and checked once, and each later step reads only
        the rows and columns it needs: a table its own items, the report no
        payload at all.
        """
        spark = self.checked.sparkSession
        path = scratch_dir(spark, "checked")
        judged = self.checked.withColumn("accepted", is_accepted())
        judged.write.partitionBy("route", "accepted").parquet(path)
        schema = judged.schema
        staged = spark.read.schema(schema).parquet(path)
        return IngestResult(staged.select(*judged.columns), self.definitions, path)

    def release(self) -> None:
        """Remove the written copy of a staged result."""
        if self.staged_at is not None:
            remove_path(self.checked.sparkSession, self.staged_at)


def ingest_batch(
    bodies: DataFrame, definitions: Iterable[ItemDefinition], ingest_time: str | None = None
) -> IngestResult:
    """Split, route and validate ``(batch_id, body)`` rows."""
    configure_session(bodies.sparkSession)
    definitions = tuple(definitions)
    return IngestResult(check_items(split_envelopes(stamp(bodies, ingest_time)), definitions), definitions)
