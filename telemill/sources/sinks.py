"""Writing tables, schema files and interchange CSV; closing segments."""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from telemill.definitions import INGEST_TIME, ItemDefinition, kind_of
from telemill.functions.checks import value_to_text
from telemill.operators.lint import OK, detect_schema_drift, read_sidecars
from telemill.operators.segments import aligned_window, assign_aligned, segment_name
from telemill.session import path_exists, quoted, read_text, remove_path, write_text
from telemill.sources import snapshots
from telemill.sources.catalog import TableEntry
from telemill.sources.tables import (
    CSV_OPTIONS,
    DATE,
    LOAD,
    SEGMENT,
    UNTIL,
    SchemaDriftError,
    csv_path,
    scan_parquet,
    sidecar_path,
    table_path,
)

TARGET_FILE_BYTES = 256 * 1024 * 1024


def prepare_tables(spark: SparkSession, root: str, definitions: Iterable[ItemDefinition]) -> None:
    """Write the schema files, or raise before anything is written.

    A type that is already stored must have the same columns.
    """
    definitions = list(definitions)
    if not definitions:
        return
    columns = "array<struct<name:string,type:string>>"
    declared = spark.createDataFrame(
        [(d.name, [(c.name, c.kind) for c in d.columns]) for d in definitions], f"type_name string, columns {columns}"
    )
    paths = {d.name: sidecar_path(root, d.folder, d.name) for d in definitions}
    texts = [(name, read_text(spark, path)) for name, path in paths.items() if path_exists(spark, path)]
    if texts:
        stored = read_sidecars(spark.createDataFrame(texts, "declared_as string, sidecar string")).select(
            F.col("declared_as").alias("type_name"), "columns", "problem"
        )
        drifted = detect_schema_drift(declared, stored).where(F.col("verdict") != OK).collect()
        if drifted:
            raise SchemaDriftError("; ".join(f"{row.type_name}: {row.detail}" for row in drifted))
    stored_texts = dict(texts)
    for d in definitions:
        _check_names(c.name for c in d.columns)
        if stored_texts.get(d.name) != d.sidecar():
            write_text(spark, paths[d.name], d.sidecar())


def _check_names(names: Iterable[str]) -> None:
    taken = sorted({DATE, LOAD, SEGMENT, UNTIL}.intersection(names))
    if taken:
        raise ValueError(f"reserved column names: {', '.join(taken)}")


def _filters(columns: Collection[str]) -> dict[str, str]:
    """Bloom filters on key columns: a row group that cannot hold a key that is asked for is not read."""
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    return {**options, "parquet.bloom.filter.adaptive.enabled": "true"} if options else {}


def write_table(
    rows: DataFrame,
    root: str,
    definition: ItemDefinition,
    load: str,
    rebalance: bool = False,
    key_columns: Collection[str] = (),
) -> str:
    """Store typed rows of one type under a load of their own; returns the folder.

    Writing the same load again replaces it, so a repeated run adds nothing
    twice: the new rows go to another folder, and one entry of the table's log puts them in place of the old.
    Rows are written where they are, without a shuffle, and the first and last
    ingest time are noted as they pass; ``rebalance`` trades a shuffle for evenly sized files (a large day is split, small ones joined).
    ``key_columns`` get Bloom filters, for queries that look for single values of them.
    """
    _check_names(rows.columns)
    spark, path = rows.sparkSession, table_path(root, definition.folder, definition.name)
    snapshots.begin(spark, path, f"{LOAD}=")
    folder = f"{LOAD}={load}"
    if path_exists(spark, f"{path}/{folder}"):
        folder += f"~{uuid.uuid4().hex[:8]}"
    seen = Observation()
    zone = [F.min(INGEST_TIME).cast("string").alias("first"), F.max(INGEST_TIME).cast("string").alias("last")]
    dated = rows.withColumn(DATE, F.to_date(INGEST_TIME)).observe(seen, *zone)
    if rebalance:
        dated = dated.hint("rebalance", F.col(DATE))
    dated.write.mode("overwrite").partitionBy(DATE).options(**_filters(key_columns)).parquet(f"{path}/{folder}")
    files = snapshots.folder_files(spark, path, folder, (seen.get["first"], seen.get["last"]))
    snapshots.commit_loads(spark, path, {load: {"folder": folder, "files": files}})
    return f"{path}/{folder}"


def write_loads(rows: DataFrame, root: str, definition: ItemDefinition, load: Column) -> list[str]:
    """Store rows as many loads at once, by the load that ``load`` gives each; returns their names.

    For history that is brought in as a whole: one job, and one entry in the table's log, after which all of
    them are there. Each load becomes few files, and a large one is split.
    """
    _check_names(rows.columns)
    spark, path = rows.sparkSession, table_path(root, definition.folder, definition.name)
    snapshots.begin(spark, path, f"{LOAD}=")
    folder = f"{LOAD}=many-{uuid.uuid4().hex}"
    placed = rows.withColumn(DATE, F.to_date(INGEST_TIME)).withColumn(LOAD, load.cast("string"))
    placed.hint("rebalance", F.col(LOAD)).write.partitionBy(LOAD, DATE).parquet(f"{path}/{folder}")
    files = snapshots.measured_files(spark, path, folder, LOAD)
    loads = {name: {"folder": own[0][0].rsplit("/", 2)[0], "files": own} for name, own in files.items()}
    if loads:
        snapshots.commit_loads(spark, path, loads)
    return sorted(loads)


def to_csv_cells(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[value_to_text(kind_of(f) or _plain_kind(f), quoted(f.name)).alias(f.name) for f in rows.schema.fields]
    )


def _plain_kind(field) -> str | None:
    return "datetime" if field.dataType.typeName().startswith("timestamp") else None


def write_csv(rows: DataFrame, root: str, definition: ItemDefinition, load: str = "export") -> str:
    """Export rows as header-less CSV, one folder per segment named by its first row.

    Writing the same load again replaces it. Below its name a segment says when its window
    ends, so a period scan knows what it can hold. Rows are brought together by segment, and
    large segments split, before they are written.
    """
    _check_names(rows.columns)
    path = f"{csv_path(root, definition.folder, definition.name)}/{LOAD}={load}"
    minutes = definition.segment_minutes
    named = assign_aligned(rows, minutes).withColumnRenamed("segment", SEGMENT)
    ends = aligned_window(F.col(INGEST_TIME), F.lit(minutes)) + F.make_dt_interval(mins=F.lit(minutes))
    named = named.withColumn(UNTIL, segment_name(ends)).select(*[quoted(c) for c in rows.columns], SEGMENT, UNTIL)
    cells = to_csv_cells(named).hint("rebalance", F.col(SEGMENT))
    cells.write.mode("overwrite").partitionBy(SEGMENT, UNTIL).options(
        header="false",
        quote='"',
        escape='"',
        lineSep=CSV_OPTIONS["lineSep"],
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)
    return path


def stream_load(stream: str, identity: str, epoch: int) -> str:
    """Load of one epoch of a stream; ``identity`` is that of its checkpoint."""
    return f"stream-{stream}-{identity}-{epoch:012d}"


_STREAM_LOAD = re.compile(r"\A(stream-.*-[0-9a-f]{32})-([0-9]{12})\Z", re.DOTALL)


def is_closed(spark: SparkSession, path: str, load: str) -> bool:
    """Whether the rows of a stream's load are in a closed segment already."""
    found, state = _STREAM_LOAD.match(load), snapshots.snapshot(spark, path)
    return found is not None and state is not None and int(found[2]) in state["epochs"].get(found[1], [])


def _epochs(loads: Iterable[str]) -> dict[str, list[int]]:
    # An epoch whose rows were closed before the stream could commit it is
    # repeated after a restart; it must not be stored a second time.
    epochs: dict[str, list[int]] = {}
    for found in filter(None, map(_STREAM_LOAD.match, loads)):
        epochs.setdefault(found[1], []).append(int(found[2]))
    return epochs


def close_segment(
    spark: SparkSession,
    root: str,
    definition: ItemDefinition,
    leave: Collection[str] = (),
    keep_seconds: float = snapshots.KEEP_SECONDS,
    key_columns: Collection[str] = (),
) -> str | None:
    """Rotate: turn everything a type has in open loads into one closed segment.

    Rows are ordered by ingest time and spread over as many files as their size asks for. One entry of the
    table's log puts the segment in the place of the loads: whoever reads a snapshot sees either these or that. Loads named in ``leave``
    stay open. If two close a table at once, the one whose entry comes first wins, and the other one's segment is discarded. Replaced loads
    are removed ``keep_seconds`` later, by the next closing or ``clean_table``. ``key_columns`` get Bloom filters. Returns the name of the
    closed load, or None if there was nothing to close.
    """
    path = table_path(root, definition.folder, definition.name)
    snapshots.clean(spark, path, keep_seconds)
    state = snapshots.snapshot(spark, path)
    if state is None:
        if not path_exists(spark, path):
            return None
        snapshots.begin(spark, path, f"{LOAD}=")
        state = snapshots.snapshot(spark, path)
    loads = {k: v for k, v in state["loads"].items() if not k.startswith("closed-") and k not in leave}
    files = [f for load in loads.values() for f in load["files"]]
    rows = snapshots.read_files(spark, path, [f[0] for f in files], definition.stored_schema)
    firsts = [f[2] for f in files]
    known = firsts and all(x is not None for x in firsts)
    earliest = F.lit(min(firsts)).cast("timestamp_ntz") if known else F.min(INGEST_TIME)
    source = spark.range(1).select(segment_name(earliest)) if known else rows.agg(segment_name(earliest))
    first = source.first()[0] if files else None
    if first is None:
        return None
    parts = max(1, -(-sum(f[1] for f in files) // TARGET_FILE_BYTES))
    spread = F.xxhash64(*[quoted(name) for name, _ in definition.stored_columns])
    ordered = rows.repartitionByRange(parts, F.col(INGEST_TIME), spread).sortWithinPartitions(INGEST_TIME)
    closed = f"closed-{first}-{uuid.uuid4().hex[:8]}"
    folder = f"{LOAD}={closed}"
    dated = ordered.withColumn(DATE, F.to_date(INGEST_TIME))
    dated.write.partitionBy(DATE).options(**_filters(key_columns)).parquet(f"{path}/{folder}")
    segment = {"folder": folder, "files": snapshots.measured_files(spark, path, folder).get("", [])}
    if not snapshots.commit_loads(spark, path, {closed: segment}, loads, _epochs(loads)):
        remove_path(spark, f"{path}/{folder}")
        return None
    return closed


def clean_table(
    spark: SparkSession, root: str, definition: ItemDefinition, keep_seconds: float = snapshots.KEEP_SECONDS
) -> list[str]:
    """Remove folders that were replaced or closed ``keep_seconds`` ago or earlier; returns them."""
    return snapshots.clean(spark, table_path(root, definition.folder, definition.name), keep_seconds)


def scan_definition(spark: SparkSession, root: str, definition: ItemDefinition) -> DataFrame:
    """Rows of a type whose definition is at hand (no catalog lookup)."""
    entry = TableEntry(definition.name, definition.folder, root, tuple(definition.stored_columns))
    return scan_parquet(spark, entry)
