"""Stored tables: where they are, and reading them back.

``root/<folder>/<type>.json``                                    schema file
``root/<folder>/<type>/_snapshots/*.json``                        what the table consists of
``root/<folder>/<type>/__load=<id>/__date=<day>/*.parquet``      rows
``root/<folder>/<type>.csv/__load=<id>/__segment=<name>/__until=<end>/*.csv``  exported rows
``root/<folder>/<name>_<type>.csv`` (or without ``.csv``)        rows from elsewhere
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.definitions import INGEST_TIME, stored_schema
from telemill.functions.checks import value_from_text
from telemill.session import _path, configure_session, path_exists, quoted, readable
from telemill.sources import snapshots
from telemill.sources.catalog import TableEntry, discover_catalog, find_table

LOAD, DATE, SEGMENT, UNTIL = "__load", "__date", "__segment", "__until"
CSV_OPTIONS = {"header": "false", "quote": '"', "escape": '"', "lineSep": "\n", "multiLine": "true"}
_SEGMENT_TIME = "%Y-%m-%d_%H-%M-%S.%f"


class SchemaDriftError(ValueError):
    """Stored data does not have the columns that are asked of it."""


def table_path(root: str, folder: str, type_name: str) -> str:
    return f"{root.rstrip('/')}/{folder}/{type_name}"


def sidecar_path(root: str, folder: str, type_name: str) -> str:
    return f"{table_path(root, folder, type_name)}.json"


def csv_path(root: str, folder: str, type_name: str) -> str:
    return f"{table_path(root, folder, type_name)}.csv"


def _period(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(INGEST_TIME) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(INGEST_TIME) < F.lit(end).cast("timestamp_ntz"))
    return df


def _zone_time(text: str | None) -> str | None:
    """A time in the form that zones have: as Spark shows it, without trailing zeros."""
    if text is None:
        return None
    try:
        shown = str(datetime.fromisoformat(text).replace(tzinfo=None))
    except ValueError:
        return None  # in another form that Spark may know: rows are filtered, no file is passed over
    return shown.rstrip("0") if "." in shown else shown


def scan_parquet(spark: SparkSession, entry: TableEntry, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the newest snapshot; of a period only the files whose zone meets it are opened, and nothing is listed."""
    schema = stored_schema(list(entry.columns))
    path = table_path(entry.root, entry.folder, entry.type_name)
    state = snapshots.snapshot(spark, path)
    if state is not None:
        files = [f for load in state["loads"].values() for f in load["files"]]
        names = snapshots.in_period(files, _zone_time(start), _zone_time(end))
        return _period(snapshots.read_files(spark, path, names, schema), start, end)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    # Written without snapshots: whole days are dropped by their folder, the rest by row-group statistics.
    placed = T.StructType([*schema.fields, T.StructField(LOAD, T.StringType()), T.StructField(DATE, T.DateType())])
    rows = spark.read.schema(placed).parquet(readable(path))
    if start is not None:
        rows = rows.where(F.col(DATE) >= F.to_date(F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        rows = rows.where(F.col(DATE) <= F.to_date(F.lit(end).cast("timestamp_ntz")))
    return _period(rows, start, end).select(*[quoted(f.name) for f in schema.fields])


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _path(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(p) or []]


@dataclass(frozen=True)
class CsvSegment:
    """A folder or file of exported rows; ``until`` is where its window ends, None if nobody wrote that down."""

    name: str
    path: str
    until: str | None = None


def csv_segments(spark: SparkSession, entry: TableEntry) -> list[CsvSegment]:
    """A type's CSV segments in the order of their names."""
    base, name = readable(f"{entry.root}/{entry.folder}"), readable(entry.type_name)
    flat = _glob(spark, f"{base}/*_{name}.csv") + _glob(spark, f"{base}/*_{name}")
    found = []
    for p in flat:
        end = "_" + entry.type_name + (".csv" if p.endswith(".csv") else "")
        found.append(CsvSegment(p.rsplit("/", 1)[1][: -len(end)], p))
    exported = readable(csv_path(entry.root, entry.folder, entry.type_name))
    for p in _glob(spark, f"{exported}/{LOAD}=*/{SEGMENT}=*/{UNTIL}=*"):
        name, until = (part.split("=", 1)[1] for part in p.rsplit("/", 2)[1:])
        found.append(CsvSegment(name, p, until))
    return sorted(found, key=lambda s: (s.name, s.path))


def _segment_time(name: str | None) -> datetime | None:
    try:
        return datetime.strptime(name, _SEGMENT_TIME) if name else None
    except ValueError:
        return None


def segments_in_period(
    segments: list[CsvSegment], start: str | None, end: str | None, skew_seconds: float | None = None
) -> list[CsvSegment]:
    """Segments that can hold rows of ``[start, end)``; the rows are filtered exactly afterwards.

    An exported segment holds rows from its first one's time, its name, up to the end of its window. A file from elsewhere is
    only known to begin at its name; it is taken to be late by up to ``skew_seconds`` and to go on without end,
    or, if ``skew_seconds`` is given, no further than that beyond the next file's name. A
    name that holds no time rules nothing out.
    """
    slack = timedelta(seconds=60.0 if skew_seconds is None else skew_seconds)
    lo = datetime.fromisoformat(start) if start is not None else None
    hi = datetime.fromisoformat(end) if end is not None else None
    foreign = sorted(t for t in (_segment_time(s.name) for s in segments if s.until is None) if t is not None)
    kept = []
    for segment in segments:
        first, last = _segment_time(segment.name), _segment_time(segment.until)
        if first is not None and segment.until is None:
            following = bisect_right(foreign, first)
            if skew_seconds is not None and following < len(foreign):
                last = foreign[following] + slack
            first -= slack
        too_early = lo is not None and last is not None and last < lo
        too_late = hi is not None and first is not None and first >= hi
        if not too_early and not too_late:
            kept.append(segment)
    return kept


def scan_csv(
    spark: SparkSession,
    entry: TableEntry,
    start: str | None = None,
    end: str | None = None,
    skew_seconds: float | None = None,
) -> DataFrame:
    schema = stored_schema(list(entry.columns))
    segments = segments_in_period(csv_segments(spark, entry), start, end, skew_seconds)
    if not segments:
        return spark.createDataFrame([], schema)
    cells = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(cells).options(**CSV_OPTIONS).csv([readable(s.path) for s in segments])
    typed = raw.select(
        *[
            value_from_text(kind, quoted(name)).alias(name, metadata=schema[name].metadata)
            for name, kind in entry.columns
        ]
    )
    return _period(typed, start, end)


def scan_table(
    spark: SparkSession, root: str, type_name: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """All rows of a stored type, ``ingest_time`` and declared columns in order.

    Needs nothing but the storage: a type whose definition is gone still reads.
    With ``start`` and ``end`` only files that can hold rows of ``[start, end)``
    are read.
    """
    return scan_entry(spark, find_table(discover_catalog(spark, root), type_name), start, end)


def scan_entry(spark: SparkSession, entry: TableEntry, start: str | None = None, end: str | None = None) -> DataFrame:
    configure_session(spark)
    rows = scan_parquet(spark, entry, start, end)
    if csv_segments(spark, entry):
        rows = rows.unionByName(scan_csv(spark, entry, start, end))
    return rows


def scan_roots(
    spark: SparkSession, roots: list[str], type_name: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One type across several roots, files and object stores alike."""
    entries = [find_table(discover_catalog(spark, root), type_name) for root in roots]
    for other in entries[1:]:
        if other.columns != entries[0].columns:
            raise SchemaDriftError(f"{type_name} has different columns in {entries[0].root} and {other.root}")
    result = scan_entry(spark, entries[0], start, end)
    for other in entries[1:]:
        result = result.unionByName(scan_entry(spark, other, start, end))
    return result
