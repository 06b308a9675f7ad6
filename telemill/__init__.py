"""Schema-governed telemetry tables on Spark."""

from telemill.definitions import Column, ItemDefinition
from telemill.operators.envelopes import pack_bodies, split_envelopes, wrap_rows
from telemill.plans.ingest import IngestResult, ingest_batch
from telemill.plans.query import Table, open_table, rows_as_json
from telemill.plans.store import store_batch
from telemill.session import clear_scratch, configure_session
from telemill.sources.batches import read_batches, stream_batches
from telemill.sources.catalog import discover_catalog, discover_catalog_lenient, list_tables
from telemill.sources.sinks import clean_table, close_segment, prepare_tables, write_csv, write_loads, write_table
from telemill.sources.tables import scan_roots, scan_table
from telemill.streaming.ingest import StreamIngest, StreamRotation
from telemill.streaming.items import ItemLimit
from telemill.streaming.registry import Registry, load_definitions

__all__ = [
    "Column",
    "IngestResult",
    "ItemDefinition",
    "ItemLimit",
    "Registry",
    "StreamIngest",
    "StreamRotation",
    "Table",
    "clear_scratch",
    "clean_table",
    "close_segment",
    "configure_session",
    "discover_catalog",
    "discover_catalog_lenient",
    "ingest_batch",
    "list_tables",
    "load_definitions",
    "open_table",
    "pack_bodies",
    "prepare_tables",
    "read_batches",
    "rows_as_json",
    "scan_roots",
    "scan_table",
    "split_envelopes",
    "store_batch",
    "stream_batches",
    "wrap_rows",
    "write_csv",
    "write_loads",
    "write_table",
]
