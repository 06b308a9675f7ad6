"""The registered queries: each runs one or a few operators on whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import telemill
from telemill.definitions import Column as Field
from telemill.definitions import ItemDefinition
from telemill.functions.checks import format_datetime
from telemill.functions.timespan import format_timespan, parse_timespan, to_interval
from telemill.operators.accounts import INGEST_EVENT, WRITER_ERROR, WRITER_FLUSH
from telemill.operators.envelopes import envelopes, pack_bodies, split_envelopes, wrap_rows
from telemill.operators.lint import (
    dedupe_definitions,
    definition_columns,
    detect_schema_drift,
    lint_definitions,
    read_sidecars,
    sidecars,
)
from telemill.operators.validation import is_accepted
from telemill.operators.segments import assign_aligned, assign_anchored
from telemill.plans.ingest import ingest_batch
from telemill.plans.store import read_quarantine, store_batch
from telemill.session import configure_session, scratch_dir
from telemill.sources.catalog import find_table
from telemill.sources.sinks import prepare_tables, scan_definition
from telemill.sources.tables import scan_csv
from telemill.streaming.items import ItemLimit
from workloads import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure_session(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def measures(totals: DataFrame) -> DataFrame:
    """One row of totals as ``(measure, value)`` rows."""
    return totals.select(*[F.col(c).cast("bigint").alias(c) for c in totals.columns]).unpivot(
        [], totals.columns, "measure", "value"
    )


# --- shared inputs -----------------------------------------------------------

_STORED: dict[tuple[str, str], str] = {}


def stored_events(spark: SparkSession, sf_dir: str) -> str:
    """Root of tables into which all events were ingested; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = scratch_dir(spark, "events")
        store_batch(fx.event_bodies(spark, sf_dir), [fx.USER_EVENT], root, "first")
        _STORED[key] = root
    return _STORED[key]


def events_result(spark: SparkSession, sf_dir: str) -> telemill.IngestResult:
    return ingest_batch(fx.event_bodies(spark, sf_dir), [fx.USER_EVENT])


def mixed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, orders and customers in the same bodies, 60 items each."""
    third = lambda name, k: (F.col(name) * 3 + k).cast("bigint")
    orders = fx.table(spark, sf_dir, "orders")
    orders = orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "O", F.lit(True)).alias("open"),
    )
    customers = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    events = fx.faulty_events(fx.table(spark, sf_dir, "events")).withColumn("seq", third("seq", 0))
    items = events.unionByName(envelopes(orders, fx.ORDER.name, third("o_orderkey", 1))).unionByName(
        envelopes(customers, fx.CUSTOMER.name, third("c_custkey", 2))
    )
    return fx.with_ingest_time(pack_bodies(items, 60))


# --- splitting and validating ------------------------------------------------


@query
def read_batches(spark, sf_dir):
    """Bodies from text files, one per line, split back into items."""
    path = scratch_dir(spark, "bodies")
    fx.event_bodies(spark, sf_dir).select("body").write.text(path)
    items = split_envelopes(telemill.read_batches(spark, path)).where("kind = 'item'")
    sizes = items.groupBy("batch_id").agg(F.count("*").alias("items"))
    return sizes.groupBy("items").agg(F.count("*").alias("batches"))


@query
def read_batches_ids(spark, sf_dir):
    """Line numbers of bodies in files of lines, read with small splits and with large ones: each body has one id."""
    path = scratch_dir(spark, "bodies")
    bodies = fx.event_bodies(spark, sf_dir).select("body", "batch_id", F.pmod("batch_id", F.lit(4)).alias("file"))
    sorted_ = bodies.repartition(4, "file").sortWithinPartitions("batch_id").drop("batch_id")
    sorted_.write.partitionBy("file").text(path)
    size = "spark.sql.files.maxPartitionBytes"
    before, found = spark.conf.get(size), []
    try:
        for k, split in enumerate(("4096", before)):
            spark.conf.set(size, split)
            rows = telemill.read_batches(spark, path).select("batch_id", F.length("body").alias("size"))
            rows.write.parquet(f"{path}-{k}")
            found.append(spark.read.parquet(f"{path}-{k}"))
    finally:
        spark.conf.set(size, before)
    both = found[0].unionByName(found[1]).distinct()
    return both.select(
        F.regexp_extract("batch_id", "file=([0-9])/", 1).cast("bigint").alias("file"),
        F.regexp_extract("batch_id", ":([0-9]+)$", 1).cast("bigint").alias("line"),
    )


@query
def split_envelopes_items(spark, sf_dir):
    items = split_envelopes(fx.event_bodies(spark, sf_dir)).where("kind = 'item'")
    return items.select(
        "batch_id", "pos", "type_name", F.try_variant_get("data", "$.event_id", "bigint").alias("event_id")
    )


@query
def split_errors(spark, sf_dir):
    errors = split_envelopes(fx.event_bodies(spark, sf_dir)).where("kind = 'split_error'")
    return errors.select("batch_id", "pos", "code", "value")


@query
def wrap_round_trip(spark, sf_dir):
    """Wrapping rows and ingesting the bodies gives the rows back."""
    orders = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    bodies = fx.with_ingest_time(wrap_rows(orders, fx.ORDER.name, 100, F.col("o_orderkey")))
    return ingest_batch(bodies, [fx.ORDER]).accepted(fx.ORDER.name, ["batch_id", "pos"])


@query
def malformed_bodies(spark, sf_dir):
    """Bodies that are no arrays, empty, cut off, followed by junk, ..."""
    return ingest_batch(fx.malformed_bodies(spark, sf_dir), [fx.ORDER]).report.select(
        "batch_id", "items_in", "ingested", "rejected", "status", "reason"
    )


@query
def validated_items(spark, sf_dir):
    return events_result(spark, sf_dir).accepted(fx.USER_EVENT.name, ["batch_id", "pos"])


@query
def type_checks(spark, sf_dir):
    """Every kind of JSON value against every column type."""
    bodies = fx.with_ingest_time(fx.literal_bodies(spark, sf_dir))
    checked = ingest_batch(bodies, fx.PROBES).checked.where("kind = 'item'")
    return (
        checked.select(
            F.try_variant_get("data", "$.no", "bigint").alias("literal_no"),
            F.substring("type_name", 7, 20).alias("column_type"),
            F.coalesce(F.get("errors", F.lit(0))["code"], F.lit("ok")).alias("verdict"),
        )
        .groupBy("literal_no", "column_type", "verdict")
        .agg(F.count("*").alias("items"))
    )


@query
def route_by_type(spark, sf_dir):
    """Three defined types and an unknown one out of the same bodies."""
    checked = ingest_batch(mixed_bodies(spark, sf_dir), [fx.USER_EVENT, fx.ORDER, fx.CUSTOMER]).checked
    return (
        checked.where("kind = 'item'")
        .groupBy("type_name", "route")
        .agg(F.count("*").alias("items"), F.count_if(F.size("errors") == 0).alias("accepted"))
    )


@query
def mixed_orders(spark, sf_dir):
    """One type of a mixed batch, with a default for a missing flag."""
    return ingest_batch(mixed_bodies(spark, sf_dir), [fx.USER_EVENT, fx.ORDER, fx.CUSTOMER]).accepted(fx.ORDER.name)


@query
def rejected_items(spark, sf_dir):
    rejected = events_result(spark, sf_dir).rejected
    return rejected.select(
        "batch_id", "kind", "pos", "type_name", F.array_join("messages", " | ").alias("messages")
    )


@query
def rejected_by_reason(spark, sf_dir):
    rejected = events_result(spark, sf_dir).rejected
    return (
        rejected.select(F.explode("errors").alias("e"))
        .groupBy(F.col("e.code").alias("code"), F.col("e.field").alias("field"))
        .agg(F.count("*").alias("n"))
    )


@query
def quarantine(spark, sf_dir):
    """Rejected rows as stored, reasons in reporting order."""
    stored = read_quarantine(spark, stored_events(spark, sf_dir))
    return stored.select("batch_id", "kind", "pos", F.transform("errors", lambda e: e["code"]).alias("c")).select(
        "batch_id", "kind", "pos", F.array_join("c", ",").alias("codes")
    )


@query
def stamp_ingest_time(spark, sf_dir):
    """One time per batch, cut to milliseconds, first column of every row."""
    bodies = fx.event_bodies(spark, sf_dir).withColumn(
        "ingest_time", F.col("ingest_time") + F.expr("interval '0.123456' second")
    )
    rows = ingest_batch(bodies, [fx.USER_EVENT]).accepted(fx.USER_EVENT.name)
    return rows.groupBy(rows.columns[0]).agg(F.count("*").alias("n"))


@query
def timespans(spark, sf_dir):
    """Texts to nanoseconds and back."""
    n = F.col("event_id")
    text = F.concat(
        F.when(n % 3 > 0, F.concat((n % 3).cast("string"), F.lit("d"))).otherwise(""),
        F.when(n % 7 == 6, F.lit("-")).otherwise(""),
        (n % 24).cast("string"),
        F.lit("h"),
        (n % 60).cast("string"),
        F.lit("m"),
        (n % 61).cast("string"),
        F.lit(".25s"),
    )
    nanos = fx.table(spark, sf_dir, "events").select("event_id", parse_timespan(text).alias("nanos"))
    return nanos.select(
        "event_id",
        "nanos",
        format_timespan(F.abs("nanos")).alias("shown"),
        F.extract(F.lit("DAY"), to_interval(F.abs("nanos"))).cast("bigint").alias("days"),
    )


# --- accounts ------------------------------------------------------------------


@query
def batch_report(spark, sf_dir):
    return events_result(spark, sf_dir).report


@query
def write_ledger(spark, sf_dir):
    return events_result(spark, sf_dir).ledger


@query
def operational_tables(spark, sf_dir):
    """The accounts are types of their own, scanned like any table."""
    root = stored_events(spark, sf_dir)
    batches = telemill.open_table(spark, root, INGEST_EVENT.name).df
    flushes = telemill.open_table(spark, root, WRITER_FLUSH.name).df
    totals = batches.agg(
        F.count("*").alias("batches"),
        F.sum("itemsIn").alias("items_in"),
        F.sum("ingested").alias("ingested"),
        F.sum("rejected").alias("rejected"),
        F.max("statusCode").alias("status"),
    )
    return measures(totals).unionByName(measures(flushes.agg(F.sum("itemsFlushed").alias("flushed"))))


# --- stored tables and queries ----------------------------------------------------


def _events_table(spark, sf_dir) -> telemill.Table:
    return telemill.open_table(spark, stored_events(spark, sf_dir), fx.USER_EVENT.name)


@query
def scan_table(spark, sf_dir):
    return _events_table(spark, sf_dir).df


@query
def scan_where(spark, sf_dir):
    return _events_table(spark, sf_dir).where("value", ">=", 20).where("event_type", "==", "click").df


@query
def scan_project(spark, sf_dir):
    return _events_table(spark, sf_dir).project("event_type", "value").df


@query
def summarize_count(spark, sf_dir):
    return _events_table(spark, sf_dir).where("value", ">", 100).summarize_count("event_type").df


@query
def chain_where_project(spark, sf_dir):
    table = _events_table(spark, sf_dir)
    return table.where("user_id", ">=", 50).project("ingest_time", "event_id", "user_id").df


@query
def take_n(spark, sf_dir):
    """Any five rows: how many they are, and how many of them are in the table."""
    table = _events_table(spark, sf_dir).project("event_id")
    some = table.take(5).df
    return some.join(table.df, "event_id", "left_semi").agg(F.count("*").alias("taken"))


@query
def null_cells(spark, sf_dir):
    rows = _events_table(spark, sf_dir).df
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("props").isNull()).alias("no_props"),
        F.count_if(F.col("dur").isNull()).alias("no_dur"),
    )


@query
def rows_as_json(spark, sf_dir):
    """Rows as JSON texts; the cells are taken out again to compare them."""
    rows = _events_table(spark, sf_dir).rows_as_json()
    cell = lambda name: F.get_json_object("row", f"$.{name}").alias(name)
    return rows.select(
        cell("event_id"), cell("ts"), cell("ingest_time"), cell("event_type"), cell("dur"), cell("props"),
        F.contains("row", F.lit('"dur":null')).alias("dur_is_null"),
    )


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of ``df`` hand on when it runs: those of the row groups that filters could not rule out."""
    scan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = scan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@query
def where_key(spark, sf_dir):
    """Equality on a key of many values: row groups whose Bloom filter lacks it are not read."""
    root, found = scratch_dir(spark, "keys"), None
    rows = fx.table(spark, sf_dir, "customer").select(
        F.lit(fx.START).cast("timestamp_ntz").alias("ingest_time"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal"
    )
    prepare_tables(spark, root, [fx.CUSTOMER])
    telemill.write_table(rows.repartition(16, F.xxhash64("c_name")), root, fx.CUSTOMER, "all", key_columns=["c_name"])
    for row in rows.where("c_custkey % 50 = 7").select("c_name").orderBy("c_custkey").limit(3).collect():
        hit = telemill.open_table(spark, root, fx.CUSTOMER.name).where("c_name", "==", row.c_name).df
        assert rows_scanned(hit) * 4 < rows.count()
        found = hit if found is None else found.unionByName(hit)
    return found.select("c_custkey", "c_name", "c_acctbal")


@query
def time_range_scan(spark, sf_dir):
    """Rows of a period; only its days and row groups are read."""
    return telemill.scan_table(
        spark, stored_events(spark, sf_dir), fx.USER_EVENT.name, "2024-06-01 00:00:05", "2024-06-01 00:01:05"
    )


@query
def historical_query(spark, sf_dir):
    """A table is found and read from storage alone, its definition unknown."""
    root = stored_events(spark, sf_dir)
    entry = find_table(telemill.discover_catalog(spark, root), "user-event")
    columns = ",".join(f"{name}:{kind}" for name, kind in entry.columns)
    counted = telemill.open_table(spark, root, "user-event").summarize_count("event_type").df
    return counted.withColumn("columns", F.lit(columns))


@query
def list_tables(spark, sf_dir):
    """Tables found under a root that all events were ingested into."""
    root = stored_events(spark, sf_dir)
    listed = telemill.list_tables(telemill.discover_catalog(spark, root))
    rows = telemill.open_table(spark, root, fx.USER_EVENT.name).df.agg(F.count("*").alias("rows"))
    rows = rows.withColumn("typeName", F.lit(fx.USER_EVENT.name))
    return listed.join(rows, "typeName", "left").select("typeName", "storageBucket", "mode", "rows")


@query
def multi_root_union(spark, sf_dir):
    """The same type from two roots, one row set each."""
    other = scratch_dir(spark, "other")
    bodies = fx.event_bodies(spark, sf_dir).withColumn("ingest_time", F.col("ingest_time") + F.expr("interval 1 day"))
    store_batch(bodies, [fx.USER_EVENT], other, "second")
    table = telemill.open_table(spark, [stored_events(spark, sf_dir), other], fx.USER_EVENT.name)
    return table.project("ingest_time", "event_id", "value").df


@query
def csv_round_trip(spark, sf_dir):
    """Documents with quotes, commas and line breaks through header-less CSV."""
    root = scratch_dir(spark, "csv")
    documents = fx.table(spark, sf_dir, "documents").select(
        fx.ingest_time_of(F.col("doc_id")).alias("ingest_time"), "doc_id", "text", "lang", "source", "n_chars"
    )
    prepare_tables(spark, root, [fx.DOCUMENT])
    telemill.write_csv(documents, root, fx.DOCUMENT)
    return telemill.open_table(spark, root, fx.DOCUMENT.name).df


@query
def csv_time_range_scan(spark, sf_dir):
    """A period of an exported table: only the segments that can hold it are read."""
    root = scratch_dir(spark, "csv")
    rows = _events_table(spark, sf_dir).df
    prepare_tables(spark, root, [fx.USER_EVENT])
    telemill.write_csv(rows, root, fx.USER_EVENT)
    entry = find_table(telemill.discover_catalog(spark, root), fx.USER_EVENT.name)
    return scan_csv(spark, entry, "2024-06-01 00:02:10", "2024-06-01 00:03:10", skew_seconds=1)


@query
def segments_aligned(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    minutes = {"click": 60, "view": 120, "error": 7, "signup": 10, "purchase": 1440}
    assigned = assign_aligned(events, minutes, "ts", "event_type")
    return assigned.select("event_id", "event_type", "segment")


@query
def segments_aligned_busy_window(spark, sf_dir):
    """Nine of ten events are in one window; names of segments are joined without a broadcast, busy windows in parts."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    one = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id") % 3000).cast("decimal(18,6)"))
    events = events.withColumn("ts", F.when(F.col("event_id") % 10 != 0, one).otherwise(F.col("ts").cast("timestamp_ntz")))
    return assign_aligned(events, 60, "ts", broadcast_rows=0).select("event_id", "segment")


@query
def segments_anchored(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    assigned = assign_anchored(events, 120, "ts")
    return assigned.select("event_id", "segment_start", "segment")


@query
def segments_anchored_tree(spark, sf_dir):
    """The same, with block summaries chained as a tree, as for tables of very many blocks."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    assigned = assign_anchored(events, 120, "ts", flat_rows=0, fan_in=4)
    return assigned.select("event_id", "segment_start", "segment")


@query
def segments_anchored_by_type(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    minutes = {"click": 60, "view": 120, "error": 7, "signup": 10, "purchase": 1440}
    # Blocks of an hour, where a segment may span twenty-four of them.
    assigned = assign_anchored(events, minutes, "ts", "event_type", block_minutes=60)
    return assigned.groupBy("event_type", "segment_start").agg(F.count("*").alias("n"))


@query
def close_segment(spark, sf_dir):
    """Three open loads become one closed segment with the same rows."""
    root = scratch_dir(spark, "rotate")
    rows = _events_table(spark, sf_dir).df
    prepare_tables(spark, root, [fx.USER_EVENT])
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for k in range(3):
        telemill.write_table(rows.where(third == k), root, fx.USER_EVENT, f"open{k}")
    telemill.close_segment(spark, root, fx.USER_EVENT)
    return scan_definition(spark, root, fx.USER_EVENT).select("ingest_time", "event_id", "value", "dur")


@query
def close_segment_under_readers(spark, sf_dir):
    """Two closers race while readers go on: one wins, and every reader has all rows once, whenever it planned and ran."""
    root = scratch_dir(spark, "rotate")
    rows = _events_table(spark, sf_dir).df
    prepare_tables(spark, root, [fx.USER_EVENT])
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for k in range(3):
        telemill.write_table(rows.where(third == k), root, fx.USER_EVENT, f"open{k}")

    def plan() -> DataFrame:
        return scan_definition(spark, root, fx.USER_EVENT).agg(
            F.count("*").alias("rows"), F.sum("event_id").alias("ids"), F.max("ingest_time").alias("last")
        )

    early = plan()
    with ThreadPoolExecutor(2) as pool:
        closers = [pool.submit(telemill.close_segment, spark, root, fx.USER_EVENT) for _ in range(2)]
        seen = [plan().first()]
        while not all(c.done() for c in closers):
            seen.append(plan().first())
    won = sum(c.result() is not None for c in closers)
    seen += [plan().first(), early.first()]
    different = sorted({(r.rows, r.ids, r.last, won) for r in seen})
    return spark.createDataFrame(different, "rows bigint, ids bigint, last timestamp_ntz, closers_that_won int")


@query
def time_range_of_many_loads(spark, sf_dir):
    """A period of a table of very many loads: only the files that can hold it are opened, as their zones tell."""
    root = scratch_dir(spark, "loads")
    rows = _events_table(spark, sf_dir).df
    prepare_tables(spark, root, [fx.USER_EVENT])
    loads = telemill.write_loads(rows, root, fx.USER_EVENT, F.concat_ws("-", F.date_format("ingest_time", "HHmmss"), F.col("event_id") % 5))
    found = telemill.scan_table(spark, root, fx.USER_EVENT.name, "2024-06-01 00:00:05", "2024-06-01 00:00:15")
    assert len(found.inputFiles()) <= 50 < len(loads)
    return found


@query
def many_types(spark, sf_dir):
    """All parts as items of 200 types of 8 columns, checked in one pass."""
    checked = ingest_batch(fx.many_type_bodies(spark, sf_dir), fx.many_types()).checked
    return checked.groupBy("type_name").agg(
        F.count("*").alias("items"), F.count_if(is_accepted()).alias("accepted"), F.sum(F.size("errors")).alias("faults")
    )


@query
def deep_and_long_values(spark, sf_dir):
    """Items that are nested too deep or hold too long a number are rejected alone; their neighbours are accepted."""
    result = ingest_batch(fx.deep_bodies(spark, sf_dir), [fx.CUSTOMER])
    fine = result.accepted(fx.CUSTOMER.name).select(F.lit("accepted").alias("verdict"), F.col("c_custkey").alias("no"))
    wrong = result.checked.where(F.size("errors") > 0).select(
        F.get("errors", F.lit(0))["code"].alias("verdict"), (F.col("batch_id").cast("bigint") * fx.BATCH_SIZE + F.col("pos")).alias("no")
    )
    return fine.unionByName(wrong)


# --- definitions as data -------------------------------------------------------------


@query
def lint_definitions_verdicts(spark, sf_dir):
    linted = lint_definitions(fx.definition_texts(spark, sf_dir))
    return linted.select("seq", "name", "folder", "latency_minutes", "verdict")


@query
def lint_definition_columns(spark, sf_dir):
    return definition_columns(lint_definitions(fx.definition_texts(spark, sf_dir)))


@query
def dedupe_definitions_first_wins(spark, sf_dir):
    linted = lint_definitions(fx.repeated_definitions(spark, sf_dir))
    return dedupe_definitions(linted).select("seq", "name", "verdict")


@query
def definition_sidecars(spark, sf_dir):
    return sidecars(lint_definitions(fx.definition_texts(spark, sf_dir)))


@query
def schema_drift(spark, sf_dir):
    declared, stored = fx.declared_and_stored(spark, sf_dir)
    known = read_sidecars(stored).select(F.col("declared_as").alias("type_name"), "columns", "problem")
    return detect_schema_drift(declared, known)


@query
def discover_catalog_lenient(spark, sf_dir):
    """Schema files of many folders; those that are none are listed apart."""
    catalog, skipped = telemill.discover_catalog_lenient(spark, fx.sidecar_root(spark, sf_dir, faulty=True))
    found = catalog.select(
        F.col("type_name").alias("name"), "storage_bucket", F.size("columns").alias("columns"), F.lit("ok").alias("state")
    )
    left_out = skipped.groupBy("problem").agg(F.count("*").alias("columns")).select(
        F.lit("").alias("name"), F.lit("").alias("storage_bucket"), F.col("columns").cast("int"), F.col("problem").alias("state")
    )
    return found.unionByName(left_out)


@query
def discover_catalog(spark, sf_dir):
    """Many types, several of them in each folder."""
    catalog = telemill.discover_catalog(spark, fx.sidecar_root(spark, sf_dir, faulty=False))
    return catalog.select(
        "type_name",
        "storage_bucket",
        "mode",
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"])), ",").alias("columns"),
    )


# --- streaming --------------------------------------------------------------------------


def _body_files(spark, sf_dir, bodies: DataFrame, files: int) -> str:
    path = scratch_dir(spark, "stream-in")
    bodies.select("body").repartition(files).write.text(path)
    return path


@query
def stream_ingest(spark, sf_dir):
    """All types in one stream, several epochs, then a restart that adds nothing."""
    source = _body_files(spark, sf_dir, mixed_bodies(spark, sf_dir), 3)
    root, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "checkpoint")
    types = [fx.USER_EVENT, fx.ORDER, fx.CUSTOMER]
    for _ in range(2):
        stream = telemill.StreamIngest(spark, root, "mixed", lambda: types)
        stream.start(telemill.stream_batches(spark, source, 1), checkpoint, every=None).awaitTermination()
    counts = [
        telemill.open_table(spark, root, d.name).df.agg(F.count("*").alias("n"), F.count_distinct("ingest_time").alias("epochs"))
        .withColumn("type_name", F.lit(d.name))
        for d in types
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def stream_report(spark, sf_dir):
    """The accounts of a stream add up to what came in."""
    source = _body_files(spark, sf_dir, fx.event_bodies(spark, sf_dir), 2)
    root, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "checkpoint")
    stream = telemill.StreamIngest(spark, root, "events", lambda: [fx.USER_EVENT])
    stream.start(telemill.stream_batches(spark, source, 1), checkpoint, every=None).awaitTermination()
    report = telemill.open_table(spark, root, INGEST_EVENT.name).df
    flushes = telemill.open_table(spark, root, WRITER_FLUSH.name).df
    kept = read_quarantine(spark, root)
    totals = report.agg(
        F.count("*").alias("batches"),
        F.sum("itemsIn").alias("items_in"),
        F.sum("ingested").alias("ingested"),
        F.sum("rejected").alias("rejected"),
    )
    flushed = flushes.agg(F.sum("itemsFlushed").alias("flushed"), F.count("*").alias("flushes"))
    quarantined = kept.agg(F.count("*").alias("quarantined"))
    return measures(totals).unionByName(measures(flushed)).unionByName(measures(quarantined))


@query
def stream_hot_add_remove(spark, sf_dir):
    """A type comes in the second epoch and goes in the third; its rows stay."""
    halves = fx.event_bodies(spark, sf_dir).withColumn("part", F.pmod("batch_id", F.lit(3)))
    source, root = scratch_dir(spark, "stream-in"), scratch_dir(spark, "stream")
    checkpoint = scratch_dir(spark, "checkpoint")
    registry = telemill.Registry(spark, scratch_dir(spark, "registry"))
    registry.add(fx.ORDER.to_json())
    stream = telemill.StreamIngest(spark, root, "events", registry.definitions)
    for part in range(3):
        if part == 1:
            registry.add(fx.USER_EVENT.to_json())
        if part == 2:
            registry.remove(fx.USER_EVENT.name)
        halves.where(F.col("part") == part).select("body").write.mode("append").text(source)
        stream.start(telemill.stream_batches(spark, source), checkpoint, every=None).awaitTermination()
    rows = telemill.open_table(spark, root, fx.USER_EVENT.name).df
    undefined = read_quarantine(spark, root).where(F.exists("errors", lambda e: e["code"] == "item_type_not_defined"))
    stored = rows.agg(F.count("*").alias("stored"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return measures(stored).unionByName(measures(undefined.agg(F.count("*").alias("undefined"))))


@query
def stream_rotated_tables(spark, sf_dir):
    """Three epochs of a type that rotates after two minutes: the third closes the segment of the first two."""
    parts = fx.event_bodies(spark, sf_dir).withColumn("part", F.pmod("batch_id", F.lit(3)))
    source, root = scratch_dir(spark, "stream-in"), scratch_dir(spark, "stream")
    checkpoint = scratch_dir(spark, "checkpoint")
    for part, time in enumerate(("00:00:00.000", "00:01:59.999", "00:02:00.000")):
        parts.where(F.col("part") == part).select("body").write.mode("append").text(source)
        stream = telemill.StreamIngest(
            spark, root, "events", lambda: [fx.USER_EVENT], clock=lambda time=time: f"2024-06-01 {time}"
        )
        stream.start(telemill.stream_batches(spark, source), checkpoint, every=None).awaitTermination()
    rows = telemill.open_table(spark, root, fx.USER_EVENT.name).df.withColumn("file", F.input_file_name())
    state = F.when(F.col("file").contains("=closed-"), "closed").otherwise("open").alias("state")
    return rows.groupBy(state).agg(
        F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"),
        F.count_distinct("ingest_time").alias("epochs"),
    )


@query
def stream_item_limit(spark, sf_dir):
    """Bodies that arrive in files of any size are ingested seven an epoch; only the last epoch has fewer."""
    source, root = _body_files(spark, sf_dir, fx.event_bodies(spark, sf_dir), 3), scratch_dir(spark, "limited")
    limit = ItemLimit(spark, root, 7)
    arriving = telemill.stream_batches(spark, source, 1).writeStream.option("checkpointLocation", scratch_dir(spark, "checkpoint"))
    arriving.foreachBatch(limit.take).trigger(availableNow=True).start().awaitTermination()
    limit.flush()
    out = scratch_dir(spark, "epochs")

    def count(bodies: DataFrame, epoch: int) -> None:
        bodies.agg(F.count("*").alias("bodies")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    limited = limit.stream().writeStream.option("checkpointLocation", scratch_dir(spark, "checkpoint"))
    limited.foreachBatch(count).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("bodies").agg(F.count("*").alias("epochs"))


@query
def stream_quiet_type(spark, sf_dir):
    """A type from which nothing comes any more is closed by its timer once its latency has passed, another one is not yet."""
    root, now = scratch_dir(spark, "stream"), datetime.now(timezone.utc).replace(tzinfo=None)
    stream = telemill.StreamIngest(
        spark, root, "mixed", lambda: [fx.USER_EVENT, fx.ORDER], clock=lambda: str(now - timedelta(minutes=3))[:23]
    )
    source = telemill.stream_batches(spark, _body_files(spark, sf_dir, mixed_bodies(spark, sf_dir), 1))
    stream.start(source, scratch_dir(spark, "checkpoint"), every=None).awaitTermination()

    def state() -> DataFrame:
        kinds = [
            scan_definition(spark, root, d).select(
                F.lit(d.name).alias("type_name"),
                F.when(F.input_file_name().contains("=closed-"), "closed").otherwise("open").alias("state"),
            )
            for d in (fx.USER_EVENT, fx.ORDER)
        ]
        return kinds[0].unionByName(kinds[1]).groupBy("type_name", "state").agg(F.count("*").alias("n"))

    timers = stream.start_timers(scratch_dir(spark, "timers"), "500 milliseconds")
    end = time.monotonic() + 120
    while timers.isActive and time.monotonic() < end and not state().where("state = 'closed'").head(1):
        time.sleep(0.5)
    timers.stop()
    return state()


@query
def stream_write_failure(spark, sf_dir):
    """A store that fails once: the failure is on record, and nothing is lost or doubled."""
    source = _body_files(spark, sf_dir, mixed_bodies(spark, sf_dir), 2)
    root, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "checkpoint")
    types = [fx.USER_EVENT, fx.ORDER, fx.CUSTOMER]

    def failing(rows, root, definition, load):
        if definition.name == fx.ORDER.name:
            raise OSError("disk full")
        return telemill.write_table(rows, root, definition, load)

    for writer in (failing, telemill.write_table):
        stream = telemill.StreamIngest(spark, root, "mixed", lambda: types, writer=writer)
        running = stream.start(telemill.stream_batches(spark, source), checkpoint, every=None)
        try:
            running.awaitTermination()
        except Exception as failure:  # the stream stops with the store's own error
            if "disk full" not in str(failure):
                raise
    failures = telemill.open_table(spark, root, WRITER_ERROR.name).summarize_count("itemType", "operation").df
    stored = [
        telemill.open_table(spark, root, d.name).df.agg(F.count("*").alias("count_")).select(
            F.lit(d.name).alias("itemType"), F.lit("stored").alias("operation"), "count_"
        )
        for d in types
    ]
    return failures.unionByName(stored[0]).unionByName(stored[1]).unionByName(stored[2])


@query
def stream_rotation(spark, sf_dir):
    """Anchored segments over micro-batches equal those over the whole table."""
    events = fx.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("ingest_time"), F.col("event_type").alias("type_name")
    )
    minutes = {"click": 60, "view": 120, "error": 7, "signup": 10, "purchase": 1440}
    days = events.withColumn("day", F.to_date("ingest_time"))
    rotation = telemill.StreamRotation(spark, scratch_dir(spark, "rotation"), minutes)
    out = scratch_dir(spark, "rotated")
    source = scratch_dir(spark, "events-in")
    checkpoint = scratch_dir(spark, "checkpoint")

    def assign(rows: DataFrame, epoch: int) -> None:
        rotation.assign(rows, epoch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    # Two arrivals: the first and the second half of the month.
    for k, half in enumerate((F.dayofmonth("day") <= 15, F.dayofmonth("day") > 15)):
        days.where(half).drop("day").write.parquet(f"{source}/arrival={k}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(source)
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(assign).trigger(
            availableNow=True
        ).start().awaitTermination()
    rotated = spark.read.parquet(out)
    return rotated.groupBy(F.col("type_name").alias("event_type"), "segment_start").agg(F.count("*").alias("n"))
